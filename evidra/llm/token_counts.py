"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut at special strings and into pre-tokens. The distinct pre-tokens of a batch become one
flat array of symbols with the row that each belongs to. In each step every row's lowest-ranked pair
is found and all its places are merged at once, left to right; rows without a ranked pair are done.
A pair that holds a new symbol ranks after the one that made it, so this gives what merging one place
at a time gives. Only counts are kept. Counts of short pre-tokens are remembered up to a fixed number.

The vocabulary file's path is a parameter; each Python worker loads it once from the installation.

Defined results: null and empty texts have no bytes and no tokens. Null ids and repeated rows give
results like others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from evidra.llm.common import rows

LIMIT = 512
#: Remembered pre-tokens in each worker, and the longest of them in characters.
REMEMBERED, SHORT = 300_000, 40


class Counter:
    def __init__(self, path: str):
        """path: a tokenizer of type BPE with a ByteLevel pre-tokenizer, as JSON."""
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # Bytes are printed as characters: those that print as themselves, then the rest from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte_id = np.array([vocab[names[b]] for b in range(256)], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.made_by_rank = np.array([vocab[a + b] for a, b in merges] + [0], np.int64)
        # The last of equal pairs counts, as it does when they are read into a map.
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        last = np.append(self.keys[1:] != self.keys[:-1], True)
        self.keys, self.ranks = self.keys[last], self.ranks[last]
        self.none = len(merges)
        self.cut = regex.compile(public_tokenizers.PATTERN)
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}
        # Code points that only some Unicode versions know: texts with them are cut by the library's own splitter.
        found = regex.compile(r"[\p{L}\p{N}]")
        self.doubt = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and found.match(c))
        self.splitter = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that each non-empty piece ends with."""
        out = np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(len(pieces)), size)
        while len(sym):
            # rank[i] is that of symbols i and i + 1, none at the end of a row.
            rank = np.full(len(sym), self.none, np.int64)
            inner = np.flatnonzero(row[1:] == row[:-1])
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(sym)))
            out[row[begin]] = length
            best = np.repeat(least, length)
            hit = (rank == best) & (rank < self.none)
            # Of overlapping places of one pair (a, a), every second one from the left merges.
            if (hit[1:] & hit[:-1]).any():
                i = np.arange(len(hit))
                opens = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), i, -1))
                hit &= (i - opens) % 2 == 0
            stays = np.repeat(least < self.none, length)
            at = np.flatnonzero(hit)
            sym[at] = self.made_by_rank[rank[at]]
            stays[at + 1] = False
            sym, row = sym[stays], row[stays]
        return out

    def doubtful(self, piece: str) -> bool:
        return not piece.isascii() and not self.doubt.isdisjoint(piece)

    def pieces(self, text: str, own: bool = True) -> tuple[list[str], int]:
        """Pre-tokens of a text, by our own pattern or the library's splitter, and the number of special tokens in it."""
        parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        if own:
            return [p for x in parts for p in self.cut.findall(x)], len(parts) - 1
        return [x[a:b] for x in parts for _, (a, b) in self.splitter.pre_tokenize_str(x)], len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.pieces(t) if t else ([], 0) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {p for x, _ in cut for p in x}.difference(known)
        # Pieces with doubtful characters are never remembered, so none hides a text that has them.
        if bad := {p for p in new if self.doubtful(p)}:
            cut = [c if bad.isdisjoint(c[0]) else self.pieces(t, own=False) for t, c in zip(texts, cut, strict=True)]
            new = {p for x, _ in cut for p in x}.difference(known)
        new = list(new)
        extra: dict[str, int] = {}
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for p, n in zip(part, self.merged([p.encode("utf-8", "surrogatepass") for p in part]).tolist(), strict=True):
                (known if len(p) <= SHORT and not self.doubtful(p) else extra)[p] = n
        if extra:
            known = known | extra
        return [sum(map(known.__getitem__, x)) + n for x, n in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text)."""
    d = docs.selectExpr("doc_id", "cast(text as string) as text", "cast(coalesce(octet_length(text), 0) as long) as n_bytes")

    def run(batches):
        c = counter(path)
        for b in rows(batches, 256):
            n = c.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
