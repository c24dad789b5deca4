"""An n-gram language model in Elias-Fano tries, and the scoring of texts.

Words are hashed to 64 bits; their ids are positions among the sorted hashes. Each level of the trie is cut into parts,
ranges of contexts that occur about equally often, so a frequent first word is cut by its second one and the number of parts
follows the data; a part holds at least the followers of one context, at most as many as there are words. Each level of a part keeps

* monotone pointers: for each n-gram of the level above, where its followers begin;
* followers: word ids made monotone over the level by adding, to those of a context, the last value of
  the context before; a word is found by a successor search within its context's range, relative to
  that base;
* quantised log10 of discounted probabilities and, for contexts, quantised log10 back-off weights.

Pointers and followers are Elias-Fano sequences. Files lie in the shared folder. Where that is a path, parts are memory maps that all
workers of a machine share; else a worker reads the parts that it needs and forgets those it has not used for long. Nothing is copied to
a machine's own folders.

Probabilities are absolute discounting, interpolated, over add-one unigrams: what an n-gram has itself, and its context's weight times
the probability after one word less, which a scoring walk has just met. n-grams from order 2 on
that occur less than `least` times are left out; their mass goes to the back-off weight, so each distribution sums to 1; with
1 none is. Counts are taken over all training texts: each task sums what it reads before anything is shuffled, as
sorted arrays by part. A second pass writes the texts as word ids, which the later passes read. Places and word ids share 64 bits while
they fit, and are compared as pairs beyond that.

Defined results: a null or empty text is one end token. A row without doc_id is trained on; ids may be of any type. Repeated
rows count as often as they occur. Without training texts every word is unknown. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import LOWER, Scratch, open_fs, rows

#: Occurrences of the contexts of a part, about, and the most parts of a level.
SPAN, PARTS = 2_000_000, 65_536
#: Tasks that build the parts of a level, at most, and bytes of parts that a worker keeps where files are no maps.
TASKS, KEPT = 20_000, 512 << 20
ORDER = 3
DISCOUNT = 0.75
#: n-grams with fewer occurrences are left out by default.
LEAST = 1
#: Quantised values are steps of 2**-12 in log10, up to 16.
STEP = 4096
#: Distinct n-grams that a task holds before it passes them on.
HELD = 2_000_000
END = xxhash.xxh3_64_intdigest(b" end ")
_U = np.uint64


def hashes(text: str | None) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    return [*map(xxhash.xxh3_64_intdigest, words), END]


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * STEP), 0, 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return q.astype(float) / -STEP


def summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts, each 1 if there are none."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[first], np.diff(np.append(first, len(keys)))
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


class EliasFano:
    """A non-decreasing sequence of integers: low bits as they are, high bits in unary."""

    @staticmethod
    def arrays(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(_U)
        size = n + (top >> width) + 2
        # One word more, so that a window of 64 bits begins everywhere.
        unary = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        unary[(v >> _U(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(_U)
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))
        low = np.zeros(n * width // 8 + 16, np.uint8)
        if width:
            bits = np.packbits(((v[:, None] >> np.arange(width, dtype=_U)) & _U(1)).astype(np.uint8).ravel(), bitorder="little")
            low[: len(bits)] = bits
        return {f"{name}.meta": np.array([n, width], np.int64), f"{name}.high": high, f"{name}.ones": ones, f"{name}.low": low}

    def __init__(self, store: dict[str, np.ndarray], name: str):
        self.n, self.width = map(int, store[f"{name}.meta"])
        self.high, self.ones, self.low = (store[f"{name}.{k}"] for k in ("high", "ones", "low"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.bits = (len(self.high) - 1) * 64
        # Eight bytes from each byte on.
        self.eight = np.ndarray(len(self.low) - 7, _U, np.ascontiguousarray(self.low).data, strides=(1,))

    @staticmethod
    def _within(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the r-th set bit of each word."""
        at = np.zeros(len(x), np.int64)
        r = r.copy()
        for w in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & _U((1 << w) - 1))
            go = r >= c
            r -= c * go
            go = go * np.uint8(w)
            x = x >> go
            at += go
        return at

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        x = np.asarray(self.high)[np.minimum(word, len(self.high) - 1)]
        return word * 64 + self._within(x if one else ~x, k - before[word])

    def run(self, at: np.ndarray, ones: bool) -> np.ndarray:
        """How many set bits, or unset ones, follow from each place on; 64 or more are 64."""
        word, shift = at >> 6, (at & 63).astype(_U)
        high = self.high
        x = (high[word] >> shift) | ((high[np.minimum(word + 1, len(high) - 1)] << _U(1)) << (_U(63) - shift))
        x = ~x if ones else x
        return np.bitwise_count((x & (~x + _U(1))) - _U(1)).astype(np.int64)

    def ends(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1."""
        at = self.select(i, True)
        gap = self.run(at + 1, False)
        after = at + 1 + gap
        far = np.flatnonzero(gap >= 64)
        if len(far):
            after[far] = self.select(i[far] + 1, True)
        return ((at - i) << self.width) | self.lows(i), ((after - i - 1) << self.width) | self.lows(i + 1)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        return ((self.eight[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.width) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i, True) - i) << self.width) | self.lows(i)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the first value >= x among positions lo <= i < hi is equal to x; else -1."""
        out = np.full(len(x), -1, np.int64)
        h = x >> self.width
        use = np.flatnonzero((lo < hi) & (h <= self.zeros[-1] - 1))
        if not len(use):
            return out
        x, h, lo, hi = x[use], h[use], lo[use], hi[use]
        # The low bits of a value's high part lie where its run of set bits says.
        at = np.where(h > 0, self.select(np.maximum(h - 1, 0), False) + 1, 0)
        begin, size = at - h, self.run(at, True)
        far = np.flatnonzero(size >= 64)
        if len(far):
            size[far] = self.select(h[far], False) - at[far]
        end = begin + size
        begin, end, low = np.maximum(begin, lo), np.minimum(end, hi), x & ((1 << self.width) - 1)
        left, right = begin.copy(), np.maximum(begin, end)
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            less = self.lows(mid) < low[open_]
            left[open_[less]], right[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[left[open_] < right[open_]]
        hit = (left < end) & (self.lows(np.minimum(left, self.n - 1)) == low)
        out[use[hit]] = left[hit]
        return out


class Level:
    """The followers of each context in one part."""

    @staticmethod
    def arrays(contexts: int, ctx: np.ndarray, word: np.ndarray, p: np.ndarray, rest: np.ndarray) -> dict[str, np.ndarray]:
        """ctx, word: sorted pairs; p: their discounted probabilities; rest: the back-off weight of each of the contexts."""
        begin = np.searchsorted(ctx, np.arange(contexts + 1))
        # The base of a context is the last value before it.
        last = np.zeros(contexts, np.int64)
        full = np.flatnonzero(begin[1:] > begin[:-1])
        last[full] = word[begin[1:][full] - 1] + 1
        base = np.append(0, np.cumsum(last))[:-1]
        return EliasFano.arrays(begin, "begin") | EliasFano.arrays(base[ctx] + word + 1, "words") | {"p": quantised(p), "rest": quantised(rest)}

    def __init__(self, store: dict[str, np.ndarray]):
        self.begin, self.words = EliasFano(store, "begin"), EliasFano(store, "words")
        self.p, self.rest = store["p"], store["rest"]

    def find(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of words among the followers of ctx (sorted); -1 where they don't follow."""
        if not len(ctx) or not self.words.n:
            return np.full(len(ctx), -1, np.int64)
        one = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        times = np.diff(np.append(one, len(ctx)))
        own = ctx[one]
        lo, hi = self.begin.ends(own)
        base = np.where(lo > 0, self.words[np.maximum(lo - 1, 0)], 0)
        lo, hi, base = (np.repeat(v, times) for v in (lo, hi, base))
        return self.words.find(base + word + 1, lo, hi)


def save(root: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of aligned arrays, by a temporary name: a repeated task writes the same again."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (at, v.dtype.str, len(v))
        at += -(-v.nbytes // 64) * 64
    fs, base = open_fs(root)
    fs.create_dir(base, recursive=True)
    first = json.dumps(head).encode()
    temporary = f"{base}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(len(first).to_bytes(64, "little"))
        f.write(first + b" " * (-len(first) % 64))
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + b"\0" * (-v.nbytes % 64))
    fs.move(temporary, f"{base}/{name}")


def load(root: str, name: str) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a file, and the bytes that they hold in memory: none where the file is a map."""
    fs, base = open_fs(root)
    path, held = f"{base}/{name}", 0
    if fs.type_name == "local":
        data = np.memmap(path, np.uint8, "r")
    else:
        with fs.open_input_file(path) as f:
            data = np.frombuffer(f.read_buffer(), np.uint8)
        held = len(data)
    size = int.from_bytes(data[:64].tobytes(), "little")
    start = 64 + -(-size // 64) * 64
    head = json.loads(data[64 : 64 + size].tobytes())
    return {k: np.asarray(data[start + a : start + a + n * np.dtype(t).itemsize].view(t)) for k, (a, t, n) in head.items()}, held


class Parts:
    """Parts of a model, opened when they are asked for; beyond a bound the longest unused go."""

    def __init__(self, root: str, most: int = 20_000):
        self.root, self.most, self.open, self.bytes = root, most, OrderedDict(), 0

    def get(self, name: str, kind):
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name][0]
        arrays, held = load(self.root, name)
        self.open[name] = (kind(arrays), held)
        self.bytes += held
        while len(self.open) > 1 and (self.bytes > KEPT or len(self.open) > self.most):
            _, (_, gone) = self.open.popitem(last=False)
            self.bytes -= gone
        return self.open[name][0]


PAIR = np.dtype([("ctx", _U), ("word", _U)])


def paired(ctx: np.ndarray, word: np.ndarray, shift: int, top: int) -> np.ndarray:
    """Keys that sort by context and word; top: the largest context."""
    if int(top) >> (64 - shift) == 0:
        return (ctx.astype(_U) << _U(shift)) | word.astype(_U)
    out = np.empty(len(ctx), PAIR)
    out["ctx"], out["word"] = ctx, word
    return out


def unpaired(key: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    if key.dtype == PAIR:
        return key["ctx"].astype(np.int64), key["word"].astype(np.int64)
    return (key >> _U(shift)).astype(np.int64), (key & ((_U(1) << _U(shift)) - _U(1))).astype(np.int64)


class Words:
    """Ids and counts of words: sorted hashes by part, a part for each value of the leading bits."""

    def __init__(self, parts: Parts):
        meta, _ = load(parts.root, "meta1")
        self.parts, sizes = parts, meta["n"]
        self.bits = len(sizes).bit_length() - 1
        self.offsets = np.append(0, np.cumsum(sizes))
        self.types, self.total = int(self.offsets[-1]), int(meta["total"][0])

    def of(self, p: int) -> dict[str, np.ndarray]:
        return self.parts.get(f"words-{p:05d}", dict)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts); unknown words have the id types and the count 0."""
        order = np.argsort(h)
        one = h[order]
        new = np.append(True, one[1:] != one[:-1])[: len(one)]
        one, back = one[new], np.empty(len(h), np.int64)
        back[order] = np.cumsum(new) - 1
        ids, counts = np.full(len(one), self.types, np.int64), np.zeros(len(one), np.int64)
        cut = np.append(np.searchsorted(one, leading(self.bits)), len(one))
        for p in np.flatnonzero((cut[1:] > cut[:-1]) & (self.offsets[1:] > self.offsets[:-1])):
            a, b, own = cut[p], cut[p + 1], self.of(p)
            at = np.minimum(np.searchsorted(own["hashes"], one[a:b]), len(own["hashes"]) - 1)
            ok = own["hashes"][at] == one[a:b]
            ids[a:b][ok] = self.offsets[p] + at[ok]
            counts[a:b][ok] = own["counts"][at[ok]]
        return ids[back], counts[back]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id; 0 for the unknown."""
        one, back = np.unique(ids, return_inverse=True)
        out = np.zeros(len(one), np.int64)
        part = np.searchsorted(self.offsets, one, side="right") - 1
        for p in np.unique(part[one < self.types]):
            own = (part == p) & (one < self.types)
            out[own] = self.of(p)["counts"][one[own] - self.offsets[p]]
        return out[back]

    def log_p(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-one probability."""
        return np.log10((counts + 1) / (self.total + self.types + 1))


def leading(bits: int) -> np.ndarray:
    """The smallest hash of each part."""
    return np.arange(1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(1, _U)


class Model:
    """An n-gram's place counts through all parts of its level in turn; a word's place is its id.

    bounds[k]: where the contexts of each part of level k begin, and their end; offsets[k]: the same of its n-grams.
    """

    def __init__(self, root: str, levels: int):
        self.root, self.parts = root, Parts(root)
        self.words = Words(self.parts)
        self.top, self.bounds, self.offsets = levels, {}, {1: self.words.offsets}
        for k in range(2, levels + 1):
            meta, _ = load(root, f"meta{k}")
            self.bounds[k], self.offsets[k] = meta["bounds"], np.append(0, np.cumsum(meta["n"]))
        self.shift = max(1, self.words.types.bit_length())

    def level(self, k: int, part: int) -> Level:
        return self.parts.get(f"level{k}-{part:05d}", Level)

    def look_up(self, k: int, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n-grams of order k: their places or -1, log10 discounted probabilities (0 if absent), and log10 back-off weights of the contexts.

        ctx is the context's place, or -1 where there is none. A word that is unknown follows nothing.
        """
        at, p, rest = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx)), np.zeros(len(ctx))
        use = np.flatnonzero(ctx >= 0)
        bounds, offsets = self.bounds[k], self.offsets[k]
        key = paired(ctx[use], word[use], self.shift, bounds[-1])
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        c, w = unpaired(key[new], self.shift)
        found, of_p, of_rest = np.full(len(c), -1, np.int64), np.zeros(len(c)), np.zeros(len(c))
        cut = np.searchsorted(c, bounds)
        for q in np.flatnonzero(cut[1:] > cut[:-1]):
            own, level = slice(cut[q], cut[q + 1]), self.level(k, q)
            local = c[own] - bounds[q]
            place = level.find(local, w[own])
            ok = place >= 0
            of_p[own][ok] = restored(level.p[place[ok]])
            found[own] = np.where(ok, place + offsets[q], -1)
            of_rest[own] = restored(level.rest[local])
        back = np.cumsum(new) - 1
        own = use[order]
        at[own], p[own], rest[own] = found[back], of_p[back], of_rest[back]
        return at, p, rest

    def contexts(self, k: int, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The place of the (k-1)-gram before each token, or -1."""
        for _, _, at, _, _ in self.walk(k - 1, ids, first):
            pass
        return np.where(self.since(first) >= k - 1, np.append(-1, at[:-1]), -1)

    @staticmethod
    def since(first: np.ndarray) -> np.ndarray:
        """Tokens since the text began."""
        i = np.arange(len(first))
        return i - np.maximum.accumulate(np.where(first, i, 0))

    def walk(self, k: int, ids: np.ndarray, first: np.ndarray):
        """(order, contexts, places, log10 probabilities, log10 back-off weights) of the n-grams that end at each token, up to order k."""
        since = self.since(first)
        at = np.where(ids < self.words.types, ids, -1)
        yield 1, None, at, None, None
        for j in range(2, k + 1):
            ctx = np.where(since >= j - 1, np.append(-1, at[:-1]), -1)
            at, p, rest = self.look_up(j, ctx, ids)
            yield j, ctx, at, p, rest

    def scores(self, ids: np.ndarray, uni: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token; uni: that of the unigrams; first: where texts begin."""
        p = 10.0**uni
        for k, _, at, own, rest in self.walk(self.top, ids, first):
            if k > 1:
                p *= 10.0**rest
                hit = at >= 0
                p[hit] += 10.0 ** own[hit]
        return np.log10(p)


@lru_cache(maxsize=2)
def opened(root: str, levels: int) -> Model:
    return Model(root, levels)


COUNTS = "part int, keys binary, counts binary"


def _told(keys: np.ndarray, counts: np.ndarray, cut: np.ndarray, local):
    """A row for each part, its keys as local() gives them. Numbers are stored byte by byte, so that equal bytes lie together."""
    own = [p for p in range(len(cut) - 1) if cut[p + 1] > cut[p]]

    def raw(x):
        return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()

    keys_ = [raw(local(p, keys[cut[p] : cut[p + 1]])) for p in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(keys_, pa.binary()), pa.array([raw(counts[cut[p] : cut[p + 1]]) for p in own], pa.binary())], names=["part", "keys", "counts"])


def _read(x: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _counting(of_batch, cut_at, local=lambda p, keys: keys):
    """Sums the keys that of_batch gives for each batch, and passes them on when there are many.

    cut_at gives, for sorted keys, where each part begins, and their number.
    """

    def run(batches):
        keys, counts, fresh, size = None, np.empty(0, np.int64), [], 0

        def merged():
            one = summed(np.concatenate(fresh), None)
            return one if keys is None else summed(np.concatenate((keys, one[0])), np.concatenate((counts, one[1])))

        for b in batches:
            for part in rows([b], 1000):
                k = of_batch(part)
                fresh.append(k)
                size += len(k)
                if size >= HELD // 2:
                    keys, counts = merged()
                    fresh, size = [], 0
                    if len(keys) >= HELD:
                        yield _told(keys, counts, cut_at(keys), local)
                        keys, counts = None, counts[:0]
        if fresh:
            keys, counts = merged()
        if keys is not None and len(keys):
            yield _told(keys, counts, cut_at(keys), local)

    return run


BUILT = "part int, n long, total long, cuts array<long>"


def _by_part(finish):
    """Merges the rows of each part and calls finish(part, keys, counts), which gives n, total and cuts."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("cuts", pa.list_(pa.int64()))])

    def run(batches):
        now, keys, counts, size = None, [], [], 0

        def done():
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (now, *finish(now, k, c)), strict=True))], schema=schema)

        for b in rows(batches, 16):
            for p, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != now:
                    if now is not None:
                        yield done()
                    now, keys, counts, size = p, [], [], 0
                keys.append(_read(k, _U))
                counts.append(_read(c, np.int64))
                size += len(keys[-1])
                if size > 4_000_000 and len(keys) > 1:
                    k, c = summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, size = [k], [c], 0
        if now is not None:
            yield done()

    return run


def _built(counts: DataFrame, parts: int, finish) -> list:
    """What finish gives for each part, in order. Every part gets an empty row too, so that each is written."""
    empty = counts.sparkSession.range(parts).selectExpr("cast(id as int) as part", "cast('' as binary) as keys", "cast('' as binary) as counts")
    tasks = min(parts, TASKS)
    dealt = counts.union(empty).repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")
    return sorted(dealt.mapInArrow(_by_part(finish), BUILT).collect())


def cuts_of(counts: np.ndarray, span: int) -> list[int]:
    """Where ranges of about span occurrences begin."""
    if not len(counts):
        return [0]
    at = (np.cumsum(counts) - counts) // span
    return np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist()


class Training:
    """What the passes over the corpus share. All state is files below root."""

    def __init__(self, docs: DataFrame, order: int = ORDER, least: int = LEAST, span: int = SPAN):
        """docs: doc_id, text and a boolean held_out."""
        self.spark, self.order, self.least, self.span = docs.sparkSession, order, least, span
        self.scratch = Scratch(self.spark, "ngram")
        self.root = f"{self.scratch.root}/model"
        self.docs = docs

    def count_words(self) -> None:
        size = self.docs.where("not held_out").agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # Words have six bytes, about.
        bits = min(PARTS, max(1, size // 6 // self.span)).bit_length()

        def of_batch(b):
            return np.concatenate([np.array(hashes(t), _U) for t in b.column(0).to_pylist()] or [np.empty(0, _U)])

        def cut_at(keys):
            return np.append(np.searchsorted(keys, leading(bits)), len(keys))

        root, span = self.root, max(self.span, size // 6 // PARTS)
        self.span = span

        def finish(part, keys, counts):
            save(root, f"words-{part:05d}", {"hashes": keys, "counts": counts})
            return len(keys), int(counts.sum()), cuts_of(counts, span)

        train = self.docs.where("not held_out").select("text")
        done = _built(train.mapInArrow(_counting(of_batch, cut_at), COUNTS), 1 << bits, finish)
        save(root, "meta1", {"n": np.array([r.n for r in done], np.int64), "total": np.array([sum(r.total for r in done)], np.int64)})
        self.types = sum(r.n for r in done)
        self.next = done

    def encode(self) -> None:
        """The table of word ids; base scores are taken here, where counts are at hand."""
        root = self.root
        # Ids take 32 bits while they fit, the unknown word's among them.
        short = self.types < 2**32 - 1

        def run(batches):
            words = opened(root, 1).words
            for b in rows(batches, 1000):
                each = [hashes(t) for t in b.column(1).to_pylist()]
                size = np.array([len(x) for x in each], np.int64)
                ids, counts = words.look_up(np.concatenate([np.array(x, _U) for x in each] or [np.empty(0, _U)]))
                log_p = words.log_p(counts)
                at = np.append(0, np.cumsum(size))[:-1]
                known = np.add.reduceat((counts > 0).astype(np.int64), at) if len(at) else at
                base = np.add.reduceat(log_p, at) if len(at) else at
                flat_ = pa.array(ids.astype(np.uint32).view(np.int32) if short else ids)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat_)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists, pa.array(known), pa.array(base, pa.float64())], names=["doc_id", "held_out", "ids", "n_known", "base_score"])

        d = self.docs.select("doc_id", "text", "held_out")
        kind = d.schema["doc_id"].dataType.simpleString()
        self.coded = self.scratch.store(d.mapInArrow(run, f"doc_id {kind}, held_out boolean, ids array<{'int' if short else 'long'}>, n_known long, base_score double"), "ids")

    def count_grams(self, k: int) -> None:
        """Level k from the table of ids: contexts are the (k-1)-grams that were kept, cut where the level before says."""
        root, least, span = self.root, self.least, self.span
        offsets = np.append(0, np.cumsum([r.n for r in self.next]))
        starts = sorted({int(offsets[i]) + c for i, r in enumerate(self.next) if r.n for c in r.cuts})
        bounds = np.array([*(starts or [0]), int(offsets[-1])], np.int64)
        save(root, f"bounds{k}", {"bounds": bounds})

        def of_batch(b):
            model = opened(root, k - 1)
            ids, first = flat(b.column(0))
            ctx = model.contexts(k, ids, first) if len(ids) else ids
            return paired(ctx[ctx >= 0], ids[ctx >= 0], model.shift, model.offsets[k - 1][-1])

        def cut_at(keys):
            return np.searchsorted(unpaired(keys, opened(root, k - 1).shift)[0], cached(root, k))

        def local(p, keys):
            shift = opened(root, k - 1).shift
            ctx, word = unpaired(keys, shift)
            return paired(ctx - cached(root, k)[p], word, shift, 0)

        def finish(part, keys, counts):
            model = opened(root, k - 1)
            start, end = cached(root, k)[part : part + 2]
            contexts = int(end - start)
            ctx, word = unpaired(keys, model.shift)
            total = np.bincount(ctx, counts, contexts)
            keep = counts >= least
            ctx, word, c = ctx[keep], word[keep], counts[keep]
            own = (c - DISCOUNT) / total[ctx] if len(c) else np.empty(0)
            rest = 1 - np.bincount(ctx, own, contexts)
            save(root, f"level{k}-{part:05d}", Level.arrays(contexts, ctx, word, own, rest))
            return len(ctx), int(c.sum()), cuts_of(c, span)

        train = self.coded.where("not held_out").select("ids")
        done = _built(train.mapInArrow(_counting(of_batch, cut_at, local), COUNTS), len(bounds) - 1, finish)
        save(root, f"meta{k}", {"n": np.array([r.n for r in done], np.int64), "bounds": bounds})
        self.next = done

    def run(self) -> None:
        self.count_words()
        self.encode()
        for k in range(2, self.order + 1):
            self.count_grams(k)


@lru_cache(maxsize=4)
def cached(root: str, k: int) -> np.ndarray:
    """Where the contexts of the parts of a level that is being built begin, and their end."""
    return np.array(load(root, f"bounds{k}")[0]["bounds"])


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch, and where texts begin."""
    ids = np.asarray(lists.flatten())
    ids = ids.view(np.uint32).astype(np.int64) if ids.dtype == np.int32 else ids
    size = np.asarray(lists.value_lengths())
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    return ids, first


def score(docs: DataFrame, held_out, order: int = ORDER, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """Trains on the rows of docs (doc_id, text) where the column held_out is false, and scores all rows.

    least: n-grams of order 2 and more that occur less often are left out. span: occurrences of the contexts of a part.
    """
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    t = Training(d, order, least, span)
    t.run()
    root = t.root

    def run(batches):
        model = opened(root, order)
        words = model.words
        for b in rows(batches, 2000):
            ids, first = flat(b.column(2))
            log_p = model.scores(ids, words.log_p(words.counts(ids)), first)
            at = np.flatnonzero(first)
            total = np.add.reduceat(log_p, at) if len(at) else np.empty(0)
            size = pa.array(np.asarray(b.column(2).value_lengths()), pa.int64())
            n = pa.array(np.full(b.num_rows, words.total), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, b.column(3), n, b.column(4), pa.array(total, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = t.coded.schema["doc_id"].dataType.simpleString()
    return t.coded.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
