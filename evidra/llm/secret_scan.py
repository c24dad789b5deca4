"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a maximal run of at least WINDOW token characters. A window of WINDOW characters slides over it and
keeps, by incremental counts, its Shannon entropy and how many of its characters belong to each class: one
character enters, one leaves, and only their terms change. The window is judged by the limit of the narrowest class
that holds all of it. Windows at or above the limit are joined into spans.

The allow-list works on the pieces between a run's joints (/ _ = + -): words, numbers, placeholders and UUIDs. A
window at least half of which lies in such pieces or joints is suppressed; the rest of the run is judged all the
same. The fixed patterns are never suppressed.

Texts are scanned whole, one at a time, so memory is bounded by the longest text. Nothing is shuffled.

Defined results: null and empty texts have no spans. Null ids and repeated rows give results like others; ids may be
of any type. Overlapping spans of different kinds are all returned. An empty table gives an empty result.
Extra columns are ignored by scan() and kept by redact().
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.llm.common import rows

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: The entropy in bits a character at which a window of hex digits, of letters and digits, and of all token characters is suspicious.
LIMITS = (3.2, 3.7, 3.9)
_UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
_PIECE = re.compile(r"[A-Za-z0-9]+")
#: A placeholder may go on for a few characters: example1, test2024.
_PLACEHOLDER = re.compile(r"(?:example|sample|placeholder|changeme|dummy|test)[A-Za-z0-9]{0,6}", re.I)
_TERM = [0.0] + [n / WINDOW * math.log2(n / WINDOW) for n in range(1, WINDOW + 1)]
_HEX_BYTES = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN_BYTES = bytes(104 if re.match(rb"[A-Za-z0-9+/_=-]", bytes([b])) else 32 for b in range(256))


def like_word(s: str) -> bool:
    """Whether letters read as words: few changes of case, some vowels, no long run of consonants."""
    low = s.lower()
    vowels = sum(c in "aeiouy" for c in low)
    turns = sum(a.islower() and b.isupper() for a, b in zip(s, s[1:]))
    return len(s) <= 4 or (0.2 <= vowels / len(s) <= 0.7 and turns <= len(s) / 4 and not re.search("[^aeiouy]{6}", low))


def allowed(s: str) -> bytearray:
    """For each character of a candidate 1 where the allow-list holds."""
    out = bytearray(b"\1" * len(s))
    for m in _PIECE.finditer(s):
        x = m[0]
        if not (x.isdigit() or (x.isalpha() and like_word(x)) or _PLACEHOLDER.fullmatch(x)):
            out[m.start() : m.end()] = bytes(len(x))
    for m in _UUID.finditer(s):
        out[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return out


def _class(c: str) -> int:
    return 0 if c in "0123456789abcdefABCDEF" else 1 if c.isalnum() else 2


def high_windows(s: str, free: bytearray | None = None, limits: tuple[float, float, float] = LIMITS) -> list[tuple[int, int]]:
    """Joined (start, end) of the windows of s that are suspicious and mostly not free."""
    out: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    kinds, total, n_free = [0, 0, 0], 0.0, 0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        kinds[_class(c)] += 1
        n_free += free[i] if free else 0
        total += _TERM[n + 1] - _TERM[n] if n < WINDOW else 0.0
        if i >= WINDOW:
            gone = s[i - WINDOW]
            m = counts[gone]
            counts[gone] = m - 1
            kinds[_class(gone)] -= 1
            n_free -= free[i - WINDOW] if free else 0
            total += _TERM[m - 1] - _TERM[m] if m <= WINDOW else 0.0
        if i >= WINDOW - 1 and 2 * n_free < WINDOW:
            limit = limits[2 if kinds[2] else 1 if kinds[1] else 0]
            if -total >= limit - 1e-9:
                at = i - WINDOW + 1
                if out and at <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((at, i + 1))
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(x.encode() in low for x in _NAMES):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"h" * 16 in raw.translate(_HEX_BYTES):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if b"h" * WINDOW in raw.translate(_TOKEN_BYTES):
        for m in _CANDIDATE.finditer(text):
            free = allowed(m[0])
            if 0 in free:
                found += [("entropy", m.start() + a, m.start() + b) for a, b in high_windows(m[0], free)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches):
    for b in rows(batches):
        out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _TYPE)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of docs (doc_id, text)."""
    d = docs.selectExpr("doc_id", "cast(text as string) as text")
    return d.mapInArrow(_scan, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """text with every joined span replaced by mark."""
    found = spans(text)
    if not found:
        return text
    out, done, at = [], 0, None
    for _, s, e in [*found, ("", len(text), len(text))]:
        if at and s <= at[1]:
            at = (at[0], max(at[1], e))
            continue
        if at:
            out += [text[done : at[0]], mark]
            done = at[1]
        at = (s, e)
    if at and at[0] < at[1]:
        out += [text[done : at[0]], mark]
        done = at[1]
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced and n_chars, where there is one, counted anew. All rows and columns stay."""
    at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def change(batches):
        for b in rows(batches):
            old = b.column(at).to_pylist()
            new = [redacted(t) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if n is not None:
                cols[n] = pa.array([k if x is y or x == y else len(y) for x, y, k in zip(old, new, cols[n].to_pylist(), strict=True)], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(change, docs.schema)


def _digest(batches):
    for b in rows(batches):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
        for found in map(spans, b.column(1).to_pylist()):
            said = [(k, f"{k}:{s}:{e}") for k, s, e in found]
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for k, _ in said))
            out["base_sha256"].append(hashlib.sha256(",".join(x for k, x in said if k != "entropy").encode()).hexdigest())
            out["spans"].append(",".join(x for _, x in said))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items())], names=["doc_id", *out])


def digests(docs: DataFrame) -> DataFrame:
    """Like scan(), with the spans of a row as counts by kind, their text, and a digest of the fixed patterns'."""
    d = docs.selectExpr("doc_id", "cast(text as string) as text")
    return d.mapInArrow(_digest, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
