"""Embedding whitening by hierarchical merging of singular value decompositions.

Components are floor(64 c) + 1,000,000. The model is fitted to each distinct vector once. A partition
takes its vectors CHUNK at a time: a chunk, less its own mean, is decomposed, and what is kept of it are the number of vectors, their exact
sums, and all singular values and right vectors. Two such states merge into one by stacking both with one more row, the
difference of the means weighted by sqrt(n m / (n + m)), and decomposing the stack again. No dimension is dropped on the way,
so the merged state is the decomposition of all vectors less their common mean. Partitions' states are merged FAN at a time,
level by level, in tables in the shared folder; the last merge keeps the mean, the trace and the first COMPONENTS vectors.

Sums are integers of any size, so means and deviations do not round. A state takes the square of the number of dimensions,
whatever the number of rows; a group of equal vectors is one row after partial aggregation.

identity_error comes from a second pass over the fitted vectors: their whitened coordinates are centred and multiplied partition
by partition, and the sums merged.

Defined results: vectors that are null or hold null or non-finite components have no rows. Every number of dimensions has a model of its
own, with its own n and identity_error; more than LENGTHS of them raise. Components without variance (singular values up to RANK of the largest)
are left out, so that a table of one distinct vector, or of empty ones, gives no rows. Of either sign of a component the one is taken whose largest
entry is positive. Repeated rows and null ids are rows like others. Components of 64 bits and more saturate; a deviation of more
than 64 bits is null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import Scratch, rows

COMPONENTS = 16
#: Vectors that a partition decomposes at a time, and states that one task merges.
CHUNK, FAN = 4096, 8
#: Part of the largest singular value under which a direction has no variance.
RANK = 1e-10
#: Numbers of dimensions at most; the driver holds a model of COMPONENTS vectors for each.
LENGTHS = 100

SCALE, SHIFT = 64, 1_000_000


def shifted(e: Column) -> Column:
    """floor(64 c) + 1,000,000 for each component; null where the vector takes no part."""
    good = F.forall(e, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    # At most 2**63 - 1 after the shift.
    return F.when(good, F.transform(e, lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit(2**63 - 1 - SHIFT)) + SHIFT))


@dataclass
class State:
    """n vectors: their sums, as integers, and rows r with r' r the sum of products of what differs from the mean."""

    n: int
    sums: list[int]
    r: np.ndarray


def spread(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: integers of 64 bits where they hold it, else of any size."""
    most = max(max((abs(int(f(x))) for f in (np.min, np.max)), default=0) if x.size else 0, 1)
    if n * most + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def decomposed(r: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as few rows as have the same products, all dimensions kept."""
    if not r.size:
        return r[:0]
    _, s, v = np.linalg.svd(r, full_matrices=False)
    return s[:, None] * v


def of_chunk(x: np.ndarray) -> State:
    n = len(x)
    big = x.size and max(abs(int(x.min())), abs(int(x.max()))) * n >= 2**62
    sums = [int(s) for s in (x.astype(object) if big else x).sum(axis=0)]
    return State(n, sums, decomposed(spread(x, n, sums).astype(float) / n))


def merged(a: State, b: State) -> State:
    """The state of the vectors of both."""
    n = a.n + b.n
    gap = np.array([float(p * b.n - q * a.n) for p, q in zip(a.sums, b.sums, strict=True)]) / (float(a.n) * b.n)
    correction = np.sqrt(float(a.n) * b.n / n) * gap
    return State(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], decomposed(np.vstack([a.r, b.r, correction[None, :]])))


def all_merged(states: Iterable[State]) -> State | None:
    out = None
    for s in states:
        out = s if out is None else merged(out, s)
    return out


STATE = "dims int, leaf long, n long, sums array<decimal(38,0)>, r binary"
_FORM = pa.schema([("dims", pa.int32()), ("leaf", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("r", pa.binary())])


def _row(dims: int, leaf: int, s: State) -> dict:
    return {"dims": dims, "leaf": leaf, "n": s.n, "sums": [Decimal(v) for v in s.sums], "r": s.r.tobytes()}


def _state(dims: int, n: int, sums: list, r: bytes) -> State:
    return State(n, [int(v) for v in sums], np.frombuffer(r).reshape(-1, dims) if dims else np.zeros((0, 0)))


def _by_length(b: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, places, vectors) of a batch's column of vectors."""
    lengths = np.array(b.column(name).value_lengths(), np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        flat = b.column(name).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield int(d), at, flat.astype(np.int64).reshape(len(at), int(d))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A state for each number of dimensions in a partition."""
    from pyspark import TaskContext

    leaf, states, held = TaskContext.get().partitionId(), {}, {}

    def absorb(d):
        s = of_chunk(np.vstack(held.pop(d)))
        states[d] = merged(states[d], s) if d in states else s

    for b in batches:
        for d, _, x in (y for part in rows([b], CHUNK) for y in _by_length(part, "x")):
            held.setdefault(d, []).append(x)
            if sum(map(len, held[d])) >= CHUNK:
                absorb(d)
    for d in list(held):
        absorb(d)
    for d, s in states.items():
        yield pa.RecordBatch.from_pylist([_row(d, leaf, s)], schema=_FORM)


def _merge(t: pa.Table) -> pa.Table:
    got = t.sort_by("leaf").to_pylist()
    dims = got[0]["dims"]
    s = all_merged(_state(dims, g["n"], g["sums"], g["r"]) for g in got)
    return pa.Table.from_pylist([_row(dims, got[0]["leaf"] // FAN, s)], schema=_FORM)


def fitted(fit: DataFrame, scratch: Scratch) -> DataFrame:
    """One merged state for each number of dimensions of the vectors in fit (x), by levels of FAN."""
    states = scratch.store(fit.mapInArrow(_leaves, STATE), "states")
    while (left := states.groupBy("dims").count().agg(F.max("count")).first()[0] or 0) > 1:
        # Leaves are numbered closely, whatever partitions they come from.
        ranked = states.withColumn("leaf", F.col("leaf") if left > FAN else F.lit(0).cast("long"))
        after = scratch.store(ranked.groupBy("dims", F.floor(F.col("leaf") / FAN).alias("to")).applyInArrow(lambda key, t: _merge(t), STATE), "states")
        scratch.drop(states)
        states = after
    return states


@dataclass
class Model:
    """What whitens: number of vectors, their sums, unit components (dims x k), standard deviations, shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - sums, coordinates on the components over their standard deviations)."""
        gap = spread(x, self.n, self.sums)
        return gap, gap.astype(float) / self.n @ self.axes / self.deviations


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, n, sums, axes, deviations, explained) of whole states; none where there is no variance."""
    form = pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("axes", pa.binary()), ("deviations", pa.list_(pa.float64())), ("explained", pa.list_(pa.float64()))])
    for b in batches:
        for g in b.to_pylist():
            s = _state(g["dims"], g["n"], g["sums"], g["r"])
            if not s.r.size:
                continue
            _, size, v = np.linalg.svd(s.r, full_matrices=False)
            k = min(COMPONENTS, int((size > RANK * size[0]).sum()))
            if not k:
                continue
            v = v[:k]
            v = v * np.where(v[np.arange(k), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
            e = size * size / s.n
            row = {"dims": g["dims"], "n": s.n, "sums": g["sums"], "axes": np.ascontiguousarray(v.T).tobytes(), "deviations": np.sqrt(e[:k]).tolist(), "explained": (e[:k] / e.sum()).tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=form)


def _moments(models: dict[int, Model]):
    """(dims, i, j, n, a, b, c) of a partition's whitened vectors: means of coordinates i and j, and their sum of products about them."""
    form = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64())])

    def run(batches):
        for b in (y for x in batches for y in rows([x], CHUNK)):
            for d, _, x in _by_length(b, "x"):
                if d in models:
                    w = models[d].whitened(x)[1]
                    mean = w.mean(axis=0)
                    c = (w - mean).T @ (w - mean)
                    i, j = np.triu_indices(len(mean))
                    full = lambda v, kind: pa.array(np.full(len(i), v), kind)
                    yield pa.RecordBatch.from_arrays([full(d, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), full(len(w), pa.int64()), pa.array(mean[i]), pa.array(mean[j]), pa.array(c[i, j])], schema=form)

    return run


def models_of(vectors: DataFrame, scratch: Scratch) -> dict[int, Model]:
    """Models by number of dimensions, fitted to each distinct vector of the column x once."""
    fit = scratch.store(vectors.select("x").distinct(), "fit")
    states = fitted(fit, scratch)
    if states.count() > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different numbers of dimensions")
    kept = states.mapInArrow(_finish, "dims int, n long, sums array<decimal(38,0)>, axes binary, deviations array<double>, explained array<double>").collect()
    models = {m.dims: Model(m.n, [int(s) for s in m.sums], np.frombuffer(bytes(m.axes)).reshape(m.dims, -1), np.array(m.deviations), np.array(m.explained)) for m in kept}
    part = fit.mapInArrow(_moments(models), "dims int, i int, j int, n long, a double, b double, c double")
    n = F.sum("n").cast("double")
    mean_a, mean_b = F.sum(F.col("n") * F.col("a")) / n, F.sum(F.col("n") * F.col("b")) / n
    covariance = (F.sum("c") + F.sum(F.col("n") * F.col("a") * F.col("b"))) / n - mean_a * mean_b
    error = part.groupBy("dims", "i", "j").agg(covariance.alias("v")).groupBy("dims").agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("error"))
    for r in error.collect():
        models[r.dims].identity_error = r.error
    return models


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _squares(gap: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, null beyond 64 bits."""
    if gap.dtype != object and float(np.abs(gap).max(initial=0)) ** 2 * max(1, gap.shape[1]) < 2**62:
        return np.einsum("ij,ij->i", gap, gap).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in g) for g in gap)]


def _projected(models: dict[int, Model]):
    names = ["vec_id", *(c.split()[0] for c in OUT.split(", "))]

    def run(batches):
        for b in (y for x in batches for y in rows([x], CHUNK)):
            for d, at, x in _by_length(b, "x"):
                if d not in models:
                    continue
                m = models[d]
                gap, w = m.whitened(x)
                k, of = w.shape[1], np.repeat(np.arange(len(x)), w.shape[1])
                told = [
                    b.column("vec_id").take(pa.array(at[of])),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(of), m.n), pa.int64()),
                    pa.array(_squares(gap), pa.int64()).take(pa.array(of)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(m.explained, len(x))),
                    pa.array(np.full(len(of), m.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(told, names=names)

    return run


def whiten(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row of vectors (vec_id, embedding) and component."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    v = vectors.select("vec_id", shifted(F.col("embedding")).alias("x")).where("x is not null")
    models = models_of(v, scratch)
    scratch.only()
    return v.mapInArrow(_projected(models), f"vec_id {v.schema['vec_id'].dataType.simpleString()}, {OUT}")


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
