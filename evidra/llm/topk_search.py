"""Exact top-k search by inner product, in buckets of similar length.

A score is at most the product of two lengths, so vectors are put in order of length: quantiles of the
lengths cut them into BUCKETS, and hashes cut a bucket into blocks of about BLOCK rows, so that vectors of one length, copies
among them, fill as many blocks as they need. The SEED longest vectors give each query a score that K vectors
reach. A query goes to the buckets that are long enough to reach it; queries are cut in the same way by the length that they need, into
batches of about BATCH, and a block meets only batches that may find something in it.

A task works through pairs of a batch and a block, falling lengths first, RUN vectors at a time. The score to reach, over the lengths of query and
run, is a query's local cosine threshold. Above one, the run is passed over. Where the threshold is high enough to pay, as
some of the run's own queries show, coordinates prune: a vector within the angle of the threshold lies in an interval of each coordinate, which is
looked up in sorted order for the query's largest one, and FOCUS coordinates with what the others can add at most
bound the rest. Elsewhere length prunes. What is left is verified by integer products.

Everything is exact: bounds are loosened by more than rounding can take, equal scores are kept, and no row is dropped
otherwise. A task holds one batch, one run, and K results a query; blocks are read as a stream.

Defined results: components become floor(64 x), saturated at 64 bits. Vectors that are null or hold null or non-finite
components take no part; empty and zero vectors do. Only vectors of one number of dimensions meet. A query's own rows are all rows of its id;
other repeated rows count each, ties go to the smaller id, null ids last. Equal queries of one id are
answered once. Scores beyond 64 bits saturate. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import Scratch

K = 20
#: Longest vectors that give every query its first score to reach.
SEED = 1024
#: Quantiles of length, at most, and rows for which there is one.
BUCKETS, PER_BUCKET = 64, 4096
#: Rows of a block, queries of a batch, about, and vectors that a task compares at a time.
BLOCK, BATCH, RUN = 4096, 2048, 2048
#: Coordinates that bound a product before it is verified.
FOCUS = 8
#: Queries of a batch by which a run decides, and the part of its vectors that coordinates may leave.
ASKED, LEAVE = 8, 0.25
#: By how much bounds are loosened against rounding.
LOOSE = 1e-9


def scaled(e: Column) -> Column:
    """floor(64 x) for each component; null where the vector takes no part."""
    good = F.forall(e, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(good, F.transform(e, lambda c: F.floor(c.cast("double") * 64)))


def length(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of the rows of p with those of q, exact up to 64 bits and saturated beyond."""
    a, b = p.astype(float), q.astype(float)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, p.shape[1])
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return p @ q.T
    return np.clip(p.astype(object) @ q.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The K best (score, id) of each query so far, and the score that a vector must reach."""

    def __init__(self, reach: np.ndarray, k: int):
        self.k, self.reach = k, reach.astype(float)
        self.found: list = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(reach)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.reach[i] - LOOSE * (1 + abs(self.reach[i])) if math.isfinite(self.reach[i]) else np.ones(len(scores), bool)
        if not good.any():
            return
        s, v, z = (np.concatenate((a, b[good])) for a, b in zip(self.found[i], (scores, ids, nulls), strict=True))
        top = np.lexsort((v, z, -s))[: self.k]
        self.found[i] = s[top], v[top], z[top]
        if len(top) == self.k:
            self.reach[i] = max(self.reach[i], float(s[top[-1]]))


class Run:
    """Vectors of similar length, the longest first."""

    def __init__(self, x: np.ndarray, size: np.ndarray, ids: np.ndarray, nulls: np.ndarray):
        self.x, self.size, self.ids, self.nulls = x, size, ids, nulls
        self.unit = x / np.maximum(size, 1e-300)[:, None]
        self.order: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.order:
            at = np.argsort(self.unit[:, f], kind="stable")
            self.order[f] = at, self.unit[at, f]
        return self.order[f]

    def by_coordinates(self, u: np.ndarray, focus: np.ndarray, local: float, least: np.ndarray) -> np.ndarray:
        """Rows whose cosine with the unit vector u may be least (of each row), given that least is nowhere under local."""
        f = int(focus[0])
        a, b = math.acos(min(1.0, max(-1.0, local))), math.acos(min(1.0, max(-1.0, float(u[f]))))
        at, values = self.sorted(f)
        low = -1.0 if a + b >= math.pi else math.cos(a + b)
        high = 1.0 if b <= a else math.cos(b - a)
        within = at[np.searchsorted(values, low - 1e-7) : np.searchsorted(values, high + 1e-7, "right")]
        part = self.unit[np.ix_(within, focus)]
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", part, part)))
        most = part @ u[focus] + rest * math.sqrt(max(0.0, 1.0 - float(u[focus] @ u[focus])))
        return within[most >= least[within] - 1e-7]

    def search(self, q: np.ndarray, sizes: np.ndarray, qids: np.ndarray, best: Best) -> None:
        if not len(self.x) or not len(q):
            return
        reach = best.reach - LOOSE * (1 + np.abs(np.where(np.isfinite(best.reach), best.reach, 0)))
        top = sizes * self.size[0]
        # Over nothing: a score of zero is reached by all or by none.
        local = np.where(top > 0, reach / np.where(top > 0, top, 1), np.where(reach <= 0, -np.inf, np.inf))
        active = np.flatnonzero(local <= 1 + LOOSE)
        units = q / np.maximum(sizes, 1e-300)[:, None]
        n = min(FOCUS, q.shape[1])
        focus = np.argsort(-np.abs(units), axis=1, kind="stable")[:, :n]

        def pruned(i):
            return self.by_coordinates(units[i], focus[i], local[i], reach[i] / np.maximum(sizes[i] * self.size, 1e-300))

        may = active[(local[active] > 0) & (n > 0)]
        cut = np.inf
        if len(may):
            may = may[np.argsort(local[may], kind="stable")]
            for i in may[np.unique(np.linspace(0, len(may) - 1, ASKED).astype(int))]:
                if len(pruned(i)) <= LEAVE * len(self.x):
                    cut = local[i]
                    break
        coordinate = local[active] >= cut
        for i in active[coordinate]:
            at = pruned(i)
            at = at[(self.ids[at] != qids[i]) | self.nulls[at]]
            if len(at):
                best.add(i, products(self.x[at], q[i : i + 1])[:, 0], self.ids[at], self.nulls[at])
        rest = active[~coordinate]
        if len(rest):
            # The rows long enough come first.
            need = np.where(reach[rest] > 0, reach[rest] / np.maximum(sizes[rest], 1e-300) * (1 - LOOSE), -np.inf)
            until = np.searchsorted(-self.size, -need, "right")
            scores = products(self.x[: until.max()], q[rest])
            for j, i in enumerate(rest):
                other = np.flatnonzero((self.ids[: until[j]] != qids[i]) | self.nulls[: until[j]])
                best.add(i, scores[other, j], self.ids[other], self.nulls[other])


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def _first_reach(seeds: pa.Table, k: int):
    """Adds to queries (query, vec_id, x, size) the score that k of the seeds reach."""
    runs: dict[int, Run] = {}
    dims = np.array([len(v) for v in seeds.column("x").to_pylist()], int)
    for d in np.unique(dims):
        t = seeds.filter(pa.array(dims == d)).combine_chunks()
        if t.num_rows > k:
            runs[int(d)] = Run(_vectors(t.column("x").combine_chunks()), t.column("size").to_numpy(), *_ids(t.column("vec_id").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, RUN):
                b = whole.slice(start, RUN)
                lengths = np.array(b.column("x").value_lengths())
                reach = np.full(b.num_rows, -np.inf)
                for d in np.unique(lengths):
                    if int(d) in runs:
                        at = np.flatnonzero(lengths == d)
                        s = b.take(pa.array(at))
                        best = Best(reach[at], k)
                        runs[int(d)].search(_vectors(s.column("x")), s.column("size").to_numpy(), s.column("vec_id").to_numpy(), best)
                        reach[at] = best.reach
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reach)], names=[*b.schema.names, "reach"])

    return run


FOUND = "query long, query_id long, vec_id long, score long"


def _cells(k: int):
    """Searches sorted rows (batch, block, dims, candidate, size, query, vec_id, x, reach): a cell's queries come before its vectors."""
    form = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def told(keys, qids, best):
        n = [len(f[0]) for f in best.found]
        scores, ids, nulls = (np.concatenate([f[j] for f in best.found]) for j in range(3))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(np.repeat(qids, n)), pa.array(ids, mask=nulls), pa.array(scores)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, state = None, [], None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("batch", "block", "dims", "candidate")], axis=1)
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)]) if len(marks) else []
            for s, e in zip(starts, [*starts[1:], len(marks)], strict=True):
                key, is_candidate = tuple(marks[s][:3]), bool(marks[s][3])
                if key != cell:
                    if state:
                        yield told(state[0], state[2], state[3])
                    cell, asking, state = key, [], None
                if not is_candidate:
                    asking.append(b.slice(s, e - s))
                    continue
                if state is None and asking:
                    t = pa.Table.from_batches(asking).combine_chunks()
                    col = lambda c: t.column(c).combine_chunks()
                    state = col("query").to_numpy(), _vectors(col("x")), col("vec_id").to_numpy(), Best(col("reach").to_numpy(), k), col("size").to_numpy()
                    asking = []
                if state is None:
                    continue  # nothing asks here
                for i in range(s, e, RUN):
                    c = b.slice(i, min(RUN, e - i))
                    Run(_vectors(c.column("x")), c.column("size").to_numpy(), *_ids(c.column("vec_id"))).search(state[1], state[4], state[2], state[3])
        if state:
            yield told(state[0], state[2], state[3])

    return run


def _cuts(sizes: DataFrame, n: int) -> list[float]:
    """At most n - 1 falling bounds between n quantiles of the column size."""
    if n < 2:
        return []
    got = sizes.agg(F.percentile_approx("size", [i / n for i in range(1, n)], 10_000).alias("cuts")).first().cuts or []
    return sorted(set(got), reverse=True)


def _among(value: Column, bounds: list[float]) -> Column:
    """How many of the falling bounds are above the value: its bucket, the longest being 0."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > value))


def _numbered(rows: DataFrame, group: str, size: str, per: int, n: int) -> tuple[list[int], list[int], list[float], list[float]]:
    """(parts, parts before, smallest size, largest size) of n groups; a group has a part for about per rows. Empty groups have none."""
    got = {r[group]: r for r in rows.groupBy(group).agg(F.count("*").alias("n"), F.min(size).alias("low"), F.max(size).alias("high")).collect()}
    parts = [math.ceil(got[i].n / per) if i in got else 0 for i in range(n)]
    return parts, [sum(parts[:i]) for i in range(n)], [got[i].low if i in got else math.inf for i in range(n)], [got[i].high if i in got else -math.inf for i in range(n)]


def _at(values: list, i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i)


def top_k(vectors: DataFrame, asked: Column, k: int = K, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each row of vectors (vec_id, embedding) for which asked holds.

    asked: a condition on the columns of vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    x = scaled(F.col("embedding"))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(asked, F.lit(False)).alias("asked")).where("x is not null")
    v = scratch.store(v.withColumn("size", length(F.col("x"))).withColumn("mark", F.xxhash64("vec_id", "x")), "vectors")
    # A bounded number of rows, and a bucket of its own for each query.
    seeds = v.orderBy(F.desc("size"), "vec_id", "mark").select("vec_id", "x", "size").limit(SEED).toArrow()
    asks = v.where("asked and vec_id is not null").groupBy("vec_id", "x").agg(F.first("size").alias("size"), F.first("mark").alias("query"))
    asks = asks.select("query", "vec_id", "x", "size").mapInArrow(_first_reach(seeds, k), "query long, vec_id long, x array<long>, size double, reach double")
    # The length that a vector must have: with nothing to reach, any.
    need = F.when(F.col("reach") > 0, F.col("reach") * (1 - 4 * LOOSE) / F.greatest("size", F.lit(1e-300))).otherwise(0.0)
    asks = scratch.store(asks.withColumn("need", need), "queries")

    rows, queries = v.count(), asks.count()
    bounds = _cuts(v, min(BUCKETS, max(1, math.ceil(rows / PER_BUCKET))))
    placed = v.withColumn("bucket", _among(F.col("size"), bounds))
    blocks, first_block, _, longest = _numbered(placed, "bucket", "size", block, len(bounds) + 1)
    ask_bounds = _cuts(asks.select(F.col("need").alias("size")), min(BUCKETS, max(1, math.ceil(queries / batch))))
    # Those that need least come first: they meet most blocks.
    n_groups = len(ask_bounds) + 1
    grouped = asks.withColumn("group", F.lit(n_groups - 1) - _among(F.col("need"), ask_bounds))
    batches, first_batch, least, _ = _numbered(grouped, "group", "need", batch, n_groups)

    # A bucket meets the batches of all groups that have a query which it is long enough for: a prefix of the batches.
    meets = [max([first_batch[g] + batches[g] for g in range(n_groups) if batches[g] and least[g] <= longest[b]], default=0) for b in range(len(blocks))]
    place = F.col("bucket")
    block_of = _at(first_block, place) + F.pmod(F.col("mark"), _at(blocks, place)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = F.lit(None)
    compared = placed.withColumn("meets", _at(meets, place)).where("meets > 0").select(
        upto(F.col("meets")).alias("batch"), block_of.alias("block"), F.size("x").alias("dims"), F.lit(1).alias("candidate"), "size", none.cast("long").alias("query"), "vec_id", "x", none.cast("double").alias("reach")
    )
    # A query goes to all blocks of the buckets that are long enough, which are the first ones.
    ends = [(longest[b], first_block[b] + blocks[b]) for b in range(len(blocks)) if blocks[b]]
    last = F.greatest(F.lit(0), F.lit(0), *(F.when(F.col("need") <= F.lit(top), F.lit(end)).otherwise(0) for top, end in ends))
    batch_of = _at(first_batch, F.col("group")) + F.pmod(F.xxhash64("query"), _at(batches, F.col("group"))).cast("int")
    asking = grouped.withColumn("last", last).where("last > 0").select(
        batch_of.alias("batch"), upto(F.col("last")).alias("block"), F.size("x").alias("dims"), F.lit(0).alias("candidate"), "size", "query", "vec_id", "x", "reach"
    )
    cells = asking.unionByName(compared).repartition("batch", "block", "dims").sortWithinPartitions("batch", "block", "dims", "candidate", F.desc("size"), "vec_id")
    found = scratch.store(cells.mapInArrow(_cells(k), FOUND), "found")
    scratch.only(found)
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: All products of queries with rows; meant for small tables.
ORACLE = """
with vectors as (
  select vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
),
scores as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(cast(q.x as double[]), cast(v.x as double[])) as bigint) as score
  from (select * from vectors where vec_id % 20 = 0) q join vectors v on q.vec_id <> v.vec_id and len(q.x) = len(v.x)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scores qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
