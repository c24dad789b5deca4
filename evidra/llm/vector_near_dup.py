"""Embedding near-duplicates by iterative quantisation, multi-index Hamming tables and exact reranking.

On a bounded sample, rotations of the centred principal components are learnt so that the signs of the
rotated coordinates are balanced binary codes. Codes are cut into substrings of about log2(n) bits, one
for each table. Every vector is stored in each table under its substring and looked up under the substrings
within one bit of its own; of several tables that meet, only the first yields the pair, and pairs far
apart in full Hamming distance are left out. What remains is compared by cosine on the
original vectors in double precision. Only vectors of one label are compared.

How many tables that takes depends on the width and on the data: at cosine 0.93 a bit differs with
probability 0.12 only if the vectors have no common direction, and more often the stronger that is.
So partners at the threshold are made for vectors of the sample, and tables are added until RECALL of
them meet; the full distance allowed is the largest among them. Where MOST tables are not enough, the
substring gets shorter, which costs comparisons instead of links. Tests measure recall against brute force.

Substrings that CROWD vectors or more share are not joined vector by vector: their vectors are dealt into blocks of about BLOCK by hash, and
blocks of equal or neighbouring substrings are compared by matrix products. What comes out is the number of links of each vector and
a spanning forest, so a group of near copies costs multiplications, not rows.

Vectors have a model by their length; those of lengths with too few vectors in the sample get random projections of
as many tables. Only vectors of one length are compared.

Equal vectors of one label form a class, a node of the graph, of which one is compared; links are counted for all.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors
without label or id, link with nothing. Ids and labels may be of any type that has an order. Repeated rows, and different
vectors under one id, are other vectors with links of their own; what any of them reaches is reached by the id.
Without an id, component_id is null and the row is kept. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import Scratch, reached, rows

#: Vectors that the rotations are learnt from: the usable ones with the smallest hashed ids.
SAMPLE = 10_000
#: Vectors of one length, other than the most common one, that a model of their own takes.
OWN = 500
#: Tables at least, and at most.
TABLES, MOST = 8, 64
#: Part of the partners at the threshold that must meet, and the partners made of each kind.
RECALL, PARTNERS = 0.993, 6000
#: A sample of so many vectors is divided into some to learn from and some to measure on.
HELD = 4000
#: Up to so many tables the conditions on a pair are written out for compiled code.
WRITTEN = 16
#: Vectors of a substring from which on it is compared in blocks, and vectors of a block, about.
CROWD, BLOCK = 64, 256
ROTATIONS_STEPS = 40
COSINE = 0.93


def rotations(x: np.ndarray, seed: int = 1):
    """(mean, learnt rotations, each of shape dims x dims, without end)."""
    mean = x.mean(axis=0)
    v = x - mean
    size, axes = np.linalg.eigh(v.T @ v)
    axes = axes[:, np.argsort(-size)]
    v = v @ axes

    def each():
        c, rng = x.shape[1], np.random.default_rng(seed)
        while True:
            r = np.linalg.qr(rng.standard_normal((c, c)))[0]
            for _ in range(ROTATIONS_STEPS):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = w.T @ u.T
            yield axes @ r

    return mean, each()


def partners(x: np.ndarray, cosine: float, n: int = PARTNERS, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors at just this cosine: away from a vector of x at random, and towards another one of x."""
    rng, u = np.random.default_rng(seed), np.unique(x, axis=0)
    a, out = u[rng.permutation(np.resize(rng.permutation(len(u)), n))], []
    for away in (rng.standard_normal(a.shape), u[rng.integers(0, len(u), n)]):
        e = away - np.einsum("ij,ij->i", away, a)[:, None] * a
        size = np.linalg.norm(e, axis=1)
        good = size > 1e-6
        if good.any():
            out.append((a[good], cosine * a[good] + math.sqrt(max(0.0, 1 - cosine * cosine)) * e[good] / size[good, None]))
    return out


def fitted(x: np.ndarray, width: int, cosine: float, least: int = TABLES) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(mean, projection of shape dims x bits, width, largest full distance), with as many tables as RECALL takes, least at least."""
    # Rotations keep away from the vectors they are learnt from, so others are measured.
    held = len(x) // 4 if len(x) >= HELD else 0
    mean, each = rotations(x[held:])
    turn, kinds = np.empty((x.shape[1], 0)), partners(x[:held] if held else x, cosine)
    signs = [np.empty((len(a), 0), bool) for a, _ in kinds]
    while True:
        met, apart = [np.zeros(len(s), bool) for s in signs], [np.zeros(len(s), int) for s in signs]
        for t in range(MOST):
            while turn.shape[1] < (t + 1) * width:
                turn = np.hstack([turn, r := next(each)])
                signs = [np.hstack([s, ((a - mean) @ r >= 0) != ((b - mean) @ r >= 0)]) for s, (a, b) in zip(signs, kinds, strict=True)]
            for k, s in enumerate(signs):
                differ = s[:, t * width : (t + 1) * width].sum(axis=1)
                met[k] |= differ <= 1
                apart[k] += differ
            if t + 1 >= least and all(m.mean() >= RECALL for m in met):
                bits = (t + 1) * width
                p = math.acos(min(1.0, cosine)) / math.pi
                far = math.ceil(bits * (p + 6 * math.sqrt(p * (1 - p) / (bits / 2))))
                return mean, turn[:, :bits], width, max([far, *(int(d.max()) for d in apart)])
        width -= 1  # at one bit everything meets


def usable(e):
    """Whether a column of vectors holds one that has a direction."""
    return F.coalesce((F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0), F.lit(False))


def learn(vectors: DataFrame, width: int, cosine: float = COSINE, sample: int = SAMPLE) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], int, int, int] | None:
    """({length: (mean, projection)}, tables, width, largest full distance) from a bounded sample; None without usable vectors."""
    got = vectors.where(usable(F.col("embedding"))).orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).toArrow()
    by_length: dict[int, list] = {}
    for e in got.column(0).to_pylist():
        x = np.array(e, float)
        x = x / np.abs(x).max()
        by_length.setdefault(len(x), []).append(x / np.linalg.norm(x))
    if not by_length:
        return None
    most = max(by_length, key=lambda n: (len(by_length[n]), -n))
    own = {n: np.stack(x) for n, x in by_length.items() if n == most or len(x) >= OWN}
    tables, models, far = TABLES, {}, 0
    while len(models) < len(own):
        models, far = {}, 0
        for n, x in own.items():
            mean, turn, w, apart = fitted(x, width, cosine, tables)
            if models and (w < width or turn.shape[1] // w > tables):
                models = {}
            width, tables = w, turn.shape[1] // w
            models[n], far = (mean, turn), max(far, apart)
    return models, tables, width, far


@lru_cache(maxsize=8)
def projection(length: int, bits: int, start: int, end: int) -> np.ndarray:
    """Rows start to end of a fixed random projection."""
    return np.random.default_rng([length, start]).standard_normal((end - start, bits))


def signs(x: np.ndarray, models: dict, bits: int) -> np.ndarray:
    """Code bits of unit vectors of one length."""
    n = x.shape[1]
    if n in models:
        mean, turn = models[n]
        return (x - mean) @ turn >= 0
    return sum(x[:, a : a + 4096] @ projection(n, bits, a, min(n, a + 4096)) for a in range(0, n, 4096)) >= 0


def unit(e: list | None) -> np.ndarray | None:
    if not e or any(c is None for c in e):
        return None
    x = np.array(e, float)
    top = np.abs(x).max()
    if not np.isfinite(top) or not np.isfinite(x).all() or not top:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _coder(models: dict, tables: int, width: int):
    weights = 1 << np.arange(width)

    def code(batches):
        for b in rows(batches, 2000):
            raw = b.column(2).to_pylist()
            units = [unit(e) for e in raw]
            lengths = np.array([0 if u is None else len(u) for u in units])
            codes: list = [None] * len(units)
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                bits = signs(np.stack([units[i] for i in at]), models, tables * width)
                for i, c in zip(at, bits.reshape(len(at), -1, width) @ weights, strict=True):
                    codes[i] = c.astype(np.int32)
            same = [None if u is None else xxhash.xxh3_128_digest(np.array(e, float).tobytes()) for u, e in zip(units, raw, strict=True)]
            cols = [pa.array(lengths, pa.int32()), pa.array(same, pa.binary()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary()), pa.array(codes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["vec_id", "label", "dims", "same", "unit", "codes"])

    return code


def _reranked(least: float):
    def rerank(batches):
        for b in rows(batches, 5000):
            x, y = (b.column(i).to_pylist() for i in (2, 3))
            size, cosine = np.array([len(v) for v in x]), np.empty(len(x))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                u, v = (np.frombuffer(b"".join(z[i] for i in at)).reshape(len(at), -1) for z in (x, y))
                cosine[at] = np.einsum("ij,ij->i", u, v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(cosine >= least, pa.bool_()))

    return rerank


def linked_block(t: int, same: bool, x, y, sizes, codes, far: int, least: float):
    """(links of each vector of x and of y, weighted by the other's size; (i, root) pairs that span what links connect).

    x, y: unit vectors of two blocks, or one twice (same); sizes, codes: pairs of arrays for both. Only pairs that no table
    before t yields count. Roots and i are places in x and then y.
    """
    near = np.ones((len(x), len(y)), bool)
    total = np.zeros((len(x), len(y)), np.int64)
    for k in range(codes[0].shape[1]):
        apart = np.bitwise_count(codes[0][:, k][:, None] ^ codes[1][:, k][None, :])
        total += apart
        if k < t:
            near &= apart > 1
        elif k == t:
            near &= apart <= 1
    near &= (total <= far) & (x @ y.T >= least)
    if same:
        np.fill_diagonal(near, False)
        root = np.arange(len(x))
        while True:
            low = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1, initial=len(x)))
            if (low == root).all():
                break
            root = low
        return near @ sizes[1], None, [(i, int(r)) for i, r in enumerate(root) if r != i]
    m, n = len(x), len(y)
    left, right = np.arange(m), np.arange(m, m + n)
    while True:
        a = np.minimum(left, np.where(near, right[None, :], m + n).min(axis=1, initial=m + n))
        b = np.minimum(right, np.where(near, a[:, None], m + n).min(axis=0, initial=m + n))
        if (a == left).all() and (b == right).all():
            break
        left, right = a, b
    span = [(i, int(r)) for i, r in enumerate(np.concatenate((left, right))) if r != i]
    return near @ sizes[1], sizes[0] @ near, span


def _products(far: int, least: float):
    form = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("others", pa.int64())])

    def run(batches):
        for batch in rows(batches, 4):
            for r in batch.to_pylist():
                same = r["x"]["bid"] == r["y"]["bid"]
                blocks = [(np.array(z["nodes"]), np.array(z["sizes"]), np.array(z["codes"], np.uint32).reshape(len(z["nodes"]), -1), np.frombuffer(b"".join(z["units"])).reshape(len(z["nodes"]), -1)) for z in (r["x"], r["y"])]
                (node_x, size_x, code_x, unit_x), (node_y, size_y, code_y, unit_y) = blocks
                of_x, of_y, span = linked_block(r["t"], same, unit_x, unit_y, (size_x, size_y), (code_x, code_y), far, least)
                nodes = node_x if same else np.concatenate((node_x, node_y))
                told = [(node_x, of_x)] + ([] if same else [(node_y, of_y)])
                out = [(int(v), None, int(k)) for ids, counts in told for v, k in zip(ids, counts, strict=True) if k]
                out += [(int(nodes[i]), int(nodes[k]), 0) for i, k in span]
                yield pa.RecordBatch.from_pylist([dict(zip(form.names, x, strict=True)) for x in out], schema=form)

    return run


def _crowded(scratch: Scratch, nodes: DataFrame, cells: DataFrame, crowds: DataFrame, width: int, far: int, cosine: float) -> DataFrame:
    """(a, b, others) from the blocks of crowded cells: links of a where b is null, else a and b are connected."""
    cell = ["label", "dims", "t", "key"]
    member = cells.join(crowds, cell).withColumn("block", F.pmod(F.xxhash64("node", "t"), F.ceil(F.col("members") / BLOCK)))
    full = member.join(nodes.select("node", "n", "unit"), "node")
    one = F.collect_list(F.struct("node", "n", "codes", "unit")).alias("v")
    blocks = full.groupBy(*cell, "block").agg(one).withColumn("bid", F.monotonically_increasing_id())
    each = lambda f: F.transform("v", lambda x: x[f])
    packed = F.struct("bid", each("node").alias("nodes"), each("n").alias("sizes"), F.flatten(each("codes")).alias("codes"), each("unit").alias("units"))
    blocks = scratch.store(blocks.select(*cell, "bid", packed.alias("x")), "blocks")
    flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)))
    # Pairs are met by number, so blocks travel only to where they are compared.
    asking = blocks.select("label", "dims", "t", "bid", F.explode(F.concat(F.array("key"), flips)).alias("key"))
    met = asking.join(blocks.select(*cell, F.col("bid").alias("of")), cell).where("bid <= of").select("t", "bid", "of")
    both = met.join(blocks.select("bid", "x"), "bid").join(blocks.select(F.col("bid").alias("of"), F.col("x").alias("y")), "of")
    return scratch.store(both.select("t", "x", "y").mapInArrow(_products(far, cosine), "a long, b long, others long"), "products")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, width: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    width: bits of a substring; by default from the number of rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    width = width or min(24, max(6, math.ceil(math.log2(max(2, v.count())))))
    model = learn(v, width, cosine, sample)
    if model is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    models, tables, width, far = model
    kinds = [v.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    coded = f"vec_id {kinds[0]}, label {kinds[1]}, dims int, same binary, unit binary, codes array<int>"
    every = scratch.store(v.mapInArrow(_coder(models, tables, width), coded), "coded")
    whole = every.where("same is not null and label is not null and vec_id is not null")
    # The numbers of classes hold once they are written; all members have the same vector.
    classes = whole.groupBy("label", "same").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("dims").alias("dims"), F.first("unit").alias("unit"), F.first("codes").alias("codes"))
    nodes = scratch.store(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    cells = nodes.select("node", "label", "dims", "codes", F.posexplode("codes").alias("t", "key"))
    near = F.explode(F.concat(F.array("key"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i)))))
    crowds = cells.groupBy("label", "dims", "t", "key").agg(F.count("*").alias("members")).where(F.col("members") >= CROWD)
    crowds = scratch.store(crowds, "crowds")
    products = None
    if not crowds.isEmpty():
        products = _crowded(scratch, nodes, cells, crowds, width, far, cosine)
        cells = cells.join(crowds.withColumnRenamed("members", "crowd"), ["label", "dims", "t", "key"], "left").withColumn("crowd", F.col("crowd").isNotNull())
        cells = scratch.store(cells, "cells")
    else:
        cells = cells.withColumn("crowd", F.lit(False))
    # Vectors of crowded cells are found by those of others, and by each other in blocks.
    probes = cells.where("not crowd").select("node", "label", "dims", "codes", "t", near.alias("key"))
    if tables <= WRITTEN:
        apart = [f"bit_count(a.codes[{j}] ^ b.codes[{j}])" for j in range(tables)]
        first = " and ".join(f"(a.t <= {j} or {x} > 1)" for j, x in enumerate(apart))
        total = " + ".join(apart)
    else:  # compiled code of this length would not be optimised by the JVM
        apart = "zip_with(a.codes, b.codes, (x, y) -> bit_count(x ^ y))"
        first = f"not exists(slice({apart}, 1, a.t), d -> d <= 1)"
        total = f"aggregate({apart}, 0, (s, d) -> s + d)"
    met = probes.alias("a").join(cells.alias("b"), F.expr(f"a.label = b.label and a.dims = b.dims and a.t = b.t and a.key = b.key and (b.crowd or a.node < b.node) and {total} <= {far} and {first}"))
    pairs = scratch.store(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "pairs")
    x = nodes.select(F.col("node").alias("a"), F.col("unit").alias("of_a"))
    y = nodes.select(F.col("node").alias("b"), F.col("unit").alias("of_b"))
    full = pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b")
    links = scratch.store(full.mapInArrow(_reranked(cosine), "a long, b long"), "links")
    sizes = nodes.select(F.col("node").alias("b"), "n")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(sizes, "b").select("a", F.col("n").alias("others"))
    if products is not None:
        counts = counts.union(products.where("b is null").select("a", "others"))
        links = links.union(products.where("b is not null").select("a", "b"))
    linked = counts.groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others"))
    counted = nodes.join(linked, "node", "left").select("node", "label", "same", "id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    owned = whole.select(F.col("vec_id").alias("id"), "label", "same").distinct().join(nodes.select("label", "same", "node"), ["label", "same"]).select("id", "node")
    told = scratch.store(reached(scratch, counted, links, owned).drop("node"), "told")
    scratch.only(every, told)
    out = every.select("vec_id", "label", "same").join(told, ["label", "same"], "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    n = F.when(F.col("vec_id").isNotNull(), F.col("n_links"))
    return out.select("vec_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The cosine of all pairs with one label, without codes; meant for small tables.
ORACLE = """
with recursive vectors as (
  select vec_id, label, cast(embedding as double[]) as e, embedding is not null and len(embedding) > 0 and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as usable from embeddings
),
good as (select * from vectors where usable),
links as (select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, met) as (select vec_id, vec_id from good union select r.node, l.y from reach r join links l on l.x = r.met),
component as (select node, min(met) as id from reach group by node),
counted as (select x, count(*) as n from links group by x)
select v.vec_id, cast(coalesce(c.n, 0) as bigint) as n_links, coalesce(p.id, v.vec_id) as component_id, coalesce(p.id, v.vec_id) = v.vec_id as kept
from vectors v left join counted c on c.x = v.vec_id left join component p on p.node = v.vec_id
"""
