"""MinHash near-duplicates by fast similarity sketching, banding and exact confirmation.

A document's sketch has T coordinates. Rounds 0..T-1 throw every shingle into a hashed bin, and a bin
keeps the smallest (round, hash) it has met; rounds T..2T-1 offer all shingles to the one bin that
belongs to the round. So every coordinate is filled after at most 2T rounds, mostly after one or two,
and agreement of two sketches is concentrated around the Jaccard similarity of the sets.

Coordinates are cut into BANDS of ROWS; at similarity 0.75 a pair shares no band with probability
(1 - 0.75**4)**32 < 1e-5. Documents with equal sets form one class, a node of the graph, and only one text of it is
compared. In a bucket, members are compared with one pivot at a time, which then leaves the bucket;
buckets whose members are all in one component are done. What remains after one round (rounds) is compared
across components by prefix filtering, which loses no pair, so no limit on bucket sizes is needed. Every link is
confirmed on the full shingle sets.

A hash that CROWD prefixes or more share is not joined with itself: its nodes are dealt into blocks of about BLOCK sets, or WEIGHT
hashes, and two blocks that meet in such a hash are compared once, set by set, in one row. What comes out are the links that connect
components, at most one a set, so rows grow with the blocks and not with the pairs; pairs that link with nothing are compared all the same.

Defined results: null or blank text has no shingles, links with nothing and is kept. A row without
doc_id links with nothing, has no component and is kept. Ids may be of any type that has an order. Where an id occurs with
several texts, all of them are compared, and what any of them reaches is reached by the id. Repeated rows
give repeated result rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import LOWER, Scratch, components, reached, rows

T, BANDS, ROWS = 128, 32, 4
SHINGLE = 5
#: Prefixes that share a hash from which on it is compared in blocks; sets of a block and their hashes, about.
CROWD, BLOCK, WEIGHT = 32, 128, 1 << 17
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift, twice)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TURNS = mix(np.arange(1001, 1001 + SHINGLE, dtype=_U)) | _U(1)
_BAND = mix(np.arange(5001, 5001 + T, dtype=_U)) | _U(1)
_BAND_SEED = mix(np.arange(9001, 9001 + BANDS, dtype=_U))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; fewer words than that: one hash for all of them."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = min(size, len(words))
    s = np.full(len(words) - n + 1, n, _U)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _TURNS[i]
    return np.unique(mix(s))


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates of a non-empty set of hashes; each is bin, round and hash in 7, 8 and 49 bits."""
    out, full = np.zeros(T, _U), np.zeros(T, bool)
    at, step = 0, max(1, min(T, -(-1000 // len(s))))
    while at < T and not full.all():
        g = mix(s[None, :] ^ _SEEDS[at : at + step, None])
        turn = np.arange(at, at + len(g), dtype=_U)[:, None]
        key = np.sort(((g >> _U(57) << _U(57)) | (turn << _U(49)) | (g << _U(7) >> _U(15))).ravel())
        b = (key >> _U(57)).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        new = first[~full[b[first]]]
        out[b[new]], full[b[new]] = key[new], True
        at += step
    for j in np.flatnonzero(~full):
        out[j] = (_U(j) << _U(57)) | (_U(T) << _U(49)) | (mix(s ^ _SEEDS[T + j]).min() >> _U(15))
    return out


def bands(coords: np.ndarray) -> np.ndarray:
    return mix((coords * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=_U) ^ _BAND_SEED).view(np.int64)


def _sketches(batches):
    for b in rows(batches):
        n, cls, keys = [], [], []
        for text in b.column(2).to_pylist():
            s = shingles(text)
            n.append(len(s))
            if len(s):
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(bands(sketch(s)))
            else:
                cls.append(None), keys.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "of_text", "n_shingles", "cls", "keys"])


def _sets(batches):
    for b in rows(batches, 200):
        sets = [shingles(t).tobytes() for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["cls", "hashes"])


def _unpacked(batches):
    for b in rows(batches, 100):
        for node, c, x in zip(*(v.to_pylist() for v in b.columns), strict=True):
            h = np.frombuffer(x, np.int64)
            same = [pa.array(np.full(len(h), v), pa.int64()) for v in (node, c, len(h))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(h)], names=["node", "c", "n", "hash"])


def linked(x, y, percent: int) -> bool:
    """x, y: the hashes of two sets, as buffers."""
    a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirmed(percent: int):
    def confirm(batches):
        for b in batches:
            # Buffers, not copies: a batch may hold a long set many times.
            ok = [linked(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirm


def spanning(comps: np.ndarray, sets: list[np.ndarray], first: int, percent: int) -> list[tuple[int, int]]:
    """Linked sets (i, j) that connect components: the first so many sets with those after them, or, with 0, all with each other.

    sets: hashes, none empty. comps: their components so far; a link between sets that are connected already is not looked for.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    root, held, out = np.unique(comps, return_inverse=True)[1], np.zeros(code.max() + 1, bool), []
    for i in range(first or len(sets) - 1):
        at = first or i + 1
        n, m = sizes[i], sizes[at:]
        fits = (root[at:] != root[i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
        if not fits.any():
            continue
        mine = code[starts[i] : starts[i] + n]
        held[mine] = True
        common = np.add.reduceat(held[code[starts[at] :]], starts[at:] - starts[at], dtype=np.int64)
        held[mine] = False
        for j in np.flatnonzero(fits & (100 * common >= percent * (n + m - common))) + at:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def _compared(percent: int):
    form = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for b in rows(batches, 1):
            x, y = (b.column(k)[0].as_py() for k in ("x", "y"))
            both = [x] if x["bid"] == y["bid"] else [x, y]
            nodes, comps, sets = ([v for z in both for v in z[k]] for k in ("nodes", "comps", "sets"))
            met = spanning(np.array(comps), [np.frombuffer(s, _U) for s in sets], len(x["nodes"]) if len(both) > 1 else 0, percent)
            ends = [[min(nodes[i], nodes[j]) for i, j in met], [max(nodes[i], nodes[j]) for i, j in met]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ends], schema=form)

    return compare


def _crowded(scratch: Scratch, prefix: DataFrame, crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the components of all nodes that meet in a crowd (hash, members).

    A node has one block, dealt within the largest of its crowds, so that it travels by blocks that meet and not by hashes.
    """
    member = scratch.store(prefix.join(crowds, "hash").select("node", "c", "n", "hash", "members"), "members")
    at = scratch.store(member.groupBy("node", "c", "n").agg(F.max(F.struct("members", "hash")).alias("m")).select("node", "c", "n", F.col("m.hash").alias("home")), "homes")
    parts = at.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / WEIGHT)).alias("parts"))
    at = scratch.store(at.join(parts, "home").select("node", "c", "home", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")), "dealt")
    one = F.collect_list(F.struct("node", "c", "hashes")).alias("v")
    each = lambda f: F.transform("v", lambda x: x[f])
    blocks = at.join(sets, "node").groupBy("home", "part").agg(one).withColumn("bid", F.monotonically_increasing_id())
    blocks = scratch.store(blocks.select("home", "part", "bid", F.struct("bid", each("node").alias("nodes"), each("c").alias("comps"), each("hashes").alias("sets")).alias("x")), "blocks")
    of = at.join(blocks.select("home", "part", "bid"), ["home", "part"]).select("node", "bid")
    cells = scratch.store(member.select("node", "hash").join(of, "node").select("hash", "bid").distinct(), "cells")
    # Pairs are met by number, so blocks travel only to where they are compared.
    met = cells.join(cells.select("hash", F.col("bid").alias("of")), "hash").where("bid <= of").select("bid", "of").distinct()
    both = met.join(blocks.select("bid", "x"), "bid").join(blocks.select(F.col("bid").alias("of"), F.col("x").alias("y")), "of")
    return scratch.store(both.select("x", "y").mapInArrow(_compared(percent), "a long, b long"), "compared")


def _rest(scratch: Scratch, live: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """All pairs (x, y) of live nodes in different components that may be linked, by prefix filtering, but for those that
    meet in crowded hashes; and of these the links (a, b) that connect components, or None where no hash is crowded.

    Hashes are ordered from rare to frequent. Two linked sets meet in the first
    n - ceil(n * percent / 100) + 1 hashes of each, so only these are joined; hashes of one set alone
    count for their place but meet nothing.
    """
    at = live.select("node", "c").distinct()
    own = scratch.store(sets.join(at, "node").select("node", "c", "hashes").mapInArrow(_unpacked, "node long, c long, n long, hash long"), "hashes")
    common = scratch.store(own.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"), "common")
    met = own.join(common, "hash")
    by = Window.partitionBy("node")
    place = F.row_number().over(by.orderBy("df", "hash")) + F.col("n") - F.count("*").over(by)
    prefix = met.withColumn("place", place).where(f"place <= n - ceil(n * {percent} / 100) + 1")
    prefix = scratch.store(prefix.select("node", "c", "n", "hash", "place"), "prefix")
    many = prefix.groupBy("hash").agg(F.count("*").alias("members"), F.min("c").alias("lo"), F.max("c").alias("hi")).where((F.col("members") >= CROWD) & (F.col("lo") < F.col("hi")))
    many = scratch.store(many.select("hash", "members"), "crowds")
    links = None
    if not many.isEmpty():
        links = _crowded(scratch, prefix, many, sets, percent)
        prefix = scratch.store(prefix.join(many, "hash", "left_anti"), "few")
    a, b = prefix.alias("a"), prefix.alias("b")
    sizes = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)"
    # From their first common hash on, both sets must have enough left for the overlap that a link needs.
    enough = f"{100 + percent} * (1 + least(a.n - a.place, b.n - b.place)) >= {percent} * (a.n + b.n)"
    return a.join(b, F.expr(f"a.hash = b.hash and a.c < b.c and {sizes} and {enough}")).select(F.col("a.node").alias("x"), F.col("b.node").alias("y")), links


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("of_text"), text.alias("text"))


def _classes(docs: DataFrame, percent: int, rounds: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Stored tables (doc_id, of_text, n_shingles, cls) of all rows and (cls, component_id, node) of all classes.

    component_id: the smallest id of the classes that a class reaches; with by_id also over classes that share an id.
    node: a number that the classes of a component share.
    """
    if percent < 75:
        raise ValueError("the bands are laid out for 75 percent or more")
    scratch = Scratch(docs.sparkSession, "near-dup")
    texts = _texts(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    every = scratch.store(texts.mapInArrow(_sketches, f"doc_id {kind}, of_text long, n_shingles long, cls binary, keys array<long>"), "sketches")
    usable = every.where("cls is not null and doc_id is not null")
    # Equal sets have equal sketches, so a class takes any member's. The numbers hold once they are written.
    firsts = usable.groupBy("cls").agg(F.min(F.struct("doc_id", "keys")).alias("m"))
    classes = scratch.store(firsts.select("cls", "m.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    cells = classes.select("node", F.explode("keys").alias("key"))
    shared = scratch.store(cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    live = scratch.store(cells.join(shared, "key"), "live")
    named = scratch.store(classes.join(live.select("node").distinct(), "node").select("node", "cls", "doc_id"), "named")
    # Found by id alone, which is narrow; other texts of the id fall out by class.
    whole = texts.join(named.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(_sets, "cls binary, hashes binary")
    sets = whole.groupBy("cls").agg(F.min("hashes").alias("hashes")).join(named.select("cls", "node"), "cls")
    sets = scratch.store(sets.select("node", "hashes"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.store(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        x = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
        y = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
        full = pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b")
        return scratch.store(full.mapInArrow(_confirmed(percent), "a long, b long"), "links")

    links, component = None, None
    for turn in range(rounds + 1):
        if component is not None:
            left = live.select("key", "node").join(component.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
            left = scratch.store(left, "left")
            spread = left.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
            spread = scratch.store(spread, "spread")
            live = scratch.store(left.join(spread.select("key"), "key"), "live")
            if live.isEmpty():
                break
        else:
            live = live.withColumn("c", F.col("node"))
        crowd = None
        if turn < rounds:
            order = F.col("node") if not turn else F.xxhash64("node", F.lit(turn))
            pivots = scratch.store(live.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "c")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.c").alias("of")), "pivots")
            met = live.join(pivots, "key")
            pairs = met.where("c <> of").select(F.col("node").alias("x"), F.col("pivot").alias("y"))
            live = met.where("node <> pivot").select("key", "node")
        else:
            pairs, crowd = _rest(scratch, live, sets, percent)
        found = confirm(pairs)
        found = found if crowd is None else found.union(crowd)
        links = found if links is None else links.union(found)
        component = components(scratch, links)
    named = classes.select("cls", F.col("doc_id").alias("id"), "node")
    owned = usable.select("doc_id", "cls").distinct().join(named.select("cls", "node"), "cls").select(F.col("doc_id").alias("id"), "node")
    told = reached(scratch, named, links, owned if by_id else None).withColumnRenamed("least", "component_id")
    told = scratch.store(told, "told")
    scratch.only(every, told)
    return every.drop("keys"), told


def near_duplicates(docs: DataFrame, percent: int = 75, rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Documents are linked when 100 * |A & B| >= percent * |A | B|; percent is 75 or more, for which the
    bands are laid out. rounds: rounds with one pivot a bucket before the exhaustive one.
    """
    every, told = _classes(docs, percent, rounds, True)
    out = every.join(told, "cls", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group one text with the smallest doc_id stays.

    Texts under one id are rows of their own: one that resembles nothing stays. Of rows that repeat id and text
    one stays. Rows without doc_id or words stay.
    """
    every, told = _classes(docs, percent, 1, False)
    scratch = Scratch(docs.sparkSession, "keep-one")
    rows_ = every.where("doc_id is not null").groupBy("doc_id", "cls", "of_text").agg(F.count("*").alias("n")).join(told.select("cls", "node"), "cls", "left")
    rows_ = scratch.store(rows_, "rows")
    # The text of a group that stays; beside it, most groups have no other.
    best = rows_.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "cls", "of_text")).alias("best"), F.count("*").alias("texts")).where("texts > 1")
    stays = F.col("best").isNull() | (F.struct("doc_id", "cls", "of_text") == F.col("best"))
    flagged = scratch.store(rows_.join(best, "node", "left").select("doc_id", "of_text", F.col("cls").isNotNull().alias("told"), "n", F.coalesce(stays, F.lit(True)).alias("stays")), "flagged")
    # Most ids go or stay as a whole, and ids alone are narrow.
    ids = scratch.store(flagged.groupBy("doc_id").agg(F.bool_or("stays").alias("some"), F.bool_and("stays").alias("every")).where("not every"), "ids")
    left = docs.join(ids.where("not some").select(F.col("doc_id").alias("__gone")), docs["doc_id"] == F.col("__gone"), "left_anti")
    mixed = ids.where("some").select("doc_id")
    if not mixed.isEmpty():
        gone = flagged.where("not stays").join(mixed, "doc_id", "left_semi").select(F.col("doc_id").alias("__gone"), F.col("of_text").alias("__of"))
        left = left.join(gone, (left["doc_id"] == F.col("__gone")) & (F.xxhash64(left["text"].cast("string")) == F.col("__of")), "left_anti")
    rows_ = flagged.where("told and stays")
    twice = rows_.where("n > 1").select(F.col("doc_id").alias("__gone"), F.col("of_text").alias("__of"))
    if twice.isEmpty():
        return left
    again = (left["doc_id"] == F.col("__gone")) & (F.xxhash64(left["text"].cast("string")) == F.col("__of"))
    once = left.join(twice, again, "left_semi").select(F.struct(*docs.columns).alias("row"))
    once = once.groupBy(F.col("row.doc_id").alias("i"), F.xxhash64(F.col("row.text").cast("string")).alias("t")).agg(F.first("row").alias("row"))
    return left.join(twice, again, "left_anti").unionByName(once.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The links of all pairs of distinct sets, without sketches; meant for small tables.
ORACLE = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
),
places as (select doc_id, len(w) as total, unnest(w) as word, generate_subscripts(w, 1) as i from words),
runs as (
  select doc_id, total, i, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) as shingle
  from places window o as (partition by doc_id order by i)
),
filled as (select doc_id, list_sort(list(distinct shingle)) as s from runs where i <= greatest(1, total - 4) group by doc_id),
sets as (select d.doc_id, coalesce(f.s, []) as s from documents d left join filled f using (doc_id)),
classes as (select s, min(doc_id) as node, len(s) as n from sets where len(s) > 0 group by s),
each as (select node, n, unnest(s) as shingle from classes),
links as (
  select a.node as x, b.node as y from each a join each b on a.shingle = b.shingle and a.node < b.node
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
both_ways as (select x, y from links union all select y, x from links),
reach(node, met) as (select node, node from classes union select r.node, l.y from reach r join both_ways l on l.x = r.met),
component as (select node, min(met) as id from reach group by node)
select t.doc_id, cast(len(t.s) as bigint) as n_shingles, coalesce(p.id, t.doc_id) as component_id, coalesce(p.id, t.doc_id) = t.doc_id as kept
from sets t left join classes c on c.s = t.s left join component p on p.node = c.node
"""
