"""Best-fit packing into bins of several permitted capacities.

Longest first, each piece goes into the open bin that it leaves with the least room. A piece that fits
nowhere opens a bin, of a capacity that one of three rules gives:

* planned: the capacity that costs least for each token that gets in. For each capacity, the largest
  pieces that fit are taken from the lengths still to come and not promised to bins opened before, and
  those of the chosen one are promised to it;
* largest: the largest capacity, left to the final downsizing;
* smallest: the smallest that holds the piece.

At the end each bin shrinks to the smallest permitted capacity that holds its contents. A block is packed
by all rules and the cheapest packing stays, so the sizes are chosen together, over the block's whole
cost. Texts longer than the largest capacity are cut into pieces of that size, the rest last, so every
token is packed once.

Rows are dealt into blocks of about BLOCK by a hash of id, text and copy number, and sorted within them: the same
rows give the same bins, however the input is split. Only (id, length, hash, copies) are shuffled, summed
beforehand, so many repeated rows weigh as one. A lost task packs the same block again; a block's last bins
may be part empty.

Defined results: null and empty texts are pieces of length 0 that sit in a bin like others. Null ids
are listed as null; ids keep their type. Repeated rows are packed as often as they occur, in several blocks. Ties
go by hash, then id. An empty table gives no bins. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import WORD

CAPACITIES = (512, 1024, 2048, 4096)
#: Documents packed together, and the most blocks of a shuffle partition's worth of tasks.
BLOCK = 20_000
TASKS = 20_000
RULES = ("planned", "largest", "smallest")
#: Attention makes a slot dearer in a longer sequence: cost(c) = c * (1 + c / QUADRATIC).
QUADRATIC = 65536


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / QUADRATIC)


class Ahead:
    """How many pieces of each length are still to come: free, and promised to open bins."""

    def __init__(self, lengths: list[int]):
        self.free, self.promised, self.mask = Counter(n for n in lengths if n), Counter(), 0
        for n in self.free:
            self.mask |= 1 << n

    def take(self, n: int, k: int = 1) -> None:
        self.free[n] -= k
        if not self.free[n]:
            self.mask &= ~(1 << n)

    def placed(self, n: int, planned: bool) -> None:
        """A piece goes into an open bin, as planned, or opens one."""
        if n and self.free[n] and not (planned and self.promised[n]):
            self.take(n)
        elif n:
            self.promised[n] -= 1

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, count) of the free pieces that a room takes, the largest that fits each time."""
        out, below = [], self.mask
        while below := below & ((2 << room) - 1):
            n = below.bit_length() - 1
            k = min(self.free[n], room // n)
            out.append((n, k))
            room -= n * k
            below &= ~(1 << n)
        return out


def _planned(ahead: Ahead, sizes: list[int], size: int) -> int:
    """The capacity whose plan costs least for each token; what it counts on is promised to the new bin."""
    plans = []
    for c in sizes:
        if c >= size:
            plan = ahead.fill(c - size)
            tokens = size + sum(n * k for n, k in plan)
            plans.append((cost(next(x for x in sizes if x >= tokens)) / max(1, tokens), c, plan))
    _, c, plan = min(plans)
    for n, k in plan:
        ahead.take(n, k)
        ahead.promised[n] += k
    return c


def filled(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, rule: str = "planned") -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Bins as (capacity at opening, tokens, [(index, start, length)]), opened by one of RULES."""
    sizes = sorted(capacities)
    top = sizes[-1]
    pieces = [(min(top, n - at), i, at) for i, n in enumerate(lengths) for at in (range(0, n, top) if n else (0,))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    ahead = Ahead([p[0] for p in pieces]) if rule == "planned" else None
    bins: list[list[tuple[int, int, int]]] = []
    used: list[int] = []
    opened: list[int] = []
    # Open bins by room; bit r of rooms is set while there is one with room r.
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for size, i, at in pieces:
        fit = rooms >> size
        if ahead:
            ahead.placed(size, bool(fit))
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            c = _planned(ahead, sizes, size) if ahead else top if rule == "largest" else next(x for x in sizes if x >= size)
            b, room = len(bins), c
            bins.append([])
            used.append(0)
            opened.append(c)
        bins[b].append((i, at, size))
        used[b] += size
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return list(zip(opened, used, bins, strict=True))


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Bins as (capacity, [(index, start, length)]): the cheapest of the packings by RULES, downsized."""
    sizes = sorted(capacities)
    each = [[(next(c for c in sizes if c >= used), x) for _, used, x in filled(lengths, capacities, rule)] for rule in RULES]
    return min(each, key=lambda bins: sum(cost(c) for c, _ in bins))


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length=None, block: int = BLOCK) -> DataFrame:
    """A row for each bin over docs (doc_id, text): its pieces as lists of doc_id, start and length in tokens.

    length: a column with the tokens of a document; by default its white-space words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = F.regexp_count(text, F.lit(WORD)) if length is None else length
    narrow = docs.select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n"), F.xxhash64("doc_id", text).alias("u"))
    counted = narrow.groupBy("doc_id", "n", "u").agg(F.count("*").alias("copies"))
    blocks = max(1, -(-docs.count() // block))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt = copies.withColumn("v", F.xxhash64("u", "copy")).withColumn("block", F.pmod("v", F.lit(blocks)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(name: str, ids: pa.Array, lengths: list):
        bins = best_fit(lengths, capacities)
        flat = pa.array([p[0] for _, x in bins for p in x], pa.int64())
        ends = pa.array([0, *accumulate(len(x) for _, x in bins)], pa.int32())
        lists = [ids.take(flat), *(pa.array([p[i] for _, x in bins for p in x], pa.int32()) for i in (1, 2))]
        cols = [pa.array([f"{name}-{i}" for i in range(len(bins))], pa.string()), pa.array([c for c, _ in bins], pa.int32()), pa.array([sum(p[2] for p in x) for _, x in bins], pa.int32())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"])

    def run(batches):
        # Blocks come one after another; one with far more rows than meant is packed in parts.
        now, part, ids, lengths, held = None, 0, [], [], 0

        def done():
            return packed(f"{now}-{part}", pa.concat_arrays(ids), [n for x in lengths for n in x.to_pylist()])

        for b in batches:
            at = 0
            while at < b.num_rows:
                name = b.column(0)[at].as_py()
                if name != now or held >= 2 * block:
                    if held:
                        yield done()
                    now, part, ids, lengths, held = name, part + 1 if name == now else 0, [], [], 0
                same = pc.index(pc.not_equal(b.column(0).slice(at), name), True).as_py()
                k = min(b.num_rows - at if same < 0 else same, 2 * block - held)
                ids.append(b.column(1).slice(at, k))
                lengths.append(b.column(2).slice(at, k))
                at, held = at + k, held + k
        if held:
            yield done()

    tasks = dealt.repartition(min(blocks, TASKS), "block").sortWithinPartitions("block", "v", "doc_id", "n")
    return tasks.select("block", "doc_id", "n").mapInArrow(run, f"bin_id string, capacity int, used int, doc_ids array<{kind}>, starts array<int>, lengths array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
