"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power a, normalised. a = 1 keeps the shares, smaller a
evens them out, larger a sharpens them. a is bisected, six levels to a Spark job, to the most even mixture whose repetition
limit holds under the budget, and to no more entropy than asked for; the target may be given in nats, or as the part of the way from the
entropy of the shares to that of equal weights. What no exponent meets raises: a target below the entropy of the largest sources
alone, a budget of more passes than the limit over all or over the largest source. The budget defaults to what gives the largest
source exactly one pass: up to a = 1 no document is lost and smaller sources repeat, beyond it smaller sources lose some.

Weights become whole documents by budgeted block permutations: documents are dealt by hash into about
sqrt(n) blocks, blocks are taken in a pseudo-random order and documents in hash order within theirs. A
source's budget is a number of whole passes and a first part of the permutation. The part ends at a
(block, hash) found from block totals and one block's running sum, so no window covers a source and
mix() shuffles no text. mixed_documents() sorts the rows of each partition by pass, block and hash, also without a
shuffle; on request it sorts them over the whole cluster, which moves every text.

The table of cuts has a row for each source; it is broadcast if it has at most BROADCAST rows and
shuffled otherwise.

Defined results: a null source is a source of its own. Null and empty texts weigh one token. Documents
with equal hashes, repeated rows among them, are taken or left together. With one source, or an empty
table, nothing repeats. All columns of docs stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import WORD, Scratch

#: Most passes over any source.
REPEAT = 2.0
#: Sources whose cuts may be broadcast: under 10 MB.
BROADCAST = 50_000
LEVELS = 6
#: Powers of two among which an exponent above one is looked for.
STEPS = 24
#: How far the registered query and the pipeline go from the shares' entropy towards that of equal weights.
EVENNESS = 0.5


def _prepared(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(row, source, tokens, u, block): a struct of the columns of docs, and the operator's own columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u = F.xxhash64(F.col("doc_id"), F.xxhash64(text), F.lit(7))
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
        F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long").alias("tokens"),
        u.alias("u"),
        F.pmod(F.xxhash64(u), F.lit(n_blocks)).cast("int").alias("block"),
    )


def exponent(shares: DataFrame, repeat: float, entropy: float | None, evenness: float | None, times: float | None = None) -> tuple[float, float]:
    """(a, log of the normaliser) for a table of positive shares p, one row for each source.

    times: the budget as a multiple of all tokens; None gives the largest source one pass. The smallest a, and so the most even mixture, that
    passes over no source more than repeat times and has no more entropy than asked for. Both get easier as a rises to 1, and
    entropy beyond that too, down to that of the largest sources alone. A ValueError where no a serves.
    """
    p = F.col("p")
    r = shares.agg(F.max(p).alias("hi"), F.min(p).alias("lo"), F.count(p).alias("n"), (-F.sum(p * F.log(p))).alias("entropy")).first()
    if r.hi is None:
        return 1.0, 0.0
    if times is not None and times > repeat * (1 + 1e-9):
        raise ValueError(f"a budget of {times:.4g} times the tokens takes more than {repeat} passes")
    if evenness is not None:
        target = r.entropy + evenness * (math.log(r.n) - r.entropy)
        entropy = target if entropy is None else min(entropy, target)
    top, low_log = math.log(r.hi), math.log(r.lo)
    # Powers of shares over the largest one do not underflow where it matters.
    q = p / F.lit(r.hi)
    ties = shares.agg(F.sum(F.when(q > 1 - 1e-12, 1).otherwise(0))).first()[0]
    if entropy is not None and entropy < math.log(ties) - 1e-9:
        raise ValueError(f"no exponent gives an entropy below {math.log(ties):.6g}")

    def sums(grid: list[float]) -> list[tuple[float, float]]:
        """(log of the sum of p**a, entropy) for each a."""
        got = shares.agg(*(x for i, a in enumerate(grid) for x in (F.sum(q**a).alias(f"z{i}"), F.sum(q**a * F.log(q)).alias(f"s{i}")))).first()
        return [(math.log(got[f"z{i}"]) + a * top, math.log(got[f"z{i}"]) - a * got[f"s{i}"] / got[f"z{i}"]) for i, a in enumerate(grid)]

    def passes(a: float, log_z: float, log_p: float) -> float:
        """Log of the passes over a source of this share."""
        return (1 - a) * (top - log_p) if times is None else math.log(times) - (1 - a) * log_p - log_z

    def enough(a: float, log_z: float, h: float) -> bool:
        return (a >= 1 or passes(a, log_z, low_log) <= math.log(repeat) + 1e-12) and (entropy is None or h <= entropy + 1e-9)

    if r.hi <= r.lo:
        return 1.0, 0.0
    # Zero to one, or between the powers of two from there.
    steps = [0.0, *(2.0**k for k in range(STEPS))]
    first = next((i for i, (a, x) in enumerate(zip(steps, sums(steps), strict=True)) if enough(a, *x)), None)
    if first is None:
        raise ValueError("no exponent gives so small an entropy")
    low, high = (steps[first - 1], steps[first]) if first else (0.0, 0.0)
    for _ in range(4 if first else 0):
        grid = [low + i * (high - low) / 2**LEVELS for i in range(1, 2**LEVELS)]
        good = next((i for i, (a, x) in enumerate(zip(grid, sums(grid), strict=True)) if enough(a, *x)), None)
        low, high = (grid[-1], high) if good is None else (grid[good - 1] if good else low, grid[good])
    log_z = sums([high])[0][0]
    if high > 1 and passes(high, log_z, top) > math.log(repeat) + 1e-9:
        raise ValueError("the budget takes too many passes over the largest source at so small an entropy")
    return high, log_z


def cuts(narrow: DataFrame, scratch: Scratch, repeat: float, entropy: float | None, evenness: float | None, budget: float | None) -> DataFrame:
    """(source, weight, passes, full, cut_block, cut_u): documents up to the cut get one pass more than full.

    narrow: source, tokens, u and block of every document.
    """
    cells = scratch.store(narrow.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "cells")
    sources = scratch.store(cells.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")
    every = sources.agg(F.sum("total")).first()[0] or 0
    shares = sources.withColumn("p", F.col("total") / F.lit(float(max(every, 1))))
    a, log_z = exponent(shares, repeat, entropy, evenness, None if budget is None or not every else budget / every)
    top = shares.agg(F.max("p")).first()[0] or 1.0
    spend = budget if budget is not None else every * math.exp(log_z + (1 - a) * math.log(top))
    weighted = shares.withColumn("weight", F.col("p") ** a / F.lit(math.exp(log_z))).withColumn("passes", F.col("weight") * F.lit(float(spend)) / F.col("total"))
    whole = F.round(F.floor(F.col("passes") + 1e-9)).cast("int")
    plan = weighted.withColumn("full", whole).withColumn("part", F.greatest(F.floor((F.col("passes") - whole) * F.col("total") + 1e-6).cast("long"), F.lit(0).cast("long")))
    plan = scratch.store(plan, "plan")
    order = Window.partitionBy("source").orderBy("block")
    before = cells.join(plan, "source").withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    # The one block in which a source's part ends.
    edge = scratch.store(before.where("before < part and part <= before + tokens").select("source", "block", (F.col("part") - F.col("before")).alias("room")), "edge")
    # Equal hashes first become one row, so that many repeated rows are one.
    within = narrow.join(edge, ["source", "block"]).groupBy("source", "block", "room", "u").agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("u"))
    last = within.withColumn("run", run).where("run <= room").groupBy("source", "block").agg(F.max("u").alias("cut_u"))
    ends = edge.join(last, ["source", "block"], "left").select("source", F.col("block").alias("cut_block"), "cut_u")
    out = scratch.store(plan.join(ends, "source", "left").select("source", "weight", "passes", "full", "cut_block", "cut_u"), "cuts")
    scratch.only(out)
    return out


def mix(docs: DataFrame, repeat: float = REPEAT, entropy: float | None = None, evenness: float | None = None, budget: float | None = None) -> DataFrame:
    """(row, pass, block, u, weight): each row of docs, as a struct, as often as its source's budget takes it.

    Reading by (pass, block, u) gives the permuted order. entropy: target in nats. evenness: target as a part, from
    0 to 1, of the way from the shares' entropy to the largest. budget: tokens to spend.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    n_blocks = max(1, math.isqrt(docs.count()))
    d = _prepared(docs, n_blocks)
    c = cuts(d.select("source", "tokens", "u", "block"), scratch, repeat, entropy, evenness, budget)
    met = d.join(F.broadcast(c) if c.count() <= BROADCAST else c, "source")
    inside = (F.col("block") < F.col("cut_block")) | (F.col("block") == F.col("cut_block")) & (F.col("u") <= F.col("cut_u"))
    times: Column = F.col("full") + F.coalesce(inside, F.lit(False)).cast("int")
    taken = met.withColumn("times", times).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("pass"), "block", "u", "weight")


def mixed_documents(docs: DataFrame, everywhere: bool = False, **how) -> DataFrame:
    """Only the columns of docs, in the permuted order within each partition, or everywhere."""
    m = mix(docs, **how)
    order = ["pass", "block", "u"]
    return (m.sort(*order) if everywhere else m.sortWithinPartitions(*order)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), evenness=EVENNESS)
    return m.select("row.doc_id", "row.source", "pass", "block", F.col("u").alias("order_key"), F.round("weight", 9).alias("weight"))
