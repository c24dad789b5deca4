"""Quality rules: a hashed n-gram log-likelihood ratio beside fixed limits, all in native expressions.

Word 1-grams and 2-grams are hashed into buckets. Two multinomials over the buckets are estimated
with add-one smoothing: the target from trusted documents, the raw one from all documents. A
document's score is the mean over its n-grams of log(target / raw), and the verdict compares it with
one threshold, so that equal texts always get equal verdicts.

Labelled documents that are good and not toxic are dealt by hash: three of four are trusted, at most TRUSTED, the
others and the bad ones, at most HELD of each kind, set the threshold: of all cuts between their scores, the
one at which the share of good documents kept exceeds that of bad ones the most, in the middle of the gap. These
bounded sets of ids are broadcast, and an id counts once. Everything else covers all rows. No text is shuffled.

Defined results: null and empty texts have no words and fail the limits. Null ids are scored like
others; ids may be of any type. Repeated rows give repeated results. Without trusted documents every score is 0 and the limits
decide alone, as they do without good documents beside them; without bad ones the lowest good score is the
threshold. An empty table gives an empty result. Extra columns, of whatever name, are ignored by quality() and
kept by keep_good(). Up to 2**16 windows of three words, 48 bits of their hashes or more are compared, beyond that all 64.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import SPACE, WORD

#: Hash buckets of the two multinomials.
M = 1 << 14
#: Bounds on the numbers of trusted documents and of those of each kind that set the threshold.
TRUSTED, HELD = 20_000, 5_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _words(text):
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _grams(h, buckets: int):
    """Buckets of the 1-grams and 2-grams of an array of word hashes."""
    n = F.size(h)
    # With one word, the slice of length 0 leaves no 2-gram.
    two = F.transform(F.slice(h, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")), two)


def labelled(labels: DataFrame, good: bool, held: bool, most: int) -> DataFrame:
    """At most so many ids, as text, of good or bad labelled documents, for the threshold (held) or for training."""
    kind = F.expr("quality = 1 and coalesce(toxic, 0) = 0" if good else "quality = 0")
    ids = labels.where(kind & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("labelled")).distinct()
    if good:
        ids = ids.where((F.pmod(F.xxhash64("labelled", F.lit(3)), F.lit(4)) == 0) == F.lit(held))
    return ids.orderBy(F.xxhash64("labelled"), "labelled").limit(most)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def weights(docs: DataFrame, labels: DataFrame, buckets: int = M, trusted: int = TRUSTED) -> list[float]:
    """log(target / raw) for each bucket: so many numbers on the driver, whatever the input's size."""
    hashed = _texts(docs).select("id", F.transform(_words(F.col("t")), lambda w: F.xxhash64(w)).alias("h"))
    flagged = hashed.join(F.broadcast(labelled(labels, True, False, trusted)), F.col("id") == F.col("labelled"), "left").select((F.col("labelled").isNotNull()).cast("long").alias("good"), "h")
    # The outer form, as the plain one infers a filter that repeats the whole expression at the scan.
    one = flagged.select("good", F.explode_outer(_grams(F.col("h"), buckets)).alias("b")).where("b is not null")
    counts = {r.b: (r.target, r.raw) for r in one.groupBy("b").agg(F.sum("good").alias("target"), F.count("*").alias("raw")).collect()}
    target, raw = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not target:
        return [0.0] * buckets
    pairs = [counts.get(b, (0, 0)) for b in range(buckets)]
    return [math.log((t + 1) / (target + buckets)) - math.log((r + 1) / (raw + buckets)) for t, r in pairs]


def best_cut(good: list[float], bad: list[float]) -> float:
    """The threshold that keeps the largest share of good scores beyond that of bad ones; in the middle of its gap."""
    if not good:
        return -math.inf
    if not bad:
        return min(good)
    points = sorted({*good, *bad})
    scores = [(x, 1 / len(good)) for x in good] + [(x, -1 / len(bad)) for x in bad]
    scores.sort()
    # Kept at a cut just above the k lowest points.
    best, at, gain, k = 0.0, points[0], 0.0, 0
    for n, point in enumerate(points[:-1]):
        while k < len(scores) and scores[k][0] <= point:
            gain -= scores[k][1]
            k += 1
        if gain > best + 1e-12:
            best, at = gain, (point + points[n + 1]) / 2
    return at


def threshold(docs: DataFrame, labels: DataFrame, ratio: list[float], held: int = HELD) -> float:
    """best_cut() for the scores of held labelled documents that the limits pass."""
    ids = labelled(labels, True, True, held).withColumn("good", F.lit(True)).unionByName(labelled(labels, False, True, held).withColumn("good", F.lit(False)))
    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id").cast("string") == F.col("labelled"))
    # No condition on what scored() gives: it would be moved below and repeat every expression.
    passed = F.when(~verdict(F.col("quality"), -math.inf)[0], F.col("quality.score"))
    s = scored(some, ratio).select(F.col("row.labelled").alias("id"), F.col("row.good").alias("good"), passed.alias("score"))
    once = [r for r in s.groupBy("id", "good").agg(F.min("score").alias("score")).collect() if r.score is not None]
    return best_cut([r.score for r in once if r.good], [r.score for r in once if not r.good])


def scored(docs: DataFrame, ratio: list[float]) -> DataFrame:
    """(row, quality) for every row of docs: a struct of its columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score."""
    table = F.expr("cast(split('" + ",".join(f"{x:.5f}" for x in ratio) + "', ',') as array<double>)")
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("h", F.transform(_words(F.col("t")), lambda w: F.xxhash64(w)))
    d = d.withColumn("n", F.size("h"))
    h, n = F.col("h"), F.col("n")
    threes = F.transform(F.slice(h, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    d = d.withColumn("three", threes).withColumn("twice", F.size(F.array_distinct("three")) < F.size("three"))
    packed, wide = (F.when(F.col("twice"), x) for x in _sorted(F.col("three")))
    d = d.withColumn("packed", packed).withColumn("wide", wide)
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    d = d.withColumn("lines", lines)
    total = F.aggregate(_grams(h, len(ratio)), F.lit(0.0), lambda a, b: a + F.get(table, b))
    return d.select(
        "row",
        F.struct(
            n.cast("long").alias("n_words"),
            (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("twice"), _repeated(F.col("three"), F.col("packed"), F.col("wide"))).otherwise(0).cast("long").alias("n_repeat_words"),
            F.when(n > 0, total / (2 * n - 1)).otherwise(0.0).alias("score"),
        ).alias("quality"),
    )


def _width(three):
    return F.length(F.bin(F.size(three)))


def _sorted(three):
    """Sorted windows with their positions: (packed, wide), of which one is null.

    Up to 2**16 windows, hash and position share a long, which sorts as a primitive.
    """
    short = F.size(three) < 65536
    packed = F.transform(three, lambda x, i: F.call_function("shiftleft", x, _width(three)).bitwiseOR(i.cast("long")))
    wide = F.transform(three, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))
    return F.when(short, F.sort_array(packed)), F.when(~short, F.sort_array(wide))


def _repeated(three, packed, wide):
    """Words in windows that occur twice or more: equal neighbours in sorted order, then the union of their words.

    The arguments are columns, not expressions: the lambdas look at neighbours in them.
    """
    k = _width(three)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1

    def covered(starts):
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def upper(x):
        return F.call_function("shiftright", x, k)

    def same(s, hashed):
        return lambda x, i: F.coalesce(hashed(x) == hashed(F.get(s, i - 1)), F.lit(False)) | F.coalesce(hashed(x) == hashed(F.get(s, i + 1)), F.lit(False))

    short = covered(F.transform(F.filter(packed, same(packed, upper)), lambda x: x.bitwiseAND(mask)))
    long = covered(F.transform(F.filter(wide, same(wide, lambda x: x["h"])), lambda x: x["i"]))
    return F.when(packed.isNotNull(), short).otherwise(long)


def verdict(q, least: float):
    """(base_failed, kept) for a struct of scored() and a threshold."""
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])
    return failed, ~failed & (q["score"] >= least)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = M, trusted: int = TRUSTED, held: int = HELD) -> DataFrame:
    """doc_id, the measures, score, threshold and the verdict for every row of docs (doc_id, text)."""
    ratio = weights(docs, labels, buckets, trusted)
    least = threshold(docs, labels, ratio, held)
    failed, kept = verdict(F.col("quality"), least)
    d = scored(docs.select("doc_id", "text"), ratio)
    return d.select("row.doc_id", "quality.*", F.lit(least).alias("threshold"), failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = M, trusted: int = TRUSTED, held: int = HELD) -> DataFrame:
    """The rows of docs, all columns, that pass."""
    ratio = weights(docs, labels, buckets, trusted)
    # A condition is not moved below a column that isn't deterministic; moved, it would repeat every expression.
    d = scored(docs, ratio).withColumn("number", F.monotonically_increasing_id())
    return d.where(verdict(F.col("quality"), threshold(docs, labels, ratio, held))[1] & (F.col("number") >= 0)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
