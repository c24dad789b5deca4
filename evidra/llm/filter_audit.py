"""Filter interaction audit by permutation-trie execution.

All orders of five filters form a trie; two prefixes that hold the same filters leave the same documents. So the trie
is walked depth first, each unordered prefix once: its survivors are a persisted DataFrame, filtered from those of the
prefix it was reached by, and one pass over them counts what each further filter removes, part by part. A prefix
is released when all that follows it is counted, so at most one for each level is held at a time. What an
order removes at a step is the count of an edge, looked up by the filters before it.

Texts are read once, for a table of measures. What is walked is a table of a row for each document: part, five verdicts and two labels. A document is
told from earlier copies by joining it with the smallest id of its text on (id, SHA-256 of the text), a key that no group of
copies shares.

Persisted survivors are filtered anew, from the stored table, where an executor is lost; the counts of each prefix are stored.

Defined results: null and empty texts are the same text, without words: they fail A, and E unless first.
The part of a null lang is the empty string. Repeated rows are counted each; rows of one id do not make each other
fail E. Without an id E is passed. Of several label rows for an id any counts; unlabelled documents are
neither good nor toxic. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import string
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import SPACE, Scratch


def conditions() -> dict[str, Column]:
    """When a document fails, in terms of the columns of measured(); E is about the table and comes from with_copies()."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_upper") > 3 * F.col("n_points"),
        "D": F.col("symbols"),
        "E": F.col("copy"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, n_upper, n_points, symbols) for every row of docs (doc_id, text, lang)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE + "+"), "")
    points = F.length(t)
    return docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        (points - F.length(F.translate(t, string.ascii_uppercase, ""))).alias("n_upper"),
        points.alias("n_points"),
        t.rlike(r"[#$%&*|]").alias("symbols"),
    )


def with_copies(m: DataFrame) -> DataFrame:
    """m with copy: whether a smaller id has the same text."""
    first = m.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    return m.join(first, ["doc_id", "digest"], "left").withColumn("copy", F.col("doc_id").isNotNull() & F.col("first").isNull())


def verdicts(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) for every row of measures, as measured() gives them: whether it fails each filter, and its labels.

    measures are read twice: write them before.
    """
    m = with_copies(measures)
    of = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return m.join(of, "doc_id", "left").select("part", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in conditions().items()), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def edges(every: DataFrame, scratch: Scratch, filters: str) -> list[DataFrame]:
    """Stored tables, one for each unordered prefix (before, a bit for each filter): (part, before, left, gone), gone by filter.

    gone holds (filter, removed, good_lost, toxic_lost) for each filter not in the prefix, and left the documents before it.
    """
    tables: dict[int, DataFrame] = {}

    def visit(before: int, survivors: DataFrame) -> None:
        survivors = survivors.persist()
        further = [f for i, f in enumerate(filters) if not before >> i & 1]
        gone = [F.struct(F.lit(f).alias("filter"), *(F.count_if(x).alias(n) for n, x in (("removed", F.col(f)), ("good_lost", F.col(f) & F.col("good")), ("toxic_lost", F.col(f) & F.col("toxic"))))) for f in further]
        counts = survivors.groupBy("part").agg(F.count("*").alias("left"), F.array(*gone).alias("gone"))
        tables[before] = scratch.store(counts.select("part", F.lit(before).alias("before"), "left", "gone"), f"prefix-{before}")
        for f in further:
            after = before | 1 << filters.index(f)
            if len(further) > 1 and after not in tables:
                visit(after, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(0, every)
    return list(tables.values())


def orders(filters: str) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, before) of every step of every order."""
    out = []
    for p in permutations(filters):
        before = 0
        for step, f in enumerate(p, 1):
            out.append(("".join(p), step, f, before))
            before |= 1 << filters.index(f)
    return out


def audit(verdict: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    verdict: part, a boolean column for each letter of filters that says who fails, good and toxic.
    """
    spark = verdict.sparkSession
    scratch = Scratch(spark, "audit")
    every = scratch.store(verdict, "verdicts")
    prefixes = edges(every, scratch, filters)
    met = prefixes[0]
    for t in prefixes[1:]:
        met = met.unionByName(t)
    edge = scratch.store(met.select("part", "before", "left", F.inline("gone")), "edges")
    scratch.only(edge)
    n, whole = len(filters), (1 << len(filters)) - 1
    last = F.col("before") == F.element_at(F.create_map(*(x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(whole & ~(1 << i))))), F.col("filter"))
    size = F.bit_count("before")
    # An edge is on as many orders as there are of what comes before it and of what comes after.
    ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)
    of_filter = edge.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.max(F.when(last, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways).cast("long").alias("shapley"),
    )
    steps = spark.createDataFrame(orders(filters), "filter_order string, step int, filter string, before int")
    # A row for each part and step; a prefix without survivors has no edges and counts as zeros.
    asked = of_filter.join(F.broadcast(steps), "filter")
    told = asked.join(edge, ["part", "before", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = zero(F.col("removed"))
    return told.select("part", "filter_order", "step", (zero(F.col("left")) - removed).alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails", zero(F.col("good_lost")).alias("good_lost"), zero(F.col("toxic_lost")).alias("toxic_lost"), "shapley")


def query(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "measures")
    measures = scratch.store(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measures")
    out = audit(verdicts(measures, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    # The audit has stored what it told.
    scratch.only()
    return out


#: Every order applied to every distinct set of verdicts of a part, with no prefix shared.
ORACLE = """
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first_id from documents
),
labelled as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
verdict as (
  select part, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b,
    100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(first_id < doc_id, false) as e, coalesce(good, false) as good, coalesce(toxic, false) as toxic
  from words left join labelled using (doc_id)
),
kinds as (
  select part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) as fails,
    count(*) as n, count_if(good) as good, count_if(toxic) as toxic from verdict group by all
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select concat(a.f, b.f, c.f, d.f, e.f) as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps as (select filter_order, s as step, filter_order[s] as f, filter_order[1:s - 1] as earlier from orders, range(1, 6) r(s)),
each as (
  select part, filter_order, cast(step as int) as step, f, n, good, toxic, fails = f as alone, contains(fails, f) as failing,
    len(list_filter(string_split(fails, ''), lambda x: x <> '' and contains(earlier, x))) > 0 as gone
  from kinds, steps
),
told as (
  select part, filter_order, step, f, cast(coalesce(sum(n) filter (not gone and not failing), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter (not gone and failing), 0) as bigint) as removed, cast(coalesce(sum(n) filter (gone and failing), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (alone), 0) as bigint) as unique_fails, cast(coalesce(sum(good) filter (not gone and failing), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter (not gone and failing), 0) as bigint) as toxic_lost
  from each group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, f) as bigint) as shapley from told
"""
