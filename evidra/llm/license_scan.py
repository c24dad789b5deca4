"""License scans by diagonal voting, in native expressions.

All rolling word K-gram hashes of a text are joined with the positions of license templates. A match
at text position p and template position q votes for the diagonal p - q. Votes are counted by
(document, template, diagonal), diagonals at most GAP apart are merged, which bridges inserted or lost
words, and a merged run counts when it covers enough of the template's words within a span of about
its length. Matching K-grams are compared word by word before they vote.

Of a text only what matches leaves its row: its K-grams are looked up in the set of the templates' hashes, and a hit carries its
own words and the places of qualifiers near it, so a text full of notices makes rows of bounded size, as many as it has hits.

A run is then verified: it must cover the words by which its license is told from others (TELLING), and
none of the text's words that it leaves uncovered, inside it or where its template's first or last words
are missing, may name another license (QUALIFIERS). Of runs of different labels that overlap, only
those with the best cover stay; a run is compared with those that begin near enough to overlap, in the order of the text.

The templates are a constant of this module, so their table is broadcast. Each text also carries one
marker that always matches, so documents without a hit stay in the result after a single scan; only
markers and votes are shuffled.

Defined results: null and empty texts have no words and no labels. Null ids form results like others.
Repeated rows are counted once and returned as often as they occur. Ties between templates give all
their labels. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters between words, after lower-casing A-Z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals at most so far apart belong together.
GAP = 3
#: Part of a template's words that a run must cover.
COVER = 0.6

# The phrases that the contract names, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Sentences of public licenses and of their usual notices, with labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]

#: Words of each label that a run must cover where its template has them.
TELLING = {
    "mit": "mit obtaining deal",
    "apache-2": "apache 2",
    "bsd": "redistribution source binary conditions",
    "isc": "use copy fee copies",
    "gpl-3": "gnu general 3",
    "gpl": "gnu general",
    "lgpl": "gnu lesser",
    "mpl-2": "mozilla 2",
    "unlicense": "unencumbered public domain",
    "cc-by-nc": "by nc attribution noncommercial",
    "cc-by-sa": "attribution sharealike",
    "cc-by": "attribution",
}
#: Words that make another license of one when they are put in.
QUALIFIERS = ["affero", "apache", "lesser", "library", "mit", "mozilla", "nc", "nd", "noncommercial", "non", "noderivatives", "noderivs", "sa", "share", "sharealike"]


def _hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def positions(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """(gram, tid, label, base, words, must, q, phrase): a row for each K-gram of each template, and the marker."""
    values = []
    for tid, (label, text, base) in enumerate(templates):
        w = text.split()
        must = [] if base else [w.index(x) for x in TELLING.get(label, "").split() if x in w]
        values += [f"({tid}, '{label}', {str(base).lower()}, {len(w)}, cast(array({', '.join(map(str, must))}) as array<int>), {q}, '{' '.join(w[q : q + K])}')" for q in range(len(w) - K + 1)]
    t = spark.sql("select * from values " + ", ".join(values) + " as t(tid, label, base, words, must, q, phrase)")
    part = [F.xxhash64(F.get(F.split("phrase", " "), i)) for i in range(K)]
    marker = spark.sql("select -1 as tid, '' as label, false as base, 0 as words, cast(array() as array<int>) as must, 0 as q, '' as phrase, 0L as gram")
    return t.withColumn("gram", _hash(*part)).unionByName(marker)


def runs(docs: DataFrame, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """For each distinct row of docs (doc_id, text): copies, n_words, and runs: array of (label, base, first_word, end_word, cover).

    first_word and end_word are word positions from 0, the end exclusive.
    """
    spark = docs.sparkSession
    places_of = positions(spark, templates)
    longest = max((len(text.split()) for _, text, _ in templates), default=0)
    # As many as the templates have words.
    hashes = [r.gram for r in places_of.where("tid >= 0").select("gram").distinct().collect()]
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.xxhash64(t).alias("same"), F.filter(F.split(F.translate(t, string.ascii_uppercase, string.ascii_lowercase), BREAK), lambda w: w != "").alias("words_"))
    d = d.withColumn("h", F.transform("words_", lambda w: F.xxhash64(w)))
    n = F.size("words_")
    grams = F.transform(F.slice("h", 1, F.greatest(n - (K - 1), F.lit(0))), lambda x, i: F.struct(i.alias("p"), _hash(x, F.get(F.col("h"), i + 1), F.get(F.col("h"), i + 2)).alias("gram")))
    d = d.withColumn("found", F.filter(grams, lambda g: g["gram"].isin(hashes)))

    def carried(g):
        # Where qualifiers stand before and behind the K-gram, as far as a run may reach.
        first = F.greatest(g["p"] - 1, F.lit(0))
        near = F.transform(F.slice("words_", first + 1, 1 + K + 2 * longest), lambda w, i: F.when(w.isin(QUALIFIERS), (first + i).cast("long")))
        named = F.filter(near, lambda x: x.isNotNull() & ((x < g["p"]) | (x >= g["p"] + K)))
        return F.struct(g["p"].cast("long").alias("p"), g["gram"].alias("gram"), F.array_join(F.slice("words_", g["p"] + 1, K), " ").alias("said"), named.alias("named"))

    marker = F.struct(F.lit(-1).cast("long").alias("p"), F.lit(0).cast("long").alias("gram"), F.lit("").alias("said"), F.array().cast("array<bigint>").alias("named"))
    # The outer form, as the plain one infers a filter that repeats the whole expression at the scan.
    each = d.select("doc_id", "same", n.cast("long").alias("n_words"), F.explode_outer(F.concat(F.array(marker), F.transform("found", carried))).alias("hit")).select("doc_id", "same", "n_words", "hit.*")
    # Hashes may be equal by chance; a vote needs the very words.
    votes = each.join(F.broadcast(places_of), "gram").where((F.col("tid") < 0) == (F.col("p") < 0)).where(F.col("said") == F.col("phrase"))
    votes = votes.select("doc_id", "same", "tid", "label", "base", "words", "must", "named", "q", "p", "n_words")
    by = ["doc_id", "same", "tid", "label", "base", "words"]
    diagonals = votes.groupBy(*by, (F.col("p") - F.col("q")).alias("diagonal")).agg(F.max("must").alias("must"), F.array_distinct(F.flatten(F.collect_set("named"))).alias("named"), F.collect_set("q").alias("qs"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n"), F.max("n_words").alias("n_words"))
    at = Window.partitionBy("doc_id", "same", "tid").orderBy("diagonal")
    # Base phrases are whole or not there, so their diagonals are never merged.
    starts = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(at) > GAP) | F.col("base"), F.lit(True))
    merged = diagonals.withColumn("new", starts.cast("int")).withColumn("run", F.sum("new").over(at))
    places = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("qs")), lambda q: F.sequence(q, q + K - 1))))
    texts = F.flatten(F.collect_list(F.transform("qs", lambda q: q + F.col("diagonal"))))
    run = merged.groupBy(*by, "run").agg(F.max("must").alias("must"), F.flatten(F.collect_list("named")).alias("named"), texts.alias("texts"), places.alias("places"), F.min("lo").alias("first_word"), (F.max("hi") + K).alias("end_word"), F.max("n").alias("n"), F.max("n_words").alias("n_words"))
    run = run.withColumn("covered", F.size("places"))
    cover = F.coalesce(F.try_divide(F.col("covered"), F.col("words")), F.lit(0.0))
    since = F.col("first_word") - (F.array_min("places") > 0).cast("int")
    until = F.col("end_word") + (F.array_max("places") < F.col("words") - 1).cast("int")
    other = F.exists("named", lambda x: (x >= since) & (x < until) & ~F.exists("texts", lambda t: (x >= t) & (x < t + K)))
    verified = (F.size(F.array_except("must", "places")) == 0) & ~other
    good = F.when(F.col("base"), F.col("covered") == F.col("words")).otherwise((cover >= COVER) & (F.col("end_word") - F.col("first_word") <= 2 * F.col("words")) & verified)
    # A run that counts spans at most twice its template, so one that overlaps it begins within as many words.
    reach = 2 * longest
    nearby = Window.partitionBy("doc_id", "same").orderBy("first_word").rangeBetween(-reach, reach)
    counts = run.withColumn("good", (F.col("tid") >= 0) & F.coalesce(good, F.lit(False))).withColumn("cover", cover).where("good or tid < 0")
    rivals = F.collect_list(F.when(F.col("good") & ~F.col("base"), F.struct("label", "cover", "first_word", "end_word"))).over(nearby)
    beaten = F.exists("rivals", lambda y: (y["label"] != F.col("label")) & (y["cover"] > F.col("cover")) & (y["first_word"] < F.col("end_word")) & (F.col("first_word") < y["end_word"]))
    kept = counts.withColumn("rivals", rivals).withColumn("kept", F.col("good") & (F.col("base") | ~beaten))
    one = F.when(F.col("kept"), F.struct("label", "base", "first_word", "end_word", "cover"))
    return kept.groupBy("doc_id", "same").agg(F.max("n_words").alias("n_words"), F.max(F.when(F.col("tid") < 0, F.col("n"))).alias("copies"), F.collect_list(one).alias("runs"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, runs."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    of = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in templates]
    r = runs(docs, of)
    base = F.filter("runs", lambda x: x["base"])

    def joined(a):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")

    places = F.transform(base, lambda x: x["first_word"])
    out = r.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("runs")).alias("labels"),
        F.coalesce(F.array_max(F.transform("runs", lambda x: F.least(x["cover"], F.lit(1.0)))), F.lit(0.0)).alias("score"),
        "runs",
        F.explode(F.sequence(F.lit(1), "copies")).alias("__copy"),
    )
    return out.drop("__copy")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("runs")
