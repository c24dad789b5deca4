"""The log-likelihood ratio against a plain computation, the cut, and columns with the operator's own names."""

import math
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from evidra.llm import quality

GOOD, BAD = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]


def rows():
    r, out = random.Random(9), []
    for i in range(160):
        w = r.choices(GOOD, k=70) + (r.choices(BAD, k=60) if i % 4 == 0 else [])
        out.append((i, " ".join(w), f"t{i}", i, "q"))
    return [*out, (200, None, None, 0, "q"), (None, "one word", None, 0, "q"), out[1]]


SCHEMA = "doc_id long, text string, t string, __row int, quality string"


def xx(b, seed=42):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(b, seed & (2**64 - 1))))[0]


def buckets(t, m):
    h = [xx(w.encode()) for w in (t or "").split()]
    return [x % m for x in h] + [xx(struct.pack("<q", b), xx(struct.pack("<q", a))) % m for a, b in zip(h, h[1:])]


def test_ratio_and_threshold(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    m = 64
    trusted = {int(r.labelled) for r in quality.labelled(labels, True, False, 10**6).collect()}
    held = {int(r.labelled) for r in quality.labelled(labels, True, True, 10**6).collect()}
    assert trusted | held == {i for i in range(120) if i % 4} and not trusted & held and held
    target, raw = [1] * m, [1] * m
    for i, t, *_ in rows():
        for b in buckets(t, m):
            raw[b] += 1
            target[b] += i in trusted
    ratio = [math.log(a / sum(target)) - math.log(b / sum(raw)) for a, b in zip(target, raw)]
    assert quality.weights(docs, labels, m) == pytest.approx(ratio)
    got = {r.doc_id: r for r in quality.quality(docs, labels, m).collect()}
    for i, t, *_ in rows():
        b = buckets(t, m)
        assert got[i].score == pytest.approx(sum(ratio[x] for x in b) / len(b) if b else 0.0, abs=1e-4)
    cut = quality.best_cut([got[i].score for i in held], [got[i].score for i in range(0, 120, 4)])
    assert {r.threshold for r in got.values()} == {cut}
    assert all(got[i].kept == (got[i].score >= cut) for i in range(160))


def test_columns_stay(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    verdicts = {r.doc_id: r.kept for r in quality.quality(docs, labels).collect()}
    assert all(verdicts[i] == (i % 4 != 0) for i in range(160))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "t", "__row").collect()) == sorted((i, t, n) for i, _, t, n, _ in rows() if i is not None and i < 160 and i % 4)


def test_cut():
    assert quality.best_cut([], [1.0]) == -math.inf
    assert quality.best_cut([0.5, 0.1], []) == 0.1
    assert quality.best_cut([1.0, 2.0], [-1.0, 0.0]) == 0.5
    assert quality.best_cut([1.0, 2.0, 3.0], [0.0, 1.5]) in (0.5, 1.75)
    assert quality.best_cut([0.0, 1.0], [2.0]) == 0.0


def test_other_ids_and_no_labels(spark):
    docs = spark.createDataFrame([("a", "w " * 60), ("b", None)], "doc_id string, text string")
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert {(r.doc_id, r.score) for r in quality.quality(docs, labels).collect()} == {("a", 0.0), ("b", 0.0)}
    assert quality.quality(docs.where(F.lit(False)), labels).collect() == []
