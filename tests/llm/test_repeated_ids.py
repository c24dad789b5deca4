"""Ids that occur with several texts or vectors lose no links."""

import numpy as np
import pytest

from evidra.llm import near_dup, vector_near_dup

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))


def test_texts_of_one_id(spark):
    df = spark.createDataFrame([(5, A), (5, B), (6, A + " more"), (7, B + " more"), (8, "else " * 3), (8, "else " * 3), (None, A)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True), (8, 8, True)]
    left = sorted((r.doc_id or 0, r.text) for r in near_dup.keep_one(df).collect())
    assert left == sorted([(0, A), (5, A), (5, B), (8, "else " * 3)])


def test_an_id_joins_what_its_texts_reach(spark):
    df = spark.createDataFrame([("3", A), ("5", A), ("5", B), ("7", B)], "doc_id string, text string")
    assert {r.component_id for r in near_dup.near_duplicates(df).collect()} == {"3"}
    assert sorted(map(tuple, near_dup.keep_one(df).collect())) == [("3", A), ("5", B)]


def test_percent_below_the_bands(spark):
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame([(1, A)], "doc_id long, text string"), 70)


def near(v, seed):
    e = np.random.default_rng(seed).standard_normal(len(v))
    e -= e @ v / (v @ v) * v
    return 0.98 * v + 0.2 * e / np.linalg.norm(e) * np.linalg.norm(v)


def test_vectors_of_one_id(spark):
    r = np.random.default_rng(2)
    a, b = r.standard_normal((2, 32))
    rows = [(5, a), (5, b), (6, near(a, 1)), (7, near(b, 2)), (8, r.standard_normal(32))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, vector_near_dup.near_duplicates(df).collect()))
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False), (8, 0, 8, True)]


def test_vectors_of_other_lengths(spark):
    r = np.random.default_rng(4)
    short = r.standard_normal(3)
    long = r.standard_normal(300)
    rows = [*enumerate(r.standard_normal((200, 16))), (1000, short), (1001, 2 * short), (1002, -short), (1003, long), (1004, near(long, 5))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in vector_near_dup.near_duplicates(df).where("vec_id >= 1000").collect()}
    assert got == {1000: (1, 1000), 1001: (1, 1000), 1002: (0, 1002), 1003: (1, 1003), 1004: (1, 1003)}


def test_sample_without_usable_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(i, [0.0, 0.0, 0.0], 1) for i in range(50)] + [(100, v, 1), (101, v, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x.n_links for x in vector_near_dup.near_duplicates(df, sample=5).where("vec_id >= 100").collect()}
    assert got == {100: 1, 101: 1}
