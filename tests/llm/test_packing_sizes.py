"""The sizes of bins: chosen together, downsized, and independent of how the input is split."""

import random

import pytest
from pyspark.sql import functions as F

from evidra.llm import packing

SMALL = (4, 8, 16)


def total(bins):
    return sum(packing.cost(c) for c, _ in bins)


def per_token(lengths):
    bins = packing.best_fit(lengths)
    assert sorted((i, s) for _, b in bins for i, s, _ in b) == [(i, 0) for i in range(len(lengths))]
    return total(bins) / sum(lengths)


def optimum(lengths, sizes):
    """The least cost of all ways to group the pieces."""
    best = [float("inf")]

    def go(i, sums, held):
        if held >= best[0]:
            return
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.cost(next(c for c in sizes if c >= s)) for s in sums))
            return
        for k in range(len(sums) + 1):
            if k == len(sums):
                go(i + 1, [*sums, lengths[i]], held)
            elif sums[k] + lengths[i] <= sizes[-1]:
                go(i + 1, [*sums[:k], sums[k] + lengths[i], *sums[k + 1 :]], held)

    go(0, [], 0.0)
    return best[0]


def test_against_the_optimum():
    r, ratios = random.Random(5), []
    for _ in range(150):
        lengths = [r.randint(1, 16) for _ in range(r.randint(1, 7))]
        got, want = total(packing.best_fit(lengths, SMALL)), optimum(lengths, SMALL)
        assert got >= want - 1e-9
        ratios.append(got / want)
    assert sum(ratios) / len(ratios) < 1.02 and sum(x < 1 + 1e-9 for x in ratios) > 120


def test_never_dearer_than_the_smallest_size():
    r = random.Random(6)
    for _ in range(200):
        lengths = [r.choice([r.randint(0, 400), r.randint(0, 5000)]) for _ in range(r.randint(1, 25))]
        plain = sum(packing.cost(c) for c, *_ in packing.filled(lengths, rule="smallest"))
        assert total(packing.best_fit(lengths)) <= plain + 1e-6


def test_similar_lengths_share_bins():
    r = random.Random(1)
    lengths = [r.randint(260, 340) for _ in range(5000)]
    assert len({c for c, *_ in packing.filled(lengths)}) > 1
    assert per_token(lengths) < 1.1


def test_pieces_are_promised_once():
    assert per_token([600] * 2000 + [400] * 100) < 1.2
    assert [c for c, *_ in packing.filled([*[600] * 7, 400, 0])] == [1024, 2048, 2048]


def test_bins_shrink_to_their_contents():
    opened = packing.filled([600, 300], rule="largest")
    assert [(c, used) for c, used, _ in opened] == [(4096, 900)]
    assert [c for c, _ in packing.best_fit([600, 300])] == [1024]


@pytest.mark.parametrize("block", [50, 20_000])
def test_bins_do_not_depend_on_splits(spark, block):
    r = random.Random(3)
    rows = [(i % 450 if i % 9 else None, " ".join(["w"] * r.choice([0, 1, 30, 300, 700, 9000])) if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    each = [sorted(map(repr, packing.pack(df.repartition(n), block=block).collect())) for n in (1, 3, 7)]
    assert each[0] == each[1] == each[2]
    bins = packing.pack(df, block=block).select(F.explode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("p")).select("p.*")
    want = df.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).alias("n"))
    got = {(x.doc_ids, x.n) for x in bins.groupBy("doc_ids").agg(F.sum("lengths").alias("n")).collect()}
    assert got == {(x.doc_id, x.n) for x in want.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert bins.where("starts = 0").count() == 500


def test_other_ids_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a", "x y", 1), ("a", "x y", 2), (None, None, 3)], "doc_id string, text string, block int")
    got = packing.pack(df).collect()
    assert sorted(x or "" for r in got for x in r.doc_ids) == ["", "a", "a"] and sum(r.used for r in got) == 4
    assert packing.pack(df.where("false")).collect() == []
