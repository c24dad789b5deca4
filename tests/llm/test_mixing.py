"""Mixing against a plain computation of exponent, budgets and permutation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evidra.llm import mixing
from evidra.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string, weight double, full int, block string"


def rows():
    r = random.Random(3)
    out = []
    for i, s in enumerate(["big"] * 400 + ["mid"] * 150 + ["low"] * 60 + [None] * 30):
        out.append((i, " ".join(["w"] * r.randint(0, 20)) if i % 50 else None, s, 0.5, i, "b"))
    return [*out, out[7], out[7], (None, "x y", "low", None, None, None)]


def tokens(t):
    return max(1, len((t or "").split()))


def shares(data):
    total = {}
    for _, t, s, *_ in data:
        total[s] = total.get(s, 0) + tokens(t)
    return total, {s: n / sum(total.values()) for s, n in total.items()}


def weights(p, a):
    z = sum(x**a for x in p.values())
    return {s: x**a / z for s, x in p.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def slow_exponent(p, repeat, target, times=None):
    """The smallest a on a fine grid whose limits hold, under a budget of times all tokens or one pass over the largest source."""
    for k in range(20_001):
        a = k / 20_000
        w = weights(p, a)
        spend = times or max(p.values()) / w[max(p, key=p.get)]
        if max(w[s] * spend / p[s] for s in p) <= repeat * (1 + 1e-9) and (target is None or entropy(w) <= target + 1e-9):
            return a
    return 1.0


@pytest.mark.parametrize("how", [{"repeat": 2.0}, {"repeat": 50.0, "entropy": 1.1}, {"repeat": 50.0, "evenness": 0.5}, {"repeat": 50.0, "evenness": 0.0}, {"repeat": 3.0, "evenness": 0.9, "budget": 4000.0}])
def test_against_a_plain_computation(spark, how):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    total, p = shares(data)
    h1 = entropy(p)
    target = how.get("entropy")
    if "evenness" in how:
        target = h1 + how["evenness"] * (math.log(len(p)) - h1)
    a = slow_exponent(p, how["repeat"], target, "budget" in how and how["budget"] / sum(total.values()))
    w = weights(p, a)
    out = mixing.mix(docs, **how).select("row.*", "pass", F.col("block").alias("at"), "u", F.col("weight").alias("__w")).collect()
    for s, x in {(r.source, r["__w"]) for r in out}:
        assert x == pytest.approx(w[s], abs=2e-4)
    exact = {r.source: r["__w"] for r in out}
    spend = how.get("budget") or max(exact[s] and total[s] / exact[s] for s in total if p[s] == max(p.values()))
    # The permutation: passes in full, and a first part by (block, u) in which equal hashes go together.
    order = {}
    prepared = mixing._prepared(docs, math.isqrt(len(data))).select("source", "tokens", "u", "block", "row.doc_id", "row.text").collect()
    for r in prepared:
        order.setdefault(r.source, {}).setdefault((r.block, r.u), []).append(r)
    want = {}
    for s, groups in order.items():
        key = None if s == "" else s[1:]
        passes = min(exact[key] * spend / total[key], how["repeat"])
        full = math.floor(passes + 1e-9)
        left = math.floor((passes - full) * total[key] + 1e-6)
        open_ = True
        for k in sorted(groups):
            cost = sum(r.tokens for r in groups[k])
            open_ = open_ and cost <= left
            left -= cost if open_ else 0
            for r in groups[k]:
                want[(r.doc_id, r.text, r.source)] = want.get((r.doc_id, r.text, r.source), 0) + full + open_
    got = {}
    for r in out:
        k = (r.doc_id, r.text, "" if r.source is None else "=" + r.source)
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_order_and_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(repr, mixing.mixed_documents(docs, repeat=4.0).collect())) == sorted(map(repr, mixing.mix(docs, repeat=4.0).select("row.*").collect()))
    assert list(map(repr, mixing.mixed_documents(docs.coalesce(1), repeat=4.0).collect())) == list(map(repr, mixing.mixed_documents(docs, True, repeat=4.0).collect()))
    out = mixing.mixed_documents(docs, True, repeat=4.0)
    assert out.columns == docs.columns
    marked = mixing.mix(docs, repeat=4.0).select("row.doc_id", "pass", "block", "u").collect()
    at = {}
    for r in marked:
        at.setdefault(r.doc_id, []).append((r["pass"], r.block, r.u))
    keys = [sorted(at[r.doc_id]) for r in out.collect()]
    seen, path = {}, []
    for r, k in zip(out.collect(), keys, strict=True):
        n = seen[r.doc_id] = seen.get(r.doc_id, -1) + 1
        path.append(k[n])
    assert path == sorted(path) and max(x[0] for x in path) > 1
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_one_source_no_source_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert mixing.mix(one, evenness=0.5).count() == 3
    assert mixing.mix(one.withColumn("source", F.lit(None).cast("string"))).count() == 3
    assert mixing.mix(one.where("false"), evenness=0.5).collect() == []
    assert mixing.exponent(spark.createDataFrame([], "p double"), 2.0, None, 0.5) == (1.0, 0.0)
    assert Scratch(spark, "x").tables == []


def shares_of(spark, *tokens):
    total = sum(tokens)
    return spark.createDataFrame([(str(i), t / total) for i, t in enumerate(tokens)], "source string, p double")


def power_entropy(tokens, a):
    w = [t**a for t in tokens]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w if x)


@pytest.mark.parametrize("target", [0.898, 0.7, 0.5, 0.1, 1e-3])
def test_a_target_below_the_entropy_of_the_shares(spark, target):
    a, log_z = mixing.exponent(shares_of(spark, 6, 3, 1), 2.0, target, None)
    assert a > 1 or target > 0.89
    assert abs(power_entropy([6, 3, 1], a) - target) < 1e-5
    assert abs(log_z - math.log(sum((t / 10) ** a for t in (6, 3, 1)))) < 1e-9


def test_targets_that_no_exponent_meets(spark):
    for tokens, target, times in (([5, 5], 0.5, None), ([4, 4, 2], 0.6, None), ([6, 3, 1], -0.1, None), ([6, 3, 1], None, 2.5), ([9, 1], 0.1, 2.0)):
        with pytest.raises(ValueError):
            mixing.exponent(shares_of(spark, *tokens), 2.0, target, None, times)
    assert mixing.exponent(shares_of(spark, 4, 4, 2), 2.0, math.log(2) + 1e-3, None)[0] > 5


def test_the_limit_holds_under_the_budget(make):
    """90 + 10 documents: with twice the limit's room the weights even out only as far as no source is passed over more often."""
    docs = make([(i, "w " * 10, "en", "large" if i < 90 else "small", 1) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    for times, repeat in ((1.0, 2.0), (1.9, 2.0), (4.0, 5.0)):
        m = mixing.mix(docs, repeat=repeat, evenness=1.0, budget=times * 1000).select("row.source", "weight").collect()
        n = {s: sum(r.source == s for r in m) for s in ("large", "small")}
        weight = {r.source: r.weight for r in m}
        assert abs(sum(n.values()) - 100 * times) <= 2
        assert all(abs(n[s] / (100 * times) - weight[s]) <= 0.02 for s in n)
        assert n["small"] <= 10 * repeat + 1e-6 and n["small"] >= int(10 * times)
    with pytest.raises(ValueError):
        mixing.mix(docs, repeat=2.0, evenness=1.0, budget=4000.0)


def test_a_sharper_mixture_is_realised(make):
    docs = make([(i, "w " * 10, "en", "abc"[0 if i < 600 else 1 if i < 900 else 2], 1) for i in range(1000)], "doc_id long, text string, lang string, source string, n_chars long")
    m = mixing.mix(docs, entropy=0.5).select("row.source").collect()
    n = {s: sum(r.source == s for r in m) for s in "abc"}
    assert n["a"] == 600 and abs(-sum(x / len(m) * math.log(x / len(m)) for x in n.values() if x) - 0.5) < 0.02
