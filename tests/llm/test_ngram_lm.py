import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import ngram_lm as lm


def words(text):
    return [*(text or "").encode().translate(lm.LOWER).split(), None]


def brute(docs, order=3, least=1):
    """Interpolated absolute discounting over dictionaries, n-grams seen less than least times left out."""
    train = [words(t) for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for d in train for w in d)
    n, v = sum(uni.values()), len(uni)
    grams = {1: dict(uni)}
    total, rest = {}, {}
    for k in range(2, order + 1):
        c = Counter(tuple(d[i : i + k]) for d in train for i in range(len(d) - k + 1))
        if k > 2:
            c = Counter({g: x for g, x in c.items() if g[:-1] in grams[k - 1]})
        for g, x in c.items():
            total[g[:-1]] = total.get(g[:-1], 0) + x
        grams[k] = {g: x for g, x in c.items() if x >= least}
        for g, x in grams[k].items():
            rest[g[:-1]] = rest.get(g[:-1], 1) - (x - lm.DISCOUNT) / total[g[:-1]]

    def p(context, w):
        if not context:
            return (uni.get(w, 0) + 1) / (n + v + 1)
        lower = p(context[1:], w)
        k = len(context) + 1
        known = k == 2 or context in grams[k - 1]
        if not known:
            return lower
        out = rest.get(context, 1) * lower
        if (*context, w) in grams[k]:
            out += (grams[k][(*context, w)] - lm.DISCOUNT) / total[context]
        return out

    out = {}
    for i, t in docs:
        d = words(t)
        base = sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in d)
        score = sum(math.log10(p(tuple(d[max(0, j - order + 1) : j]), w)) for j, w in enumerate(d))
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(d), sum(w in uni for w in d), n, base, score)
    return out


@pytest.fixture(scope="module")
def docs():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["É", "x" * 50]
    out = [(i, " ".join(r.choices(vocab, k=r.randrange(0, 60)))) for i in range(150)]
    return [*out, (150, None), (151, ""), (152, "the the the unseen"), (153, " \t\n"), (154, "a b " * 4000)]


@pytest.mark.parametrize("order, least, span", [(2, 1, 2_000_000), (3, 1, 200), (3, 2, 2_000_000), (3, 2, 37), (1, 1, 500)])
def test_same_as_brute_force(spark, docs, order, least, span):
    df = spark.createDataFrame([(str(i), t, 1) for i, t in docs], "doc_id string, text string, held_out int")
    scored = lm.score(df, F.crc32(F.col("doc_id")) % 7 == 2, order, least, span)
    got = {int(r.doc_id): tuple(r)[1:] for r in scored.collect()}
    want = brute(docs, order, least)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4], i
        assert got[i][4] == pytest.approx(w[4], abs=1e-6)
        assert got[i][5] == pytest.approx(w[5], abs=2e-3 * w[1]), i


def test_null_ids_repeated_rows_and_extra_columns(spark):
    rows = [(None, "a b a b", 1), (7, "a b", 2), (7, "a b", 2), (8, "A  c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = lm.score(df, F.col("doc_id") == 8).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, False, 5, 5, 11), (7, False, 3, 3, 11), (7, False, 3, 3, 11), (8, True, 3, 2, 11)]


def test_a_frequent_word_is_split():
    counts = np.array([5, 1, 1, 900, 1, 1, 1, 50])
    cuts = lm.cuts_of(counts, 100)
    assert cuts == [0, 4] and lm.cuts_of(np.array([], np.int64), 100) == [0]
    many = lm.cuts_of(np.full(1000, 10), 100)
    assert many == list(range(0, 1000, 10))


def test_keys_beyond_64_bits():
    r = np.random.default_rng(2)
    ctx, word = r.integers(0, 2**50, 3000), r.integers(0, 2**30, 3000)
    ctx[1500:], word[1500:] = ctx[:1500], word[:1500]
    wide = lm.paired(ctx, word, 31, 2**50)
    assert wide.dtype == lm.PAIR and lm.paired(ctx & 0xFFFF, word, 31, 2**16).dtype == np.uint64
    keys, counts = lm.summed(wide, None)
    assert (counts == 2).all()
    keys, counts = lm.summed(np.concatenate((keys, keys)), np.concatenate((counts, counts)))
    a, b = lm.unpaired(keys, 31)
    assert list(zip(a, b)) == sorted(set(zip(ctx.tolist(), word.tolist()))) and (counts == 4).all()


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []


def test_elias_fano():
    r = np.random.default_rng(1)
    crowd = np.concatenate((np.full(300, 7), np.arange(9, 9 + 200), [10**6, 10**6 + 500_000]))
    for n, top in ((1, 5), (100, 120), (1000, 10**9), (3000, 2**40), (len(crowd), 0)):
        v = np.sort(r.integers(0, top, n)) if top else crowd
        e = lm.EliasFano(lm.EliasFano.arrays(v, "x"), "x")
        assert (e[np.arange(n)] == v).all()
        if n > 1:
            assert [x.tolist() for x in e.ends(np.arange(n - 1))] == [v[:-1].tolist(), v[1:].tolist()]
        one = np.unique(v)
        e = lm.EliasFano(lm.EliasFano.arrays(one, "x"), "x")
        ask = np.concatenate((one, r.integers(0, int(v[-1]) + 9, 500)))
        got = e.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(one)))
        at = np.minimum(np.searchsorted(one, ask), len(one) - 1)
        assert (got == np.where(one[at] == ask, at, -1)).all()
