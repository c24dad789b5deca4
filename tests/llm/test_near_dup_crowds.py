"""Sets that share frequent hashes, compared in blocks, against all pairs."""

import numpy as np
import pytest

from evidra.llm import near_dup as N
from evidra.llm.common import Scratch


def made(n, least, seed):
    """n sets around one: some similar to each other as linked sets are, most a bit less."""
    r = np.random.default_rng(seed)
    center = r.integers(0, 2**63, 120, dtype=np.uint64)
    keep = r.uniform(least, 1.0, n)
    return [np.unique(np.concatenate((center[r.random(120) < k], r.integers(0, 2**63, int(120 * (1 - k)), dtype=np.uint64)))) for k in keep]


def low(n, links):
    """The smallest index that each of n reaches."""
    out = list(range(n))
    while any(out[i] != out[j] for i, j in links):
        for i, j in links:
            out[i] = out[j] = min(out[i], out[j])
    return out


def all_links(sets):
    n = range(len(sets))
    return [(i, j) for i in n for j in n if i < j and N.linked(sets[i].tobytes(), sets[j].tobytes(), 75)]


@pytest.mark.parametrize("first", [0, 1, 25])
def test_a_block(first):
    sets = made(60, 0.7, 5)
    comps = np.arange(60) // 2 * 7
    of_same = [(i, i + 1) for i in range(0, 60, 2)]
    got = N.spanning(comps, sets, first, 75)
    links = all_links(sets)
    wanted = [(i, j) for i, j in links if not first or i < first <= j]
    assert set(got) <= set(wanted) and len(got) <= 29
    assert low(60, [*got, *of_same]) == low(60, [*wanted, *of_same])
    assert N.spanning(np.zeros(60), sets, first, 75) == []


def test_rows_of_a_crowd(spark, monkeypatch):
    sets = made(500, 0.6, 9)
    monkeypatch.setattr(N, "BLOCK", 40)
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, hashes binary")
    pairs, links = N._rest(Scratch(spark, "crowd"), rows.selectExpr("node", "node as c"), rows, 75)
    pairs, links = ([tuple(r) for r in x.collect()] for x in (pairs, links))
    wanted = all_links(sets)
    assert len(pairs) < N.CROWD * 500 and len(links) < 20 * 500 and len(wanted) > 1000
    assert set(links) <= set(wanted)
    assert low(500, [*links, *(p for p in map(lambda p: (min(p), max(p)), pairs) if p in set(wanted))]) == low(500, wanted)
