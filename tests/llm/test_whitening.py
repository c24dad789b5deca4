"""Whitening against a decomposition of the whole covariance."""

import math

import numpy as np
import pytest

from evidra.llm import whitening as w

VECTORS = "vec_id long, embedding array<float>, label int, n long, x string, component string, dims int"


def frame(make, rows, parts=5):
    return make([(i, v, 1, 2, "x", "c", 3) for i, v in rows], VECTORS).repartition(parts)


def whole(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(make, rows, parts=5):
    got = w.whiten(frame(make, rows, parts)).collect()
    told = {}
    for r in got:
        told.setdefault((r.vec_id, r.n, r.deviation), []).append(r)
    usable = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    want = 0
    for d in {len(x) for _, x in usable} - {0}:
        fit = np.array(sorted({tuple(x) for _, x in usable if len(x) == d}), dtype=np.int64).reshape(-1, d)
        n, total = len(fit), [int(s) for s in fit.astype(object).sum(axis=0)]
        c = (n * fit - np.array(total, np.int64)).astype(float) / n
        e, v = np.linalg.eigh(c.T @ c / n)
        e, v = e[::-1], v[:, ::-1]
        k = min(16, int((e > 1e-18 * max(e[0], 1e-300)).sum())) if e[0] > 0 else 0
        # numpy's smallest eigenvalues round; what has no variance was left out by the operator.
        k = min(k, int((e > 1e-9 * e[0]).sum())) if k else 0
        for i, x in usable:
            if len(x) != d or not k:
                continue
            gap = [n * a - s for a, s in zip(x, total, strict=True)]
            mine = sorted(told[i, n, sum(g * g for g in gap)], key=lambda r: r.component)[:: sum(1 for j, y in usable if (j, y) == (i, x))]
            assert [r.component for r in mine] == list(range(1, k + 1))
            wanted = np.array(gap, float) / n @ v[:, :k] / np.sqrt(e[:k])
            assert np.allclose(np.abs([r.whitened for r in mine]), np.abs(wanted), atol=1e-6)
            assert np.allclose([r.explained for r in mine], e[:k] / e.sum(), rtol=1e-9)
            assert all(r.identity_error <= 1e-9 for r in mine)
            want += k
    assert len(got) == want
    return got


def test_against_eigenvectors(make):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 24)) * np.linspace(3, 0.5, 24) + np.linspace(-2, 2, 24)
    rows = list(enumerate(x.tolist())) + [(1000 + i, x[3].tolist()) for i in range(400)] + [(5, x[5].tolist()), (None, x[9].tolist())]
    got = check(make, rows)
    # One sign for all rows: the whitened vectors of the fit list have mean zero and unit variance, and agree in sign with the component.
    one = {r.vec_id: r.whitened for r in got if r.component == 1 and r.vec_id is not None and r.vec_id < 700}
    assert abs(np.mean(list(one.values()))) < 1e-9
    assert abs(np.corrcoef([one[i] for i in range(700)], x[:, 0])[0, 1]) > 0.9


def test_odd_rows_lengths_and_rank(make):
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [2.5])]
    rows += [(10 + i, [float(i), 2.0 * i, 7.0]) for i in range(6)] + [(30 + i, [i * 0.5, -i * i * 0.25]) for i in range(9)]
    got = check(make, rows)
    assert {r.component for r in got if 10 <= r.vec_id < 16} == {1}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [])]])
def test_without_variance_there_are_no_rows(make, rows):
    assert w.whiten(frame(make, rows, 2)).collect() == []


def test_huge_components(make):
    got = w.whiten(frame(make, [(i, [(-1.0) ** i * 1e37, float(i)]) for i in range(4)])).collect()
    assert got and all(r.deviation is None and math.isfinite(r.whitened) for r in got)


def test_merging_loses_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (3000, 12)).astype(np.int64) + 1_000_000
    whole_ = w.of_chunk(x)
    for cuts in ([1, 2, 5, 1500], [2999], list(range(100, 3000, 100))):
        s = w.all_merged(w.of_chunk(p) for p in np.split(x, cuts))
        assert (s.n, s.sums) == (whole_.n, whole_.sums)
        assert np.allclose(s.r.T @ s.r, whole_.r.T @ whole_.r, rtol=1e-10)
        assert s.r.shape == (12, 12)


def test_levels_of_merging(spark, make):
    rng = np.random.default_rng(4)
    rows = list(enumerate(rng.standard_normal((300, 4)).tolist()))
    from pyspark.sql import functions as F

    from evidra.llm.common import Scratch

    v = frame(make, rows).select(w.shifted(F.col("embedding")).alias("x")).distinct().repartition(40)
    (one,) = w.fitted(v, Scratch(spark, "levels")).collect()
    assert one.n == 300
