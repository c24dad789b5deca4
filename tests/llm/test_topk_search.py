"""Exact search against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import topk_search as s

VECTORS = "vec_id long, embedding array<float>, label int, size double, x int, query string, rank int"


def whole(v):
    return None if v is None or any(c is None or not math.isfinite(c) for c in v) else [math.floor(64 * float(np.float32(c))) for c in v]


def brute(rows, k):
    usable = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    out = {}
    for i, q in usable:
        if i is not None and i % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for j, v in usable if j != i and len(v) == len(q)]
            for rank, (score, null, j) in enumerate(sorted(scored)[:k], 1):
                out[i, rank] = (None if null else j, -score)
    return out


def found(make, rows, k=s.K, **how):
    df = make([(i, v, 1, 0.0, 1, "q", 3) for i, v in rows], VECTORS).repartition(3)
    got = s.top_k(df, F.col("vec_id") % 20 == 0, k, **how).collect()
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}


def clustered(n, d, spread, seed, lengths=(1.0, 1.0)):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    x = centres[rng.integers(0, 8, n)] + spread * rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(*lengths, (n, 1))).tolist()


@pytest.mark.parametrize(("spread", "lengths"), [(0.1, (1.0, 1.0)), (1.0, (0.1, 30.0))])
def test_against_brute_force(make, monkeypatch, spread, lengths):
    # Small runs, blocks and buckets, so that all of them are crossed.
    for name, value in {"SEED": 64, "RUN": 50, "PER_BUCKET": 100}.items():
        monkeypatch.setattr(s, name, value)
    rows = list(enumerate(clustered(900, 16, spread, 3, lengths)))
    assert found(make, rows, block=120, batch=16) == brute(rows, s.K)


def test_copies_ties_and_odd_rows(make):
    copy, other = [0.5, -0.25, 1.0, 0.0], [-1.0, 2.0, 0.25, 3.0]
    rows = [(i, copy) for i in range(400)] + [(i, other) for i in range(400, 430)]
    rows += [(440, None), (460, [1.0, None, 0.0, 0.0]), (480, [float("nan"), 0.0, 0.0, 0.0]), (500, [float("-inf")] * 4), (520, []), (521, []), (540, [0.0] * 4), (560, [1.0, 2.0]), (None, copy), (None, other)]
    rows += [(441, [-0.001] * 4), (600, [1e30, 1.0, 1.0, 1.0][:4])][:1]
    assert found(make, rows, block=50, batch=4) == brute(rows, s.K)


def test_repeated_query_is_answered_once(make):
    v = clustered(60, 8, 0.5, 1)
    rows = [*enumerate(v), (20, v[20]), (21, v[21])]
    assert found(make, rows) == brute(rows, s.K)


def test_fewer_than_k_and_nothing(make):
    assert found(make, [(0, [1.0]), (1, [-2.0])]) == {(0, 1): (1, -8192)}
    assert found(make, [(0, [1.0])]) == {}
    assert found(make, []) == {}


def test_huge_components_saturate(make):
    got = found(make, [(0, [1e30]), (1, [1e30]), (2, [1.0])])
    assert got[0, 1] == (1, 2**63 - 1)


def test_coordinates_prune_and_lose_nothing():
    x = np.array(clustered(2000, 32, 0.2, 5)) * 64 // 1
    size = np.linalg.norm(x, axis=1)
    at = np.argsort(-size)
    x, size = x[at].astype(np.int64), size[at]
    run = s.Run(x, size, np.arange(len(x)), np.zeros(len(x), bool))
    for q in range(0, 200, 10):
        u = x[q] / size[q]
        cosines = x @ x[q] / size / size[q]
        least = np.full(len(x), 0.8)
        kept = run.by_coordinates(u, np.argsort(-np.abs(u))[: s.FOCUS], 0.8, least)
        assert set(np.flatnonzero(cosines >= 0.8)) <= set(kept)
        assert len(kept) < len(x) / 3


def test_long_vectors_ask_for_short_prefixes(make):
    # Queries that need much stay away from short vectors: no rows of theirs are made for those.
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(8) * (10.0 if i < 200 else 0.01)).tolist()) for i in range(3000)]
    assert found(make, rows, block=64, batch=8) == brute(rows, s.K)
