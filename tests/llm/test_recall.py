"""Recall of the embedding near-duplicates at the threshold, for wide substrings and vectors with a common direction."""

import numpy as np
import pytest

from evidra.llm import vector_near_dup


def pairs(n, mean, dims=64, seed=11, cosine=0.93):
    """Unit vectors with this mean cosine, and partners at the threshold."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)) / np.sqrt(dims) * np.sqrt(1 - mean)
    x[:, 0] += np.sqrt(mean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = r.standard_normal((n, dims))
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * e


@pytest.mark.parametrize("width", [16, 20, 24])
@pytest.mark.parametrize("mean", [0.0, 0.5, 0.64])
def test_recall_by_width(width, mean):
    center, turn, width, far = vector_near_dup.fitted(pairs(10_000, mean, seed=1)[0], width, 0.93)
    x, y = pairs(5000, mean)
    differ = (((x - center) @ turn >= 0) != ((y - center) @ turn >= 0)).reshape(len(x), -1, width).sum(axis=2)
    assert ((differ <= 1).any(axis=1) & (differ.sum(axis=1) <= far)).mean() >= 0.99


@pytest.mark.parametrize("width, mean", [(16, 0.0), (20, 0.5)])
def test_recall_of_links(spark, width, mean):
    x, y = pairs(500, mean, cosine=0.9301)
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*x, *y])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in vector_near_dup.near_duplicates(df, width=width).collect()}
    assert sum(got[i + 500] == i for i in range(500)) >= 0.98 * 500
