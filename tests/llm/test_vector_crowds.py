"""Groups of near copies, compared in blocks, against all pairs."""

import numpy as np
import pytest

from evidra.llm import vector_near_dup as V


def all_pairs(rows):
    """{id: (links, smallest id reachable)}."""
    ids = [i for i, _, _ in rows]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in rows])
    label = np.array([k for _, _, k in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(near, low[None, :], len(x)).min(axis=1))
        if (new == low).all():
            break
        low = new
    return {i: (int(near[k].sum()), ids[low[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("spread", [0.02, 0.17])
def test_a_crowd(spark, spread):
    r = np.random.default_rng(3)
    center, side = r.standard_normal((2, 32))
    vectors = [center + spread * r.standard_normal(32) * np.linalg.norm(center) / 6 for _ in range(900)]
    vectors += [side + 0.02 * r.standard_normal(32) for _ in range(150)] + [*r.standard_normal((200, 32))] + [vectors[0]] * 3
    rows = [(i, v, int(i % 5 == 0)) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in V.near_duplicates(df.repartition(3)).collect()}
    want = all_pairs(rows)
    found, whole = (sum(n for n, _ in z.values()) for z in (got, want))
    assert all(got[i][0] <= want[i][0] for i in want) and 0.98 * whole <= found <= whole
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    if spread < 0.1:
        assert got == want


@pytest.mark.parametrize("same", [False, True])
def test_a_block(same):
    r = np.random.default_rng(8)
    x = r.standard_normal((40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x if same else x[:25][::-1] + 0.05 * r.standard_normal((25, 3))
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    codes = [r.integers(0, 8, (len(z), 3)).astype(np.uint32) for z in (x, y)]
    if same:
        codes[1] = codes[0]
    sizes = [r.integers(1, 5, len(z)) for z in (x, y)]
    if same:
        sizes[1] = sizes[0]
    of_x, of_y, span = V.linked_block(1, same, x, y, sizes, codes, 4, 0.8)
    edges = set()
    for i in range(len(x)):
        for j in range(len(y)):
            d = [bin(int(codes[0][i, k] ^ codes[1][j, k])).count("1") for k in range(3)]
            if d[0] > 1 and d[1] <= 1 and sum(d) <= 4 and x[i] @ y[j] >= 0.8 and not (same and i == j):
                edges.add((i, j))
    assert edges and of_x.tolist() == [sum(int(sizes[1][j]) for a, j in edges if a == i) for i in range(len(x))]
    if not same:
        assert of_y.tolist() == [sum(int(sizes[0][i]) for i, b in edges if b == j) for j in range(len(y))]

    def groups(pairs, n):
        top = list(range(n))

        def root(i):
            while top[i] != i:
                i = top[i]
            return i

        for a, b in pairs:
            p, q = sorted((root(a), root(b)))
            top[q] = p
        return [root(i) for i in range(n)]

    n = len(x) if same else len(x) + len(y)
    flat = [(i, j if same else len(x) + j) for i, j in edges]
    assert groups(span, n) == groups(flat, n)
