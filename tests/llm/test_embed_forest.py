from __future__ import annotations

import inspect
import math

import numpy as np

from gridrank.llm import embed_forest


def brute(rows, least):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, lb) and i is not None else None for i, v, lb in rows]
    for a in range(n):
        for b in range(a):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    return [(rows[k][0], links[k], rows[find(k)][0]) for k in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, lb, "x", 1) for i, v, lb in rows], "vec_id long, embedding array<float>, label int, cls string, leaf int").repartition(3)


def made(seed=2, n=400, groups=12, d=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    rows = []
    for k in range(n):
        near = k % 3
        v = centres[k % groups] + rng.standard_normal(d) * (0.3 if near else 2.0)
        rows.append((k, [float(np.float32(x)) for x in v], k % groups % 4))
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = made()
    found = embed_forest.near_duplicates(table(spark, rows), least=0.93, trees=8, leaf=64, block=32).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(brute(rows, 0.93))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_blocks_of_a_hot_leaf_lose_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in np.ones(16) + 0.2 * rng.standard_normal(16)], 1) for k in range(150)]
    found = embed_forest.near_duplicates(table(spark, rows), least=0.93, leaf=1000, block=20).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(brute(rows, 0.93))


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 1), (2, one, 1), (2, one, 1), (3, [2.0, 0.0, 0.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [float("nan"), 1.0, 0.0], 1), (9, [float("inf"), 1.0, 0.0], 1), (10, [1.0, None, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (13, [1e30, 1e30, 0.0], 1), (14, [1e-30, 1e-30, 0.0], 1)]
    found = embed_forest.near_duplicates(table(spark, rows), least=0.93).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(brute(rows, 0.93))
    nobody = embed_forest.near_duplicates(table(spark, [(None, one, 1), (1, one, 1)]), least=0.93).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in nobody) == [(0, 0, None), (1, 0, 1)]


def test_empty_table(spark):
    assert embed_forest.near_duplicates(table(spark, made(n=3)).where("false")).count() == 0


def near_pairs(n, d=64, least=0.93, many=2000, seed=3):
    """Random unit vectors, and partners of the first `many` at the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, r = x[:many], rng.standard_normal((many, d))
    r -= (r * a).sum(1, keepdims=True) * a
    return x, least * a + math.sqrt(1 - least**2) * r / np.linalg.norm(r, axis=1, keepdims=True)


def test_leaves_copies_and_recall_hold_as_tables_grow():
    given = {k: p.default for k, p in inspect.signature(embed_forest.near_duplicates).parameters.items()}
    options = {k: given[k] for k in ("trees", "leaf", "margin", "spill", "most_shared", "recall")}
    for n in (20_000, 160_000):
        x, y = near_pairs(n)
        forest = embed_forest.fit(x[-given["most_sample"] :], n, deviation=math.sqrt((2 - 2 * 0.93) / 64), **options)
        found, met = forest.leaves(x), np.zeros(len(y), bool)
        for (row, leaf), (mine, own) in zip(found, forest.leaves(y)):
            first = row < len(y)
            met[mine[np.isin(mine * 2**40 + own, row[first] * 2**40 + leaf[first])]] = True
        assert met.mean() >= 0.97
        assert sum(len(row) for row, _ in found) <= 16 * n
        assert max(np.unique(leaf, return_counts=True)[1].max() for _, leaf in found) <= 2 * given["leaf"]


def test_recall_with_small_leaves_and_groups(spark):
    rows = made(seed=9, n=3000, groups=40)
    found = embed_forest.near_duplicates(table(spark, rows), least=0.93, leaf=128).collect()
    want = {i: many for i, many, _ in brute(rows, 0.93)}
    assert sum(r.n_links for r in found) >= 0.9 * sum(want.values())
    assert all(r.n_links <= want[r.vec_id] for r in found)
