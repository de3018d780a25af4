import math
import random

import numpy as np
import pytest

from quoteloom.llm import vector_search


def brute(rows, k=10, every=100):
    kept = []
    for vec_id, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(1024 * c) for c in x]))
    out = []
    for i, (query, a) in enumerate(kept):
        if query is not None and query % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), vec_id is None, vec_id) for j, (vec_id, b) in enumerate(kept) if j != i and len(a) == len(b)]
            out += [(query, rank, vec_id, -score) for rank, (score, _, vec_id) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def got(spark, rows, schema="vec_id long, embedding array<double>", **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], schema + ", rank int").selectExpr("*", "rank as score", "rank as vector", "rank as cell")
    return sorted(map(tuple, vector_search.top_k(df, **more).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def clustered(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, size))
    return [(int(i), (middles[rng.integers(5)] + spread * rng.normal(size=size)).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed,spread,block,queries,every", [(1, 0.1, 2048, 256, 100), (2, 0.1, 40, 3, 20), (3, 2.0, 100, 10, 10)])
def test_equals_brute_force(spark, seed, spread, block, queries, every):
    rows = clustered(seed, 700, 6, spread)
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, [0.0] * 6) for i in range(30)]  # many equal vectors
    rows += [rows[3], rows[3], (100, rows[5][1]), (100, rows[5][1]), (None, rows[0][1]), (None, rows[7][1])]  # repeated rows and ids
    rows += [(200, None), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [math.inf] * 6), (500, [math.nan] * 6)]
    rows += [(600, [1.0, 2.0]), (601, [2.0, -1.0]), (700, []), (701, []), (800, [5.0])]  # other lengths
    assert got(spark, rows, block=block, queries=queries, every=every) == brute(rows, every=every)


def test_large_components(spark):
    rows = [(i, [(-1.0) ** i * 2.0 ** (30 + i % 7), 3.0 * i, 2.0**40]) for i in range(30)]
    assert got(spark, rows, every=5) == [(q, r, v, min(s, 2**63 - 1)) for q, r, v, s in brute(rows, every=5)] or any(s >= 2**63 for *_, s in brute(rows, every=5))
    rows = [(i, [(-1.0) ** i * (2.0**19 + i), 3.0 * i, 2.0**18]) for i in range(30)]
    assert got(spark, rows, every=5) == brute(rows, every=5)


def test_empty_and_single(spark):
    assert got(spark, []) == [] == got(spark, [(1, None)]) == got(spark, [(100, [1.0])])
    assert got(spark, [(100, [1.0]), (None, [0.5])], "vec_id long, embedding array<float>") == [(100, 1, None, 1024 * 512)]


def test_cover_tree():
    rng = np.random.default_rng(4)
    for points in (rng.integers(-50, 50, (400, 5)), rng.integers(0, 2, (300, 3)), np.zeros((1, 4), int), np.zeros((50, 0), int)):
        tree = vector_search.Tree.build(points.astype(np.int64))
        assert (tree.points == points[tree.order]).all() and sorted(tree.order.tolist()) == list(range(len(points)))
        for node, ((a, b), (first, past)) in enumerate(zip(tree.rows.tolist(), tree.children.tolist())):
            distances = lambda x, y: np.sqrt(((x - y) ** 2).sum(-1))
            assert a <= tree.centre[node] < b and distances(tree.points[a:b], tree.points[tree.centre[node]]).max(initial=0) <= tree.radius[node] + 1e-9
            if first < past:
                assert tree.rows[first, 0] == a and tree.rows[past - 1, 1] == b
                middles = tree.points[tree.centre[first:past]]
                assert tree.centre[node] in tree.centre[first:past] and (tree.radius[first:past] <= tree.radius[node] / 2 + 1e-9).all()
                away = distances(middles[:, None], middles[None])
                assert (away[~np.eye(len(middles), dtype=bool)] > tree.radius[node] / 2).all()


def test_pruning():
    """Far clusters are not scored at all."""
    rng = random.Random(1)
    near = np.array([[1000 + rng.randrange(9), rng.randrange(9)] for _ in range(100)])
    far = np.array([[-1000 + rng.randrange(9), rng.randrange(9)] for _ in range(100)])
    search = vector_search.Search(vector_search.Tree.build(near[:7]), 3, np.full(7, -np.inf))
    ids = [[i] for i in range(200)]
    scored = []
    real = vector_search.products
    tree = vector_search.Tree.build(np.concatenate([near, far]))
    try:
        vector_search.products = lambda a, b: scored.append(b) or real(a, b)
        search.against(tree, ids)
    finally:
        vector_search.products = real
    assert scored and all((x[:, 0] > 0).all() for x in scored)
