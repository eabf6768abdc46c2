from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from provgraph.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def rows_of(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet")


def test_exact_against_sql(spark, small, against_sql):
    against_sql(vectors.op1_exact_top_k(spark, small), vectors.OP1_SQL, small)


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = (x * x[list(ids).index(q)]).sum(axis=1)
        keep = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), int(score[i])) for i in keep]
    return out


@pytest.mark.parametrize("block", [8, 1000])
def test_ties_copies_and_hard_rows(spark, block):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (60, 5)).astype(float) / 256
    x[20:45] = x[0]
    rows = [(i, list(map(float, v)), 1, "s") for i, v in enumerate(x)]
    bad = [(100, None, 1, "s"), (101, [None, 1.0, 1.0, 1.0, 1.0], 1, "s"), (102, [float("nan")] * 5, 1, "s"), (103, [float("inf")] * 5, 1, "s"), (104, [], 1, "s"), (None, [9.0] * 5, 1, "s"), (105, [9.0] * 3, 1, "s")]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    found = collections.defaultdict(list)
    for r in vectors.exact_top_k(df, df.where("vec_id % 10 = 0"), 7, block=block, query_block=3).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert found == brute(np.arange(60), np.floor(x.astype(np.float32).astype(float) * 256).astype(int), range(0, 60, 10), 7)


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    q, x = rng.integers(-200, 200, (10, 16)).astype(float), rng.integers(-200, 200, (300, 16)).astype(float)
    low, high = vectors.cell_bounds(q, x, 6)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    low, high = vectors.code_bounds(q, x, 7, 1.9)
    assert ((low <= exact) & (exact <= high)).mean() > 0.9


@pytest.mark.parametrize("block", [64, 8192])
def test_recall_of_codes(spark, small, block):
    df = rows_of(spark, small)
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = collections.defaultdict(list)
    for r in vectors.nearest_by_codes(df, df.where("vec_id % 20 = 0"), 20, block=block).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
        assert abs(r.score - float(x[list(ids).index(r.vec_id)] @ x[list(ids).index(r.query_id)])) < 1e-12
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[list(ids).index(q)]
        best = [ids[i] for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len(set(best) & set(found[q]))
        total += len(best)
        assert len(found[q]) == len(best)
    assert hits / total >= 0.9


def test_few_zero_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 0.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in vectors.nearest_by_codes(df, df.where("vec_id % 20 = 0")).collect()] == [(0, 3)]
    none = df.limit(0)
    assert vectors.nearest_by_codes(none, none).count() == 0 and vectors.exact_top_k(df, none).count() == 0


def test_large_components(spark):
    """Finite vectors of any size take part, with exact scores; beyond a long they stand at its ends."""
    rows = [(0, [1.0, 2.0]), (50, [3e5, 1.0]), (100, [-3e5, 3e5]), (3, [2.0**40, -1.0]), (4, [2.0**40, -2.0]), (5, [0.0, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in v] for i, v in rows}
    clip = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    want = []
    for q in (0, 50, 100):
        scored = sorted(((-clip(sum(int(float(a)) * int(float(b)) for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert sorted(tuple(r) for r in vectors.exact_top_k(df, vectors.every_nth(df, 50), 5).collect()) == sorted(want)


def test_packed_products():
    rng = np.random.default_rng(3)
    for dims in (1, 7, 64, 100):
        q, bits = rng.normal(size=(9, dims)), rng.random((40, dims)) < 0.5
        found, step = vectors.packed_products(q, vectors.packed_words(bits))
        assert (np.abs(found - q @ (bits * 2.0 - 1).T) <= step[:, None] / 2 * dims + 1e-9).all()
