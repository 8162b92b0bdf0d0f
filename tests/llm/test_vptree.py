import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F

from irregts.llm import vptree as vp


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")


def brute(vectors, ids, queries, k):
    x = np.asarray(vectors, np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        i = ids.index(q)
        score = x @ x[i] / n / n[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-round(score[j], 12), ids[j]))[:k]
        out[q] = [(ids[j], pytest.approx(score[j], abs=1e-12)) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_exact_with_clusters_copies_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(vp, "SHARD_ROWS", 150)
    monkeypatch.setattr(vp, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 12))
    x = [*(centres[rng.integers(6, size=500)] + 0.2 * rng.standard_normal((500, 12)))]
    x += [x[3]] * 300 + [[-v for v in x[7]]] + [[2 * v for v in x[9]]]
    df = clashing(table(spark, x).repartition(5))
    got = found(vp.nearest(df, F.col("vec_id") % 10 == 0, 5))
    assert got == brute(x, list(range(len(x))), [i for i in range(len(x)) if i % 10 == 0], 5)


def test_relaxed_pruning_keeps_most(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 8))
    df = table(spark, x)
    exact, fast = (found(vp.nearest(df, F.col("vec_id") % 25 == 0, 5, f)) for f in (1.0, 1.3))
    shared = sum(len({i for i, _ in exact[q]} & {i for i, _ in fast[q]}) for q in exact)
    assert shared >= 0.9 * 5 * len(exact)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], [0, 0], None, [nan, 1], [inf, 1], [None, 1], [], [1, 1], [2.0**-100] * 2, [2.0**120] * 2]
    got = found(vp.nearest(table(spark, x), F.lit(True), 5))
    assert set(got) == {0, 7, 8, 9}
    assert [i for i, _ in got[0]] == [7, 8, 9] and [i for i, _ in got[7]] == [8, 9, 0]


def test_lengths_repeats_and_empty(spark):
    x = [[1, 0], [1, 0, 0], [0, 1], [1, 0], [0, 1, 0]]
    got = found(vp.nearest(table(spark, x, [0, 1, 2, 2, 3]), F.col("vec_id") == 0, 5))
    assert got == {0: [(2, 1.0), (2, 0.0)]}
    assert vp.nearest(table(spark, x).limit(0), F.lit(True), 5).count() == 0
    assert vp.nearest(table(spark, x[:1]), F.lit(True), 5).count() == 0


def test_tree_without_pruning_differences():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((400, 5))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = vp.VantagePointTree(unit, 10)
    who, rows = tree.search(unit[:50], 4, 1.0)
    best = np.sort(vp.distance(unit[:50] @ unit.T), axis=1)[:, :4]
    for q in range(50):
        apart = np.sort(vp.distance(unit[rows[who == q]] @ unit[q]))
        assert apart[:4] == pytest.approx(best[q], abs=1e-7)


def test_an_id_on_several_vectors_uses_up_no_places(spark):
    x = [[1, 0], [1, 0.01], [1, 0.02], [1, 1], [1, 2], [1, 3], [1, 4], [1, 5]]
    got = found(vp.nearest(table(spark, x, [50, 50, 50, 1, 2, 3, 4, 5]), F.col("vec_id") == 50, 5))
    assert sorted(i for i, _ in got[50]) == sorted([1, 2, 3, 4, 5] * 3)
