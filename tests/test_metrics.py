import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irregts.operators import metrics as me

SCHEMA = "ind long, set string, fold int, y_true double, y_pred double"


def expected(pairs, bounds):
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    e = np.abs(y - p)
    out = {"mae": e.mean(), "medae": np.median(e)}
    total = ((y - y.mean()) ** 2).sum()
    out["r2"] = 1 - ((y - p) ** 2).sum() / total if total else float((y == p).all())
    if (y <= 0).any() or (p <= 0).any():
        out["d2"] = 0.0
    else:
        def deviance(a, b):
            return (2 * (np.log(b / a) + a / b - 1)).mean()

        out["d2"] = 1 - deviance(y, p) / deviance(y, np.full_like(y, y.mean()))
    t, q = (np.searchsorted(bounds, x, side="right") for x in (y, p))
    out["acc"], out["f1"] = (t == q).mean(), 0.0
    for c in set(t) | set(q):
        tp, fp, fn = ((t == c) & (q == c)).sum(), ((t != c) & (q == c)).sum(), ((t == c) & (q != c)).sum()
        out["f1"] += (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0) * (t == c).sum() / len(t)
    return out


BOUNDS = (1.0, 2.0, 3.0)


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(9)
    groups = {}
    for name, fold, n, shift in (("test", 0, 51, 0.05), ("test", 1, 60, 0.05), ("test", 2, 40, -0.5), ("train", 0, 2, 0.1)):
        groups[name, fold] = [(rng.random() * 4 + 0.01, rng.random() * 4 + shift) for _ in range(n)]
    data = [(i, s, f, a, b) for (s, f), pairs in groups.items() for i, (a, b) in enumerate(pairs)]
    return groups, spark.createDataFrame(data, SCHEMA).repartition(4).cache()


def test_scores(predictions):
    groups, df = predictions
    got = {}
    for r in me.score_table(df, BOUNDS).collect():
        got.setdefault((r["set"], r["fold"]), {})[r["metric"]] = r["value"]
    assert set(got) == set(groups)
    for key, pairs in groups.items():
        assert got[key] == pytest.approx(expected(pairs, BOUNDS)), key
    assert {r["metric"] for r in me.score_table(df).collect()} == set(me.REGRESSION_SCORES)


def test_fold_summary(predictions):
    groups, df = predictions
    table = {(r["set"], r["metric"]): r for r in me.metrics_by_fold(me.score_table(df), range(3)).collect()}
    row = table["test", "mae"]
    folds = [expected(groups["test", f], BOUNDS)["mae"] for f in range(3)]
    assert [row[f"fold_{f}"] for f in range(3)] == pytest.approx(folds)
    assert row["mean"] == pytest.approx(np.mean(folds)) and row["std"] == pytest.approx(np.std(folds))
    assert row["std_with_mean"] == pytest.approx(np.std([*folds, np.mean(folds)]))


def test_published_deviation_includes_the_mean(spark):
    """Five fold errors of a published table; its deviation covers folds and mean."""
    folds = [0.10534, 0.10714, 0.10528, 0.10820, 0.10574]
    scores = spark.createDataFrame([("test", i, "mae", x) for i, x in enumerate(folds)], "set string, fold int, metric string, value double")
    row = me.metrics_by_fold(scores, range(5)).first()
    assert row["std_with_mean"] == pytest.approx(np.std([*folds, np.mean(folds)]))
    assert row["std_with_mean"] < row["std"]


def test_constant_truth(spark):
    data = [(1, "exact", 0, 2.0, 2.0), (2, "exact", 0, 2.0, 2.0), (1, "off", 0, 2.0, 2.0), (2, "off", 0, 2.0, 2.5), (1, "one", 0, 2.0, 1.0)]
    got = {r["set"]: r for r in me.regression_scores(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["exact"]["r2"] == 1.0 and got["off"]["r2"] == 0.0 and math.isnan(got["one"]["r2"])


def test_confusion_matrix_is_dense(spark):
    data = [(1, "a", 0, 0.5, 0.5), (2, "a", 0, 0.5, 2.5), (3, "a", 0, 2.5, 2.5), (4, "a", 0, 2.5, 2.5)]
    out = me.confusion_matrix(spark.createDataFrame(data, SCHEMA), BOUNDS).collect()
    got = {(r["target_class"], r["prediction_class"]): r["share"] for r in out}
    assert got == {(0, 0): 0.25, (0, 2): 0.25, (2, 0): 0.0, (2, 2): 0.5}


def test_quantile_forecasts(spark):
    data = [(1, "a", 0, 3.0, [2.0, 3.0, 5.0]), (2, "a", 0, 1.0, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame(data, "ind long, set string, fold int, y_true double, q_pred array<double>")
    points = {r["ind"]: r["y_pred"] for r in me.point_from_quantiles(df).collect()}
    assert points == {1: 3.0, 2: 2.0}
    one = df.withColumn("q_pred", F.slice("q_pred", 3, 1))
    assert {r["ind"]: r["y_pred"] for r in me.point_from_quantiles(one).collect()} == {1: 5.0, 2: 2.0}
    losses = {r["q"]: (r["mean_loss"], r["sum_loss"]) for r in me.pinball_loss(df, me.THREE_QUANTILES).collect()}
    assert losses[0.1] == pytest.approx((0.5, 1.0)) and losses[0.5] == pytest.approx((0.25, 0.5))
    assert losses[0.9] == pytest.approx((0.15, 0.3))
    assert me.quantile_levels(1) == [0.5] and me.quantile_levels(3, [0.2]) == [0.2]
