import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irregts.operators import normalize as no
from irregts.operators import split as sp


def test_folds_are_disjoint_and_even(spark):
    stays = spark.range(0, 103).select((F.col("id") * 7).alias("ind"))
    folds = {r["ind"]: r["fold"] for r in sp.k_folds(stays.union(stays), 5, 3).collect()}
    sizes = [list(folds.values()).count(f) for f in range(5)]
    assert len(folds) == 103 and sizes == [21, 21, 21, 20, 20]
    again = {r["ind"]: r["fold"] for r in sp.k_folds(stays.repartition(9), 5, 3).collect()}
    other = {r["ind"]: r["fold"] for r in sp.k_folds(stays, 5, 4).collect()}
    assert folds == again and folds != other
    with pytest.raises(ValueError):
        sp.k_folds(spark.range(3).toDF("ind"), 5)


def test_holdout_sizes(spark):
    for n in (5, 6, 11):
        out = sp.holdout(spark.range(n).toDF("ind"), 1)
        assert out.filter("split = 'test'").count() == math.ceil(n / 5)


def test_stratified_quotas(spark):
    labels = [0] * 47 + [1] * 39 + [2] * 32 + [3] * 27
    df = spark.createDataFrame(list(enumerate(labels)), "ind long, label int")
    out = sp.stratified_holdout(df, df, 1)
    test = {r["label"]: r["n"] for r in out.filter("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    # 29 test stays; exact shares are 9.4, 7.8, 6.4 and 5.4.
    assert out.count() == 145 and sum(test.values()) == 29
    assert test == {0: 9, 1: 8, 2: 7, 3: 5} or test == {0: 10, 1: 8, 2: 6, 3: 5} or test == {0: 9, 1: 8, 2: 6, 3: 6}
    with pytest.raises(Exception, match="stay without label"):
        sp.stratified_holdout(df, df.filter("ind > 3"), 1)
    lonely = df.withColumn("label", F.when(F.col("ind") == 0, 9).otherwise(F.col("label")))
    with pytest.raises(ValueError, match="single stay"):
        sp.stratified_holdout(lonely, lonely, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i % 23, i % 3, float(rng.randrange(500)), rng.random() * 9, "M", 40.0 + i % 23) for i in range(900)]
    data += [(i, 5, 1.0, 3.5, "F", 40.0 + i) for i in range(23)]  # a constant variable
    df = spark.createDataFrame(data, "ind long, itemid long, time double, value double, gender string, age double")
    return data, df.repartition(4).cache()


def test_fold_statistics_equal_direct_statistics(spark, rows):
    data, df = rows
    folds = sp.k_folds(df, 4, 1)
    of = {r["ind"]: r["fold"] for r in folds.collect()}
    for mode in no.MODES:
        stats = no.fit_fold_stats(df, folds, 4, mode).collect()
        assert len(stats) == 4 * 2 * 4
        for r in stats:
            member = [d for d in data if (of[d[0]] == r["fold"]) == (r["split"] == "test")]
            values = np.array([d[3] for d in member if d[1] == r["itemid"]])
            times, ages = np.array([d[2] for d in member]), np.array([d[5] for d in member])
            for name, x in (("value", values), ("time", times), ("age", ages)):
                if mode == "standard":
                    assert r[f"{name}_mean"] == pytest.approx(x.mean()) and r[f"{name}_std"] == pytest.approx(x.std(), abs=1e-9)
                else:
                    assert (r[f"{name}_min"], r[f"{name}_max"]) == (x.min(), x.max())


def test_normalised_values(rows):
    data, df = rows
    out = no.normalize(df)
    flat = out.filter("itemid = 5").agg(F.min("value"), F.max("value")).first()
    assert tuple(flat) == (0.0, 0.0)
    s = out.filter("itemid = 1").agg(F.avg("value"), F.stddev_pop("value")).first()
    assert s[0] == pytest.approx(0, abs=1e-12) and s[1] == pytest.approx(1)
    t = out.agg(F.avg("time"), F.stddev_pop("time"), F.avg("age")).first()
    assert t[0] == pytest.approx(0, abs=1e-12) and t[1] == pytest.approx(1) and t[2] == pytest.approx(0, abs=1e-12)
    scaled = no.normalize(df, mode="minmax", times=False)
    low = scaled.agg(F.min("value"), F.max("value"), F.max("time"), F.max("age")).first()
    assert tuple(low) == (0.0, 1.0, max(d[2] for d in data), 1.0)
    with pytest.raises(ValueError, match="mode"):
        no.normalize(df, mode="other")


def test_nan_does_not_spoil_the_statistics(spark):
    data = [(1, 0, 1.0, 1.0), (1, 0, 2.0, 3.0), (2, 0, 3.0, float("nan")), (2, 0, 4.0, None)]
    df = spark.createDataFrame([(*d, "M", 40.0) for d in data], "ind long, itemid long, time double, value double, gender string, age double")
    stats = no.fit_stats(df).first()
    assert (stats["value_mean"], stats["value_std"], stats["time_mean"]) == (2.0, 1.0, 2.5)
    low = no.fit_stats(df, mode="minmax").first()
    assert (low["value_min"], low["value_max"]) == (1.0, 3.0)
    out = sorted(str(r["value"]) for r in no.normalize(df).collect())
    assert out == ["-1.0", "1.0", "None", "nan"]


def test_unknown_variable_is_an_error(rows):
    _, df = rows
    stats = no.fit_stats(df.filter("itemid <> 5"))
    with pytest.raises(Exception, match="variable without statistics"):
        no.apply_stats(df, stats).collect()


@pytest.mark.parametrize("mode", no.MODES)
def test_predictions_return_to_their_unit(rows, mode):
    _, df = rows
    stats = no.fit_stats(df, mode=mode)
    truth = df.filter("itemid = 1").select("ind", "itemid", "time", "value", "gender", "age")
    scaled = no.apply_stats(truth, stats, mode=mode).select("ind", F.col("value").alias("y_true"), F.col("value").alias("y_pred"))
    back = no.denormalize_predictions(scaled, stats, 1, mode=mode)
    got = sorted(r["y_pred"] for r in back.collect())
    assert got == pytest.approx(sorted(r["value"] for r in truth.collect()))
