"""Forecast inputs against a walk over each stay, and the shape of samples and batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irregts.operators import forecast as fc
from irregts.operators import sequences as se
from irregts.operators import windows as wi
from irregts.plans import queries, stages

SCHEMA = "ind long, time long, itemid long, value double, gender string, age double"


def walk(rows, target, masked=(), back=None, horizon=None, histories=None, n=None):
    out = []
    for ind in sorted({r[0] for r in rows}):
        stay = sorted((r for r in rows if r[0] == ind), key=lambda r: (r[1], r[2], r[3]))
        tgt = [r for r in stay if r[2] == target]
        if not tgt:
            continue
        end = tgt[-1][1]
        data = [r for r in stay if r[1] < end and r[2] not in masked]
        if n is None and horizon is None and back is not None and data:
            width = back
            while not any(r[1] >= end - width for r in data):
                width += back
            data = [r for r in data if r[1] >= end - width]
        if horizon is not None:
            data = [r for r in data if r[1] <= end - horizon * 60]
        if histories is not None:
            fit = [h for h in sorted(histories, reverse=True) if h * 60 < end]
            data = [r for r in data if r[1] <= fit[0] * 60]
        out += data[-n:] if n is not None else data
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = set()
    for ind in range(40):
        for _ in range(rng.choice([2, 5, 30])):
            rows.add((ind, rng.randrange(70, 4000), rng.choice([0, 1, 2, 3]), float(rng.randrange(9)), "F", 50.0))
    rows |= {(90, t, t % 4, float(t % 7), "M", 60.0) for t in range(70, 1500)}  # a long stay
    rows = sorted(rows)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


LIMITS = [
    dict(),
    dict(masked=(0, 2)),
    dict(back=100),
    dict(masked=(1, 2, 3), back=35),
    dict(horizon=10),
    dict(histories=[1, 20, 50]),
    dict(n=7),
    dict(masked=(1,), back=50, horizon=3, histories=[1, 30], n=4),
]


@pytest.mark.parametrize("limits", LIMITS)
def test_inputs_equal_a_walk_over_the_rows(data, limits):
    rows, df = data
    names = dict(masked="masked", back="back_minutes", horizon="horizon_hours", histories="history_hours", n="max_measures")
    got = wi.forecast_inputs(df, 0, **{names[k]: v for k, v in limits.items()})
    assert sorted(tuple(r) for r in got.select("ind", "time", "itemid", "value", "gender", "age").collect()) == walk(
        rows, 0, **limits
    )


def test_horizon_keeps_the_row_on_its_edge(spark):
    """Target at 1,000 min and a horizon of 5 h: 700 min is kept, 701 min is not."""
    rows = [(7, t, 3, 0.5, "M", 30.0) for t in (-20, 699, 700, 701, 999)] + [(7, 1000, 0, 2.0, "M", 30.0)]
    got = wi.forecast_inputs(spark.createDataFrame(rows, SCHEMA), 0, horizon_hours=5)
    assert sorted(r["time"] for r in got.collect()) == [-20, 699, 700]


def test_history_beyond_the_target_is_an_error(data):
    with pytest.raises(Exception, match="oversteps the target time"):
        wi.forecast_inputs(data[1], 0, history_hours=[100, 200]).collect()


def test_hot_groups_are_trimmed_in_pieces_with_the_same_result(data):
    rows, df = data
    plain = wi.last_n(df, 6)
    pieces = wi.last_n(df, 6, pieces=3)
    assert "_piece" in pieces._jdf.queryExecution().analyzed().toString()
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r) for r in pieces.collect())
    copies = df.sparkSession.createDataFrame([(1, 5, 1, 1.0, "F", 1.0)] * 900, SCHEMA).repartition(6)
    assert wi.last_n(copies, 6, pieces=3).count() == 6


def test_samples_and_padding(spark):
    rows = [
        (1, 10, 2, 5.0, "Male", 50.0), (1, 10, 1, -1e4, "Male", 50.0), (1, 90, 0, 7.0, "Male", 50.0),
        (2, 30, 0, 1.0, None, 61.0), (2, 40, 0, 2.0, None, 61.0),
        (3, 20, 0, 3.0, "", 62.0),
        (4, 20, 1, 3.0, "F", 62.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = se.sample_targets(df, 0)
    samples = se.sequences(wi.forecast_inputs(df, 0), targets, 9, 2)
    got = {r["ind"]: r for r in samples.collect()}
    assert sorted(got) == [1, 2, 3]  # stay 4 has no target
    assert got[1]["values"] == [-1e4, 5.0, 0.0] and got[1]["times"] == [10.0, 10.0, 90.0]
    assert got[1]["variables"] == [1, 2, 9] and got[1]["demog"] == [-1.0, 50.0]
    assert got[2]["values"] == [1.0, 0.0] and got[2]["demog"] == [0.0, 61.0]
    assert got[3]["variables"] == [9] and (got[3]["tgt_value"], got[3]["tgt_time"]) == (3.0, 20.0)

    padded = {r["ind"]: r for r in se.padded_batches(samples, se.batch_assignment(samples, 2)).collect()}
    assert padded[2]["values"] == [1.0, 0.0, -1e4] and padded[2]["times"] == [30.0, 40.0, -1e4]
    assert padded[2]["variables"] == [0, 9, 0] and padded[2]["mask"] == [1, 1, 0]
    assert padded[1]["mask"] == [1, 1, 1]  # a real value that equals the filler stays visible
    assert padded[3]["mask"] == [1] and padded[3]["batch_id"] == 1

    long = se.sequence_rows(wi.forecast_inputs(df, 0), targets, 9)
    assert sorted((r["pos"], r["variable"]) for r in long.filter("ind = 1").collect()) == [(0, 1), (1, 2), (2, 9)]
    empty = wi.empty_inputs(targets, wi.forecast_inputs(df, 0, masked=[1, 2]))
    assert sorted(r[0] for r in empty.collect()) == [1, 3]


def test_batches(spark):
    stays = spark.range(23).toDF("ind")
    full = se.batch_assignment(stays, 5)
    assert sorted(r["n"] for r in full.groupBy("batch_id").agg(F.count("*").alias("n")).collect()) == [3, 5, 5, 5, 5]
    cut = se.batch_assignment(stays, 5, drop_last=True, seed=1, epoch=0)
    assert cut.count() == 20
    other = se.batch_assignment(stays, 5, drop_last=True, seed=1, epoch=1)
    assert {tuple(r) for r in cut.collect()} != {tuple(r) for r in other.collect()}


def test_tasks(spark):
    key = spark.createDataFrame([("creatinine", 3), ("sodium", 7)], "label string, key long")
    task = fc.forecast_task(key, preset="eICU-SCr")
    assert (task.target, task.masked, task.time_token) == (3, (3,), 8)
    assert fc.forecast_task(key, "sodium", max_measures=5).max_measures == 5
    with pytest.raises(ValueError, match="unknown preset"):
        fc.forecast_task(key, preset="x")
    with pytest.raises(ValueError, match="matches"):
        fc.forecast_task(key, preset="29")


def test_scores_keep_their_stay(data):
    _, df = data
    targets = se.sample_targets(df, 0)
    samples = se.sequences(wi.forecast_inputs(df, 0, targets=targets), targets, 4, 12)
    batches = se.padded_batches(samples, se.batch_assignment(samples, 7, seed=5))

    def last_time(batch):
        assert batch["values"].shape == batch["mask"].shape and len(batch["demog"]) <= 7
        return np.where(batch["mask"] == 1, batch["times"], -np.inf).max(axis=1)

    scored = fc.score_batches(batches, last_time).join(targets, "ind")
    assert scored.count() == targets.count()
    assert scored.filter("q_pred[0] <> tgt_time or y_true <> tgt_value").isEmpty()


def linear_stays(spark):
    """The target is twice the level of the other variable, plus one."""
    rng = random.Random(8)
    rows = []
    for ind in range(80):
        level = rng.uniform(0, 10)
        rows += [(ind, t, 1, level + rng.gauss(0, 0.05), "F", 50.0) for t in (10, 20, 30)]
        rows.append((ind, 60, 0, 2 * level + 1, "F", 50.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_cross_validated_forecasts(spark):
    task = fc.ForecastTask(target=0, time_token=2)
    settings = fc.FitSettings(with_train=True)
    folds, predictions, scores = stages.cross_validate(linear_stays(spark), task, [0, 1], k=2, staging=(5.0, 15.0), settings=settings)
    out = predictions.collect()
    tests = [r for r in out if r["set"] == "test"]
    assert len(out) == 160 and sorted(r["ind"] for r in tests) == list(range(80))
    assert {(r["ind"], r["fold"]) for r in tests} == {(r["ind"], r["fold"]) for r in folds.collect()}
    assert all(math.isfinite(r["y_pred"]) for r in out)
    table = {(r["set"], r["metric"]): r["mean"] for r in scores.collect()}
    assert table["test", "mae"] < 0.6 and table["train", "mae"] < 0.6 and table["test", "acc"] > 0.9


def test_saved_models_score_another_cohort(spark, tmp_path):
    """The other cohort's levels are ten higher; only the saved statistics know that."""
    task, stays = fc.ForecastTask(target=0, time_token=2), linear_stays(spark)
    settings = fc.FitSettings(loss="squaredError", reg=0.0, features=("v1",))
    path = str(tmp_path / "models")
    folds, predictions, _ = stages.cross_validate(stays, task, [0, 1], k=2, settings=settings, models_path=path)
    models = spark.read.parquet(path)
    assert {(r["fold"], tuple(r["names"])) for r in models.collect()} == {(0, ("v1",)), (1, ("v1",))}
    again = fc.score_cohort(stays.join(folds.filter("fold = 1").select("ind"), "ind"), models, 1, task, [0, 1], settings)
    first = {r["ind"]: r["y_pred"] for r in predictions.filter("fold = 1").collect()}
    assert {r["ind"]: pytest.approx(r["y_pred"]) for r in again.collect()} == first

    shift = F.when(F.col("itemid") == 1, F.col("value") + 10).otherwise(F.col("value") + 20)
    higher = stays.withColumn("value", shift)
    splits = folds.select("ind", F.lit(0).alias("fold"), F.when(F.col("fold") == 0, "test").otherwise("train").alias("split"))
    errors = {}
    for fit_on in ("train", "own"):
        chosen = fc.FitSettings(loss="squaredError", reg=0.0, features=("v1",), fit_on=fit_on)
        scored, table = stages.evaluate_cohort(higher, splits, 0, models, task, [0, 1], settings=chosen)
        assert scored.count() == 40
        errors[fit_on] = {r["metric"]: r["value"] for r in table.collect()}["mae"]
    assert errors["train"] < 0.6 and errors["own"] < 1.5
    with pytest.raises(Exception, match="fitted on other features"):
        fc.score_cohort(stays, models, 0, task, [0, 1], fc.FitSettings(features=("age",))).collect()
    with pytest.raises(ValueError, match="fit_on"):
        fc.FitSettings(fit_on="both")


def test_long_batches_equal_padded_ones(data):
    _, df = data
    targets = se.sample_targets(df, 0)
    inputs = wi.forecast_inputs(df, 0, targets=targets)
    samples = se.sequences(inputs, targets, 9)
    batches = se.batch_assignment(samples, 4)
    padded = se.padded_batches(samples, batches).collect()
    want = sorted(
        (r["ind"], r["batch_id"], r["row_in_batch"], i, *cell)
        for r in padded for i, cell in enumerate(zip(r["values"], r["times"], r["variables"], r["mask"]))
    )
    long = se.long_batches(se.sequence_rows(inputs, targets, 9), batches)
    names = ["ind", "batch_id", "row_in_batch", "pos", "value", "time", "variable", "mask"]
    assert sorted(tuple(r) for r in long.select(*names).collect()) == want
    used = sum(sum(r["mask"]) for r in padded)
    assert used == inputs.count() + targets.count()  # every row and every token


def test_hold_out_forecasts(spark):
    task = fc.ForecastTask(target=0, time_token=2)
    stays = linear_stays(spark)
    labels = stays.filter("itemid = 0").select("ind", (F.col("value") > 11).cast("int").alias("label"))
    folds, predictions, scores = stages.cross_validate(stays, task, [0, 1], k=1, labels=labels)
    assert predictions.count() == folds.filter("fold = 0").count() == 16
    assert {r["metric"] for r in scores.collect()} == {"mae", "medae", "r2", "d2"}


def test_registered_samples_hold_whole_stays(spark, monkeypatch):
    rows = [(1, t, 1, float(t % 7), "M", 60.0) for t in range(70, 1700)] + [(1, 1800, 0, 2.0, "M", 60.0)]
    monkeypatch.setattr(queries.v, "measures", lambda spark, d: spark.createDataFrame(rows, SCHEMA))
    assert sorted(len(r["values"]) for r in queries._samples(spark, "").collect())[-1] == 1631
