import numpy as np
import pytest
from pyspark.sql import functions as F

from irregts.operators import forecast as fc
from irregts.operators import metrics as me
from irregts.operators import regression as rg
from irregts.operators.vectors import sum_vectors, vector_row


def sample(n=600, seed=4):
    """Raw features with gaps and a heavy-tailed truth, and the test fold of each row."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.standard_t(2, n) * 0.7 + 4
    x[rng.random((n, 3)) < 0.1] = np.nan
    return x, y, rng.integers(0, 3, n)


def rows_of(spark, x, y, fold):
    data = [(int(f), float(t), *(None if np.isnan(v) else float(v) for v in row)) for f, t, row in zip(fold, y, x)]
    return spark.createDataFrame(data, "fold int, y double, a double, b double, c double").repartition(2)


def scaling_of(x, y, fold, k=3):
    sides = [fold != f for f in range(k)]
    return rg.Scaling(
        np.array([np.nanmean(x[s], axis=0) for s in sides]),
        np.array([np.nanstd(x[s], axis=0) for s in sides]),
        np.array([y[s].mean() for s in sides]),
        np.array([y[s].std() for s in sides]),
        np.zeros(3, bool),
    )


def loss_of(loss, x, t, models, output):
    r = t - x @ models
    if loss.kind == "huber":
        each = np.where(np.abs(r) <= loss.delta, r * r / 2, loss.delta * (np.abs(r) - loss.delta / 2))
    else:
        q = loss.levels[output]
        each = np.maximum(q * r, (q - 1) * r)
    return each.mean() + loss.reg / 2 * (models[1:] ** 2).sum()


def descend(loss, x, t, output, steps=60_000):
    """The least loss that plain subgradient descent on all rows finds."""
    beta, best, at = np.zeros(x.shape[1]), np.inf, None
    for i in range(steps):
        r = t - x @ beta
        slope = np.clip(r, -loss.delta, loss.delta) if loss.kind == "huber" else np.where(r > 0, loss.levels[output], loss.levels[output] - 1)
        beta = beta + (0.3 if loss.kind == "huber" else 1.0 / np.sqrt(i + 1)) * (x.T @ slope / len(t) - loss.reg * np.r_[0, beta[1:]])
        if i % 50 == 0 and (now := loss_of(loss, x, t, beta, output)) < best:
            best, at = now, beta
    return best, at


@pytest.mark.parametrize("loss", [rg.Loss("huber", delta=1.0), rg.Loss("huber", delta=0.2, reg=0.0), rg.Loss("pinball", reg=0.0), rg.Loss("pinball", levels=(0.25, 0.7))])
def test_fits_reach_the_least_loss_of_a_plain_solver(spark, loss):
    x, y, fold = sample()
    scaling = scaling_of(x, y, fold)
    models = rg.fit_all(rows_of(spark, x, y, fold), ["a", "b", "c"], scaling, loss, 60, 1e-5)
    assert models.shape == (3, loss.outputs, 4)
    for f in range(3):
        side = fold != f
        features, truth = scaling.features(x[side], f), scaling.truth(y[side], f)
        for output in range(loss.outputs):
            best, at = descend(loss, features, truth, output, 8_000)
            assert loss_of(loss, features, truth, models[f, output], output) <= best + 3e-4
            if loss.kind == "huber":
                assert models[f, output] == pytest.approx(at, abs=5e-4)
            else:  # a share of about q of the truths lies below
                below = (truth < features @ models[f, output]).mean()
                assert below == pytest.approx(loss.levels[output], abs=0.02)


def test_least_squares_equals_numpy_and_no_step_raises_the_loss(spark):
    x, y, fold = sample()
    scaling, rows = scaling_of(x, y, fold), rows_of(spark, x, y, fold)
    models = rg.fit_all(rows, ["a", "b", "c"], scaling, rg.Loss("squaredError", reg=0.0), 9, 0.0)
    features, truth = scaling.features(x[fold != 1], 1), scaling.truth(y[fold != 1], 1)
    assert models[1, 0] == pytest.approx(np.linalg.lstsq(features, truth, rcond=None)[0], abs=1e-9)
    loss, seen = rg.Loss("huber", delta=0.5), []
    rg.fit_all(rows, ["a", "b", "c"], scaling, loss, 8, 0.0, after_step=lambda step, m: seen.append(m))
    losses = [loss_of(loss, features, truth, m[1, 0], 0) for m in seen]
    assert len(losses) == 8 and all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))


def test_constant_absent_and_unknown_values(spark):
    """A constant feature, one without any value, a truth that is null or NaN, no rows at all."""
    x, y, fold = sample(90)
    x[:, 1], x[:, 2] = 7.0, np.nan
    scaling = rg.Scaling(np.tile([0.0, 7.0, np.nan], (3, 1)), np.tile([1.0, 0.0, np.nan], (3, 1)), np.zeros(3), np.ones(3), np.zeros(3, bool))
    rows = rows_of(spark, x, y, fold)
    loss = rg.Loss()
    models = rg.fit_all(rows, ["a", "b", "c"], scaling, loss, 30, 1e-6)
    assert np.isfinite(models).all() and models[:, 0, 2:] == pytest.approx(np.zeros((3, 2)))
    odd = rows.unionByName(rows.limit(2).withColumn("y", F.lit(None).cast("double"))).unionByName(rows.limit(2).withColumn("y", F.lit(float("nan"))))
    assert rg.fit_all(odd, ["a", "b", "c"], scaling, loss, 30, 1e-6) == pytest.approx(models, abs=1e-9)
    assert (rg.fit_all(rows.limit(0), ["a", "b", "c"], scaling, loss, 3, 0.0) == 0).all()


def test_loss_settings_are_checked():
    for wrong in ({"kind": "l1"}, {"delta": 0.0}, {"levels": (0.0,)}, {"levels": ()}, {"reg": -1.0}):
        with pytest.raises(ValueError):
            rg.Loss(**wrong)


def test_sums_of_vectors(spark):
    made = spark.range(0, 90, 1, 45).mapInArrow(
        lambda it: (vector_row(np.array([1.0, float(sum(b.column(0).to_pylist()))])) for b in it if b.num_rows), "values binary"
    )
    assert sum_vectors(made, "float64").tolist() == [45.0, 4005.0]
    assert sum_vectors(made, "float64", fan=3).tolist() == [45.0, 4005.0]
    assert sum_vectors(made.limit(0), "float64") is None


def stays(spark, n=240, seed=8):
    """The target is twice the level of the other variable, plus one and skewed noise."""
    rng = np.random.default_rng(seed)
    rows = []
    for ind in range(n):
        level = float(rng.uniform(0, 10))
        rows += [(ind, t, 1, level + float(rng.normal() * 0.05), "F", 50.0 + ind % 9) for t in (10, 20, 30)]
        rows.append((ind, 60, 0, 2 * level + 1 + float(rng.exponential(2.0)), "F", 50.0 + ind % 9))
    return spark.createDataFrame(rows, "ind long, time long, itemid long, value double, gender string, age double")


TASK = fc.ForecastTask(target=0, time_token=2)


def test_quantile_forecasts_feed_point_forecast_and_loss(spark):
    from irregts.operators.split import k_folds

    df, settings = stays(spark), fc.FitSettings(loss="pinball")
    folds = k_folds(df, 3, 1).cache()
    out = fc.fit_predict_folds(df, TASK, [0, 1], folds, 3, settings).cache()
    rows = out.collect()
    assert len(rows) == 240 and all(len(r["q_pred"]) == 3 and r["y_pred"] == r["q_pred"][1] for r in rows)
    below = [np.mean([r["y_true"] < r["q_pred"][i] for r in rows]) for i in range(3)]
    assert below == pytest.approx([0.1, 0.5, 0.9], abs=0.07)
    losses = {r["q"]: r["mean_loss"] for r in me.pinball_loss(out, settings.levels, ["set"]).collect()}
    flat = out.withColumn("q_pred", F.array(*[F.lit(x) for x in np.quantile([r["y_true"] for r in rows], settings.levels)]))
    plain = {r["q"]: r["mean_loss"] for r in me.pinball_loss(flat, settings.levels, ["set"]).collect()}
    assert all(losses[q] < 0.6 * plain[q] for q in settings.levels)


def test_an_interrupted_fit_goes_on_from_its_last_step(spark, tmp_path, monkeypatch):
    from irregts.operators.split import k_folds

    df, settings = stays(spark, 90), fc.FitSettings(loss="pinball", iterations=12, tolerance=0.0)
    folds = k_folds(df, 2, 1).cache()
    whole = {r["ind"]: r["q_pred"] for r in fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, settings).collect()}
    path, steps = str(tmp_path / "models"), []
    real = fc.Progress.save

    def failing(self, step, models):
        real(self, step, models)
        steps.append(step)
        if step == 7:
            raise RuntimeError("lost")

    monkeypatch.setattr(fc.Progress, "save", failing)
    with pytest.raises(RuntimeError, match="lost"):
        fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, settings, path, resume=True)
    steps.clear()
    monkeypatch.setattr(fc.Progress, "save", lambda self, step, models: steps.append(step))
    with pytest.raises(ValueError, match="other settings"):
        fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, fc.FitSettings(iterations=12), path, resume=True)
    again = fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, settings, path, resume=True)
    assert steps == list(range(6, 13))
    assert {r["ind"]: pytest.approx(r["q_pred"], abs=1e-9) for r in again.collect()} == whole
    monkeypatch.setattr(fc, "fit_models", None)  # models that are there are not fitted again
    assert fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, settings, path, resume=True).count() == 90
    with pytest.raises(ValueError, match="other settings"):
        fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, fc.FitSettings(), path, resume=True)


def test_saved_settings_score_another_cohort(spark, tmp_path):
    from irregts.operators.split import k_folds

    df, settings = stays(spark, 90), fc.FitSettings(loss="huber", delta=0.7, features=("v1",), fit_on="own")
    folds, path = k_folds(df, 2, 1).cache(), str(tmp_path / "models")
    fc.fit_predict_folds(df, TASK, [0, 1], folds, 2, settings, path).count()
    models = spark.read.parquet(path)
    assert fc.FitSettings.of(models) == settings
    plain = {r["ind"]: r["y_pred"] for r in fc.score_cohort(df, models, 0, TASK, [0, 1]).collect()}
    given = {r["ind"]: r["y_pred"] for r in fc.score_cohort(df, models, 0, TASK, [0, 1], settings).collect()}
    assert plain == given and len(plain) == 90


def test_only_wanted_sides_are_made(spark):
    from irregts.operators.split import k_folds

    df = stays(spark, 60)
    folds = k_folds(df, 3, 1).cache()
    features, stats = fc.prepare_folds(df, TASK, [0, 1], folds, 3)
    both = fc.fold_features(features, folds, stats, 3, ["v1", "age"])
    test = fc.fold_features(features, folds, stats, 3, ["v1", "age"], sides=["test"])
    assert "Generate" not in test._jdf.queryExecution().toString()
    assert sorted(map(tuple, test.collect())) == sorted(map(tuple, both.filter("set = 'test'").collect()))
