"""Forecast tasks, cross-validated fitting and batch scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irregts.functions.expr import gender_code, standardise, unstandardise
from irregts.operators.layout import small_side
from irregts.operators.metrics import point_from_quantiles
from irregts.operators.normalize import fit_fold_stats, fit_stats
from irregts.operators.regression import HUBER_DELTA, THREE_QUANTILES, Loss, Scaling, fit_all
from irregts.operators.sequences import sample_targets, time_token_id
from irregts.operators.variables import resolve_labels
from irregts.operators.windows import forecast_inputs
from irregts.session import materialise

# Preset name -> (target label, labels hidden from the inputs).
PRESETS: dict[str, tuple[str, tuple[str, ...]]] = {
    "29": ("Creatinine (serum)", ()),
    "29-SCr": ("Creatinine (serum)", ("Creatinine (serum)",)),
    "206": ("Creatinine (serum)", ()),
    "206-SCr": ("Creatinine (serum)", ("Creatinine (serum)",)),
    "eICU": ("creatinine", ()),
    "eICU-SCr": ("creatinine", ("creatinine",)),
}


_STATS = ("mean", "std")


@dataclass(frozen=True)
class ForecastTask:
    """What to forecast and what the inputs may hold, in variable ids."""

    target: int
    time_token: int
    masked: tuple[int, ...] = ()
    back_minutes: float | None = None
    horizon_hours: float | None = None
    history_hours: tuple[float, ...] | None = None
    max_measures: int | None = None

    def inputs(self, df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        return forecast_inputs(
            df,
            self.target,
            self.masked,
            self.back_minutes,
            self.horizon_hours,
            self.history_hours,
            self.max_measures,
            targets=targets,
        )


def forecast_task(
    key: DataFrame,
    target_label: str | None = None,
    masked_labels: Sequence[str] = (),
    preset: str | None = None,
    presets: Mapping[str, tuple[str, tuple[str, ...]]] = PRESETS,
    **limits,
) -> ForecastTask:
    """A task from labels, or from a preset, resolved against the variable key."""
    if preset is not None:
        if preset not in presets:
            raise ValueError(f"unknown preset {preset!r}; known: {sorted(presets)}")
        target_label, masked_labels = presets[preset]
    if target_label is None:
        raise ValueError("a target label or a preset is needed")
    ids = resolve_labels(key, [target_label, *masked_labels])
    return ForecastTask(
        target=ids[target_label],
        time_token=time_token_id(key),
        masked=tuple(ids[label] for label in masked_labels),
        **limits,
    )


@dataclass(frozen=True)
class FitSettings:
    """Settings of the linear forecaster.

    ``loss`` is ``huber`` (quadratic up to ``delta`` deviations of the target), ``pinball`` (a
    forecast per level) or ``squaredError``; see ``regression.Loss``. ``features`` names some of
    ``v<id>`` (latest value of a variable), ``gender``, ``age`` and ``time`` (of the target); all by
    default. With ``fit_on="train"`` both sides of a fold are normalised with the statistics of the
    train side, with ``"own"`` each side with its own. Settings are saved with the models.
    """

    loss: str = "huber"
    delta: float = HUBER_DELTA
    levels: tuple[float, ...] = THREE_QUANTILES
    reg: float = 0.01
    smoothing: float = 1e-3
    iterations: int = 50
    tolerance: float = 1e-4
    with_train: bool = False
    features: tuple[str, ...] | None = None
    fit_on: str = "train"

    def __post_init__(self) -> None:
        if self.fit_on not in ("train", "own"):
            raise ValueError(f"fit_on is 'train' or 'own', not {self.fit_on!r}")
        self.objective()

    def objective(self) -> Loss:
        return Loss(self.loss, self.delta, tuple(self.levels), self.reg, self.smoothing)

    def names(self, variables: Sequence[int]) -> list[str]:
        return list(self.features or [*(f"v{v}" for v in variables), "gender", "age", "time"])

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def of(cls, models: DataFrame) -> FitSettings:
        """The settings that saved models were fitted with."""
        saved = json.loads(models.select("settings").first()["settings"])
        lists = {k: tuple(v) for k, v in saved.items() if isinstance(v, list)}
        return cls(**(saved | lists))


def last_values(inputs: DataFrame, variables: Sequence[int]) -> DataFrame:
    """One column ``v<id>`` per variable with the stay's latest value, null if never seen."""
    latest = (
        inputs.groupBy("ind", "itemid")
        .agg(F.max(F.struct("time", "value")).alias("_last"))
        .select("ind", "itemid", F.col("_last.value").alias("value"))
    )
    return latest.groupBy("ind").agg(
        *(F.max(F.when(F.col("itemid") == v, F.col("value"))).alias(f"v{v}") for v in variables)
    )


def feature_table(df: DataFrame, task: ForecastTask, variables: Sequence[int]) -> DataFrame:
    """One row per stay with a target: ``ind, y_true, gender, age, time, v<id>...``, unscaled."""
    targets = materialise(sample_targets(df, task.target), "targets")
    latest = last_values(task.inputs(df, targets), variables)
    return targets.join(latest, "ind", "left").select(
        "ind",
        F.col("tgt_value").alias("y_true"),
        gender_code(F.col("gender")).alias("gender"),
        F.col("age").cast("double").alias("age"),
        F.col("tgt_time").cast("double").alias("time"),
        *(f"v{v}" for v in variables),
    )


def side_stats(stats: DataFrame, by: Sequence[str], target: int, variables: Sequence[int]) -> DataFrame:
    """Statistics of :func:`fit_stats` as one row per group: ``<name>_mean`` and ``<name>_std``
    of the target (``y``), of age, time and of each variable (``v<id>``)."""
    of_item = {f"v{v}": F.col("itemid") == v for v in variables} | {"y": F.col("itemid") == target}
    parts = [
        F.max(F.when(is_item, F.col(f"value_{s}"))).alias(f"{name}_{s}") for name, is_item in of_item.items() for s in _STATS
    ]
    parts += [F.max(f"{c}_{s}").alias(f"{c}_{s}") for c in ("age", "time") for s in _STATS]
    return stats.groupBy(*by).agg(*parts) if by else stats.agg(*parts)


def _scaled(names: Sequence[str]) -> list[Column]:
    """Normalised features ``x_<name>``; a missing value sits at its mean. The target is ``y``."""

    def scale(name: str, source: str) -> Column:
        return standardise(F.col(source), F.col(f"{name}_mean"), F.col(f"{name}_std"))

    plain = [F.col(n) if n == "gender" else F.coalesce(scale(n, n), F.lit(0.0)) for n in names]
    return [*(x.alias(f"x_{n}") for n, x in zip(names, plain)), scale("y", "y_true").alias("y")]


def fold_features(
    features: DataFrame,
    folds: DataFrame,
    stats: DataFrame,
    k: int,
    names: Sequence[str],
    fit_on: str = "train",
    sides: Sequence[str] = ("train", "test"),
) -> DataFrame:
    """The features of every stay in each of k folds: ``ind, fold, set, y_true, x_..., y,
    y_mean, y_std``. ``stats`` is :func:`side_stats` per fold and split. The ``test`` side alone
    has one row per stay, which nothing multiplies by k."""
    each = features.join(folds.withColumnRenamed("fold", "_own"), "ind")
    if list(sides) == ["test"]:
        each = each.filter(F.col("_own").between(0, k - 1)).withColumns({"fold": F.col("_own"), "set": F.lit("test")})
    else:
        each = each.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        each = each.withColumn("set", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train"))
        each = each.filter(F.col("set").isin(*sides))
    if fit_on == "train":
        joined = each.join(small_side(stats.filter(F.col("split") == "train").drop("split")), "fold")
    else:
        joined = each.join(small_side(stats.withColumnRenamed("split", "set")), ["fold", "set"])
    return joined.select("ind", "fold", "set", "y_true", *_scaled(names), "y_mean", "y_std")


_MODEL = "fold int, names array<string>, coefficients array<array<double>>, intercepts array<double>, settings string"
_STEPS = "step int, settings string, names array<string>, shape array<int>, values array<double>"


def _scaling(stats: DataFrame, k: int, names: Sequence[str]) -> Scaling:
    """The statistics of the k train sides: 2 numbers per fold and feature reach the driver."""
    scaled = [n for n in names if n != "gender"]
    rows = {r["fold"]: r for r in stats.filter(F.col("split") == "train").collect()}

    def column(fold: int, name: str) -> float:
        value = rows[fold][name] if fold in rows else None
        return float("nan") if value is None else float(value)

    table = {s: np.array([[column(f, f"{n}_{s}") if n in scaled else 0.0 for n in names] for f in range(k)]) for s in _STATS}
    truth = {s: np.array([column(f, f"y_{s}") for f in range(k)]) for s in _STATS}
    plain = np.array([n not in scaled for n in names], bool)
    return Scaling(table["mean"].reshape(k, -1), table["std"].reshape(k, -1), truth["mean"], truth["std"], plain)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


class Progress:
    """Steps of an unfinished fit, saved beside the models every ``every`` steps."""

    def __init__(self, spark: SparkSession, path: str, settings: FitSettings, names: Sequence[str], every: int = 5) -> None:
        self.spark, self.path, self.settings, self.names, self.every = spark, f"{path}-steps", settings, list(names), every

    def save(self, step: int, models: np.ndarray) -> None:
        if step % self.every == 0:
            row = (step, self.settings.text(), self.names, list(models.shape), models.ravel().tolist())
            self.spark.createDataFrame([row], _STEPS).coalesce(1).write.mode("append").parquet(self.path)

    def last(self) -> tuple[int, np.ndarray] | None:
        """The last saved step; one of other settings or features is an error."""
        if not _exists(self.spark, self.path):
            return None
        rows = self.spark.read.schema(_STEPS).parquet(self.path).orderBy(F.desc("step")).limit(1).collect()
        if not rows:
            return None
        check_same(rows[0]["settings"], rows[0]["names"], self.settings, self.names, self.path)
        return rows[0]["step"], np.array(rows[0]["values"]).reshape(rows[0]["shape"])


def check_same(saved: str, saved_names: Sequence[str], settings: FitSettings, names: Sequence[str], path: str) -> None:
    if saved != settings.text() or list(saved_names) != list(names):
        raise ValueError(f"{path} holds a fit of other settings: {saved} of {list(saved_names)}")


def fit_models(
    features: DataFrame,
    folds: DataFrame,
    stats: DataFrame,
    k: int,
    names: Sequence[str],
    settings: FitSettings = FitSettings(),
    progress: Progress | None = None,
) -> DataFrame:
    """One row per fold: ``fold, names, coefficients`` and ``intercepts`` (one per output),
    ``settings`` and the statistics of the train side, which is all that a later forecast needs.

    All folds and outputs are fitted together; each step reads the rows once.
    """
    own = folds.select("ind", "fold")
    columns = [F.col(n) for n in names]
    rows = materialise(features.join(own, "ind").select("fold", F.col("y_true").alias("y"), *columns), "fit_rows")
    fitted = fit_all(
        rows,
        names,
        _scaling(stats, k, names),
        settings.objective(),
        settings.iterations,
        settings.tolerance,
        start=None if progress is None else progress.last(),
        after_step=None if progress is None else progress.save,
    )
    made = [
        (fold, list(names), [m[1:].tolist() for m in of_fold], [float(m[0]) for m in of_fold], settings.text())
        for fold, of_fold in enumerate(fitted)
    ]
    fits = features.sparkSession.createDataFrame(made, _MODEL)
    return fits.join(stats.filter(F.col("split") == "train").drop("split"), "fold")


def apply_models(scaled: DataFrame, models: DataFrame, names: Sequence[str], quantiles: bool = False) -> DataFrame:
    """Forecasts ``ind, fold, set, y_true, y_pred`` for rows of :func:`fold_features`; with
    ``quantiles`` also ``q_pred``, one per output, of which ``y_pred`` is the point forecast."""
    fits = small_side(models.select("fold", "names", "coefficients", "intercepts"))
    problem = F.concat(F.lit("the model was fitted on other features: "), F.array_join("names", ", "))
    same = F.col("names") == F.array(*(F.lit(n) for n in names))
    weights = F.when(same, F.col("coefficients")).otherwise(F.raise_error(problem).cast("array<array<double>>"))
    given = F.array(*(F.col(f"x_{n}") for n in names))

    def output(own: Column, intercept: Column) -> Column:
        products = F.zip_with(given, own, lambda x, w: x * w)
        raw = intercept + F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
        return unstandardise(raw, F.col("y_mean"), F.col("y_std"))

    joined = scaled.join(fits, "fold").withColumn("q_pred", F.zip_with(weights, F.col("intercepts"), output))
    more = ["q_pred"] if quantiles else []
    return point_from_quantiles(joined).select("ind", "fold", "set", "y_true", "y_pred", *more)


def prepare_folds(
    df: DataFrame, task: ForecastTask, variables: Sequence[int], folds: DataFrame, k: int
) -> tuple[DataFrame, DataFrame]:
    """Written tables for all folds: unscaled features and statistics per fold and side."""
    features = materialise(feature_table(df, task, variables), "features")
    stats = side_stats(fit_fold_stats(df, folds, k), ["fold", "split"], task.target, variables)
    return features, materialise(stats, "stats")


def fit_predict_folds(
    df: DataFrame,
    task: ForecastTask,
    variables: Sequence[int],
    folds: DataFrame,
    k: int,
    settings: FitSettings = FitSettings(),
    models_path: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """Fit on the train side of each fold, forecast its test side (and its train side, if
    set). The fitted models are saved at ``models_path`` for :func:`score_cohort`.

    With ``resume`` a fit that was cut short goes on from its last saved step, and models that are
    there are not fitted again; both must be of the same settings.
    """
    spark, names = df.sparkSession, settings.names(variables)
    features, stats = prepare_folds(df, task, variables, folds, k)
    if models_path is None:
        models = fit_models(features, folds, stats, k, names, settings)
    else:
        if resume and _exists(spark, f"{models_path}/_SUCCESS"):
            saved = spark.read.parquet(models_path).first()
            check_same(saved["settings"], saved["names"], settings, names, models_path)
        else:
            progress = Progress(spark, models_path, settings, names) if resume else None
            mode = "overwrite" if resume else "errorifexists"
            fit_models(features, folds, stats, k, names, settings, progress).write.mode(mode).parquet(models_path)
        models = spark.read.parquet(models_path)
    sides = ("train", "test") if settings.with_train else ("test",)
    scaled = fold_features(features, folds, stats, k, names, settings.fit_on, sides)
    return apply_models(scaled, models, names, settings.loss == "pinball")


def score_cohort(
    rows: DataFrame,
    models: DataFrame,
    fold: int,
    task: ForecastTask,
    variables: Sequence[int],
    settings: FitSettings | None = None,
    features: DataFrame | None = None,
) -> DataFrame:
    """Forecasts of a saved fold's model for other rows, as the set ``test``.

    ``settings`` are those saved with the models if not given; ``features`` is their
    :func:`feature_table`, for a caller that scores the rows several times. The rows are normalised
    with the saved statistics of the train side or, with ``fit_on="own"``, with their own.
    """
    settings = settings or FitSettings.of(models)
    names = settings.names(variables)
    features = feature_table(rows, task, variables) if features is None else features
    features = features.withColumns({"fold": F.lit(fold), "set": F.lit("test")})
    if settings.fit_on == "own":
        stats = side_stats(fit_stats(rows), [], task.target, variables).withColumn("fold", F.lit(fold))
    else:
        stats = models.filter(F.col("fold") == fold).drop("names", "coefficients", "intercepts", "settings")
    scaled = features.join(small_side(stats), "fold")
    scaled = scaled.select("ind", "fold", "set", "y_true", *_scaled(names), "y_mean", "y_std")
    return apply_models(scaled, models, names, settings.loss == "pinball")


Predictor = Callable[[dict[str, np.ndarray]], np.ndarray]


def score_batches(batches: DataFrame, predict: Predictor) -> DataFrame:
    """Run ``predict`` on each padded batch.

    ``predict`` gets arrays ``demog, values, times, variables, mask`` with one row per
    sample and returns one forecast, or one row of quantile forecasts, per sample. Batches
    stay together in sorted partitions, and a task walks through many of them, holding
    an Arrow chunk and the batch that its end cuts. The stay id travels with its forecast.
    """
    columns = ("demog", "values", "times", "variables", "mask")

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        out = np.asarray(predict({c: np.stack(batch[c].to_numpy()) for c in columns}), dtype="float64")
        out = out.reshape(len(batch), -1)
        return pd.DataFrame({"ind": batch["ind"], "y_true": batch["tgt_value"], "q_pred": list(out)})

    def walk(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for chunk in chunks:
            rows = chunk if held is None else pd.concat([held, chunk], ignore_index=True)
            ids = rows["batch_id"].to_numpy()
            starts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist()]
            done = [score(rows.iloc[a:b]) for a, b in zip(starts, starts[1:])]
            held = rows.iloc[starts[-1] :] if len(rows) else None
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None:
            yield score(held)

    placed = batches.repartition("batch_id").sortWithinPartitions("batch_id", "row_in_batch")
    return placed.mapInPandas(walk, "ind long, y_true double, q_pred array<double>")
