"""One query per operator over the given tables. Every query reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irregts.functions.expr import KDIGO_BOUNDS, stage
from irregts.operators import cohort as co
from irregts.operators import forecast as fc
from irregts.operators import metrics as me
from irregts.operators import normalize as no
from irregts.operators import sequences as se
from irregts.operators import split as sp
from irregts.operators import stays as st
from irregts.operators import variables as va
from irregts.operators import windows as wi
from irregts.plans import stages
from irregts.plans import views as v
from irregts.session import configure, materialise, scratch_path
from irregts.sources import events as ev
from irregts.sources import offsets as off
from irregts.sources import writers as wr
from irregts.sources.tables import read_key, read_measures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STAGES = v.STAGES
K = 5


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: v.text_time(c) for c in columns})


# --- sources -------------------------------------------------------------------


def _as_csv(spark, raw: DataFrame) -> list[str]:
    """A raw table as two CSV tables, whose columns are in opposite order."""
    half = F.pmod(F.xxhash64(*raw.columns), F.lit(2))
    paths = []
    for i, columns in enumerate((raw.columns, raw.columns[::-1])):
        part = raw.filter(half == i).select(*columns)
        path = scratch_path(spark, "csv")
        part.write.option("header", True).option("emptyValue", '""').csv(path)
        paths.append(path)
    return paths


def _read_events(spark, raw: DataFrame, kind: str) -> DataFrame:
    return ev.read_events(spark, _as_csv(spark, raw), kind)


def _coded(raw: DataFrame) -> DataFrame:
    """Raw events with their variables as the numbers that event files hold."""
    return raw.withColumn("itemid", F.ascii("itemid").cast("long"))


@query
def src_measurements(spark, d):
    return as_text(_read_events(spark, _coded(v.raw_events(spark, d)), "chartevents"), "charttime")


@query
def src_datetime_values(spark, d):
    return as_text(_read_events(spark, _coded(v.raw_datetime_events(spark, d)), "datetimeevents"), "charttime")


@query
def src_renamed_events(spark, d):
    return as_text(_read_events(spark, _coded(v.raw_order_events(spark, d)), "inputevents"), "charttime")


@query
def src_output_events(spark, d):
    raw = v.raw_events(spark, d).withColumnRenamed("valuenum", "value")
    return as_text(_read_events(spark, _coded(raw), "outputevents"), "charttime")


@query
def src_procedure_events(spark, d):
    return as_text(_read_events(spark, _coded(v.raw_order_events(spark, d)), "procedureevents"), "charttime")


@query
def src_lab_events(spark, d):
    return as_text(_read_events(spark, _coded(v.raw_events(spark, d)), "labevents"), "charttime")


@query
def src_admissions(spark, d):
    raw = as_text(v.admissions(spark, d), "admittime").withColumn("deathtime", F.lit(None).cast("string"))
    return as_text(ev.read_admissions(spark, _as_csv(spark, raw)), "admittime").drop("deathtime")


@query
def src_patients(spark, d):
    return ev.read_patients(spark, _as_csv(spark, v.patients(spark, d)))


@query
def src_lab_offsets(spark, d):
    return off.read_lab_offsets(spark, _as_csv(spark, v.raw_lab_offsets(spark, d)))


@query
def unpivot_vitals(spark, d):
    raw = v.vitals_wide(spark, d).withColumnRenamed("time", "observationoffset")
    return off.unpivot_vitals(off.read_vitals(spark, _as_csv(spark, raw), v.VITALS), v.VITALS)


@query
def recode_age(spark, d):
    return off.read_stay_demographics(spark, _as_csv(spark, v.raw_stay_demographics(spark, d)))


def _key(spark, d) -> DataFrame:
    return va.variable_key(v.events(spark, d), v.catalogue(spark)).select("label", "key")


@query
def resolve_labels(spark, d):
    found = va.resolve_labels(_key(spark, d), ["signup", "purchase"])
    return spark.createDataFrame(sorted(found.items()), "label string, key long")


# --- rows ----------------------------------------------------------------------


@query
def select_variables(spark, d):
    wanted = v.catalogue(spark, ("purchase", "view", "signup"))
    return va.select_variables(v.events(spark, d), wanted).select("stay_id", "itemid", "value")


@query
def range_filter(spark, d):
    return va.remove_outside_range(v.measures(spark, d), 10.0, 50.5)


def _admitted(spark, d) -> DataFrame:
    return st.join_admissions(v.events(spark, d), v.admissions(spark, d))


@query
def join_admissions(spark, d):
    return as_text(_admitted(spark, d), "charttime", "admittime")


@query
def origin_filter(spark, d):
    kept = va.keep_origins(_admitted(spark, d), ["BUILDING", "MACHINERY"])
    return kept.select("stay_id", "itemid", "value", "admission_location")


@query
def join_patients(spark, d):
    return st.join_patients(v.events(spark, d), ev.clean_patients(v.patients(spark, d))).drop("charttime")


@query
def join_stay_demog(spark, d):
    labs = off.clean_lab_offsets(v.raw_lab_offsets(spark, d))
    return st.join_stay_demographics(labs, off.clean_stay_demographics(v.raw_stay_demographics(spark, d)))


@query
def relative_time(spark, d):
    return st.add_relative_time(_admitted(spark, d)).select("stay_id", "itemid", "time", "value")


@query
def stage_values(spark, d):
    return v.measures(spark, d).select(
        "ind",
        "value",
        stage(F.col("value"), STAGES).alias("own_stage"),
        stage(F.col("value") / 20, "KDIGO").alias("named_stage"),
        stage(F.col("value"), lambda x: F.floor(x / 50).cast("int")).alias("custom_stage"),
    )


def _vitals(spark, d, stay="l_suppkey") -> DataFrame:
    return off.unpivot_vitals(v.vitals_wide(spark, d, stay), v.VITALS)


def _labs(spark, d, stay="l_suppkey") -> DataFrame:
    return off.clean_lab_offsets(v.raw_lab_offsets(spark, d, stay))


@query
def union_sources(spark, d):
    raw = v.raw_events(spark, d)
    charted = ev.clean_events(raw, ev.LAYOUTS["chartevents"])
    inputs = ev.clean_events(v.raw_order_events(spark, d), ev.LAYOUTS["inputevents"])
    return as_text(charted.unionByName(inputs), "charttime")


def _offset_measures(spark, d, stay="l_suppkey") -> DataFrame:
    labs = _labs(spark, d, stay).withColumn("time", F.col("time").cast("long"))
    return _vitals(spark, d, stay).unionByName(labs)


@query
def union_relaxed(spark, d):
    return _offset_measures(spark, d)


# --- variables -----------------------------------------------------------------


@query
def variable_quantiles(spark, d):
    return va.variable_quantiles(_vitals(spark, d), {"q1": 0.25, "q3": 0.75}, by="variable")


@query
def remove_outliers(spark, d):
    return va.remove_outliers(_labs(spark, d), by="variable", spread=1.0)


@query
def top_variables(spark, d):
    return va.top_variables(_offset_measures(spark, d), 3, 1000, by="variable")


def _offset_catalogue(spark) -> DataFrame:
    names = (*v.VITALS, "A", "never", "N", "R")
    return spark.createDataFrame(
        [(n, n, i) for i, n in enumerate(names)], "label string, variable string, position int"
    )


@query
def variable_key(spark, d):
    key = va.variable_key(_offset_measures(spark, d), _offset_catalogue(spark), "variable")
    return read_key(spark, wr.write_key(key.select("label", "key"), scratch_path(spark, "key")))


@query
def variable_index(spark, d):
    rows = _offset_measures(spark, d)
    key = va.variable_key(rows, _offset_catalogue(spark), "variable")
    return va.index_variables(rows, key, "variable")


@query
def first_seen_index(spark, d):
    """Users numbered in the order in which they first appear, without a catalogue."""
    rows = v.table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("stay_id"))
    indexed, _ = va.index_by_first_appearance(rows, "stay_id", ["ts", "event_id"], "ind")
    return indexed.select("event_id", "stay_id", "ind")


# --- stays ---------------------------------------------------------------------


@query
def stay_index(spark, d):
    return st.index_stays(_labs(spark, d, "l_orderkey"), "patientunitstayid")


@query
def stay_ordinals(spark, d):
    return st.stay_ordinals(v.measures(spark, d).select("ind", "time", "itemid", "value"))


@query
def decimate(spark, d):
    return st.decimate_wide(v.vitals_wide(spark, d), v.VITALS)


@query
def min_duration_filter(spark, d):
    return st.filter_stays(v.measures(spark, d), min_hours=700)


@query
def stay_count_filter(spark, d):
    return st.filter_stays(v.measures(spark, d), 55, 75)


@query
def stay_count_filter_offsets(spark, d):
    return st.filter_stays(_offset_measures(spark, d, "l_orderkey"), 10, 20_000, stay="patientunitstayid")


@query
def dataset_report(spark, d):
    return st.dataset_report(v.measures(spark, d))


def _profile_columns(df: DataFrame) -> DataFrame:
    return df.withColumn("t_first", F.col("t_first").cast("long")).withColumn("t_last", F.col("t_last").cast("long"))


# A forecaster that SQL can follow: least squares on the latest value of one variable.
ONE_FEATURE = fc.FitSettings(loss="squaredError", reg=0.0, features=("v2",))
ALL = range(len(v.LABELS))

STRICT = replace(v.BASE_RULES, pred_horizon=12, pred_history=24)
LISTED = replace(v.BASE_RULES, target=1, skippable=(1,), include=(2, 3), exclude=(5,))
CAPPED = replace(STRICT, max_hours=168)
STAGED = replace(v.BASE_RULES, entry_stages=(1, 2, 3), exit_stages=(0, 1, 2), entry_above_exit=True)
OTHER = replace(v.BASE_RULES, target=3, skippable=(3,), pred_history=48)


@query
def stay_profile(spark, d):
    return _profile_columns(co.stay_profile(v.line_measures(spark, d), LISTED))


@query
def cull_stays(spark, d):
    return co.cull_decisions(v.measures(spark, d), STRICT).select("ind", "kept")


@query
def cull_cohort(spark, d):
    return co.cull_cohort(v.measures(spark, d), CAPPED)


@query
def cull_by_stage(spark, d):
    return co.cull_cohort(v.measures(spark, d), STAGED)


@query
def cull_include_exclude(spark, d):
    return co.cull_cohort(v.line_measures(spark, d), LISTED)


@query
def cull_labels(spark, d):
    return co.stay_labels(v.measures(spark, d), v.BASE_RULES)


@query
def usable_stays(spark, d):
    """Which stays can forecast a purchase, and in which stage does each end?"""
    rows = va.remove_outliers(v.events(spark, d))
    key = va.variable_key(rows, v.catalogue(spark))
    timed = st.add_relative_time(st.join_admissions(va.index_variables(rows, key), v.admissions(spark, d)))
    sized = st.filter_stays(timed.withColumnRenamed("stay_id", "ind"), 10, 30_000)
    rules = co.rules_by_label(key, "purchase", skippable=["purchase"], staging=v.STAGES)
    return co.stay_labels(sized, rules)


@query
def preprocess_events(spark, d):
    rows, _ = stages.measures_from_events(
        v.events(spark, d),
        v.admissions(spark, d),
        ev.clean_patients(v.patients(spark, d)),
        v.catalogue(spark),
        min_measures=50,
        max_measures=90,
        min_hours=600,
    )
    return rows


@query
def preprocess_offsets(spark, d):
    rows, _ = stages.measures_from_offsets(
        _labs(spark, d),
        v.vitals_wide(spark, d),
        off.clean_stay_demographics(v.raw_stay_demographics(spark, d)),
        ["A", "N", "R"],
        v.VITALS,
        spread=1.0,
    )
    return rows


# --- splits and normalisation ----------------------------------------------------


def _customers(spark, d) -> DataFrame:
    return v.table(spark, d, "customer").select(F.col("c_custkey").alias("ind"))


@query
def split_kfold(spark, d):
    splits = sp.fold_splits(sp.k_folds(_customers(spark, d), K, 1), K)
    return wr.read_splits(spark, wr.write_splits(splits, scratch_path(spark, "splits")))


@query
def split_holdout(spark, d):
    return sp.holdout(_customers(spark, d), 1)


@query
def split_stratified(spark, d):
    rows, labels = stages.cohort_and_labels(v.measures(spark, d), replace(v.BASE_RULES, staging=(20.0, 45.0)))
    return sp.stratified_holdout(rows, labels, 1)


def _splits(spark, d) -> DataFrame:
    return sp.holdout(v.measures(spark, d), 1)


@query
def restrict_to_split(spark, d):
    test = sp.split_stays(_splits(spark, d), 0, "test")
    return st.restricted_rows(v.measures(spark, d), test)


@query
def stay_intersection(spark, d):
    m = v.measures(spark, d)
    return st.common_stays(co.cull_cohort(m, STAGED), co.cull_cohort(m, OTHER))


@query
def decoupled_eval(spark, d):
    """A model of one cohort, saved, read back and scored on the test stays of another."""
    rows = materialise(v.cohort(spark, d), "cohort")
    splits = sp.holdout(rows, 1)
    folds = splits.select("ind", F.when(F.col("split") == "test", 0).otherwise(1).alias("fold"))
    task, path = _task(spark, d), scratch_path(spark, "models")
    fc.fit_predict_folds(rows, task, ALL, materialise(folds, "folds"), 1, ONE_FEATURE, path)
    models = spark.read.parquet(path)
    other = stages.decoupled_rows(co.cull_cohort(v.measures(spark, d), OTHER), splits, 0)
    features = materialise(fc.feature_table(other, task, ALL), "features")
    tables = []
    for fit_on in ("train", "own"):
        settings = replace(ONE_FEATURE, fit_on=fit_on)
        scored = fc.score_cohort(other, models, 0, task, ALL, settings, features)
        scores = me.regression_scores(scored).unpivot(["set", "fold"], ["mae", "r2"], "metric", "value")
        tables.append(scores.withColumn("fit_on", F.lit(fit_on)))
    return rounded(tables[0].unionByName(tables[1]), ["value"], 6)


def _fold_stats(spark, d, mode) -> DataFrame:
    m = v.measures(spark, d)
    return no.fit_fold_stats(m, sp.k_folds(m, K, 1), K, mode)


@query
def norm_stats_standard(spark, d):
    stats = _fold_stats(spark, d, "standard").select("fold", "split", "itemid", "value_mean", "value_std")
    return rounded(stats, ["value_mean", "value_std"], 9)


@query
def norm_stats_minmax(spark, d):
    return _fold_stats(spark, d, "minmax").select("fold", "split", "itemid", "value_min", "value_max")


@query
def norm_stats_global(spark, d):
    names = ["age_mean", "age_std", "time_mean", "time_std"]
    stats = _fold_stats(spark, d, "standard").select("fold", "split", *names).distinct()
    return rounded(stats, names, 5)


def _split_rows(spark, d) -> DataFrame:
    return v.measures(spark, d).join(_splits(spark, d).select("ind", "split"), "ind")


def _normal_columns(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, ["value", "time", "age"], digits)


@query
def normalize_standard(spark, d):
    return _normal_columns(no.normalize(_split_rows(spark, d), ["split"]))


@query
def normalize_minmax(spark, d):
    return _normal_columns(no.normalize(_split_rows(spark, d), ["split"], "minmax"))


@query
def normalize_apply(spark, d):
    train = no.fit_stats(_split_rows(spark, d).filter("split = 'train'"))
    return _normal_columns(no.apply_stats(v.measures(spark, d), train))


@query
def normalize_time_only(spark, d):
    return _normal_columns(no.normalize(v.measures(spark, d), values=False))


@query
def denormalize_predictions(spark, d):
    m = v.measures(spark, d)
    folds = sp.k_folds(m, K, 1)
    scaled = co.kept_stays(m, v.BASE_RULES).join(folds, "ind").select(
        "ind",
        "fold",
        F.lit("test").alias("split"),
        (F.col("exit_value") / 100).alias("y_true"),
        (F.col("entry_value") / 100).alias("y_pred"),
    )
    stats = no.fit_fold_stats(m, folds, K)
    return rounded(no.denormalize_predictions(scaled, stats, v.TARGET, ["fold", "split"]), ["y_true", "y_pred"])


# --- forecast inputs -------------------------------------------------------------

PLAIN = ("ind", "itemid", "time", "value")
TOKEN = len(v.LABELS)


def _inputs(spark, d, **limits) -> DataFrame:
    return wi.forecast_inputs(v.measures(spark, d), v.TARGET, **limits).select(*PLAIN)


@query
def target_obs(spark, d):
    return wi.target_observations(v.measures(spark, d), v.TARGET)


@query
def input_rows(spark, d):
    return _inputs(spark, d)


@query
def masked_inputs(spark, d):
    return _inputs(spark, d, masked=(0, 3))


@query
def window_lookback(spark, d):
    return _inputs(spark, d, masked=(0,), back_minutes=300)


@query
def window_horizon(spark, d):
    return _inputs(spark, d, horizon_hours=48)


@query
def window_history(spark, d):
    return _inputs(spark, d, history_hours=(24, 96, 500, 690, 720))


@query
def window_last_n(spark, d):
    return _inputs(spark, d, max_measures=15)


@query
def forecast_inputs(spark, d):
    return _inputs(
        spark, d, masked=(1,), back_minutes=600, horizon_hours=24, history_hours=(48, 300, 600), max_measures=20
    )


SPARSE = dict(masked=(0, 1, 2, 3), horizon_hours=650, history_hours=(12, 200))


@query
def empty_inputs(spark, d):
    m = v.measures(spark, d)
    targets = materialise(wi.target_observations(m, v.TARGET), "targets")
    return wi.empty_inputs(targets, wi.forecast_inputs(m, v.TARGET, targets=targets, **SPARSE))


@query
def demog_vector(spark, d):
    demog = se.stay_demographics(v.measures(spark, d))
    return demog.select("ind", F.posexplode(se.demog_vector(F.col("gender"), F.col("age"))).alias("pos", "x"))


def _task(spark, d, **limits) -> fc.ForecastTask:
    return fc.forecast_task(_key(spark, d), "purchase", ["click"], **limits)


@query
def forecast_task(spark, d):
    task = _task(spark, d, horizon_hours=24)
    return task.inputs(v.measures(spark, d)).select(
        *PLAIN, F.lit(task.target).cast("long").alias("target"), F.lit(task.time_token).cast("long").alias("token")
    )


@query
def sequence_tokens(spark, d):
    m = v.measures(spark, d)
    targets = materialise(wi.target_observations(m, v.TARGET), "targets")
    return se.sequence_rows(wi.forecast_inputs(m, v.TARGET, targets=targets), targets, TOKEN)


def _samples(spark, d) -> DataFrame:
    m = v.measures(spark, d)
    targets = materialise(se.sample_targets(m, v.TARGET), "targets")
    return se.sequences(wi.forecast_inputs(m, v.TARGET, targets=targets), targets, TOKEN)


def _positions(df: DataFrame, keys, arrays) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("pos", "item")
    return df.select(*keys, zipped).select(*keys, "pos", *(F.col(f"item.{a}").alias(a) for a in arrays))


@query
def long_batches(spark, d):
    m = v.measures(spark, d)
    targets = materialise(wi.target_observations(m, v.TARGET), "targets")
    rows = se.sequence_rows(wi.forecast_inputs(m, v.TARGET, targets=targets), targets, TOKEN)
    return se.long_batches(rows, se.batch_assignment(targets, 10))


@query
def sequences(spark, d):
    keys = ["ind", "tgt_value", "tgt_time"]
    return _positions(_samples(spark, d), keys, ["values", "times", "variables"])


@query
def batch_assignment(spark, d):
    return se.batch_assignment(_customers(spark, d), 64, drop_last=True, seed=7, epoch=2)


@query
def padded_batches(spark, d):
    samples = _samples(spark, d)
    padded = se.padded_batches(samples, se.batch_assignment(samples, 10))
    return _positions(padded, ["ind", "batch_id", "row_in_batch"], ["values", "times", "variables", "mask"])


# --- scores ----------------------------------------------------------------------


@query
def metric_mae(spark, d):
    scores = me.regression_scores(v.predictions(spark, d)).select("set", "fold", "mae")
    return rounded(scores, ["mae"], 10)


@query
def metric_medae(spark, d):
    return rounded(me.median_error(v.predictions(spark, d)), ["medae"], 9)


@query
def metric_r2(spark, d):
    return rounded(me.regression_scores(v.predictions(spark, d)).select("set", "fold", "r2"), ["r2"], 8)


@query
def metric_d2_gamma(spark, d):
    return rounded(me.regression_scores(v.predictions(spark, d)).select("set", "fold", "d2"), ["d2"], 8)


@query
def metric_accuracy(spark, d):
    scores = me.class_scores(v.predictions(spark, d), KDIGO_BOUNDS).select("set", "fold", "acc")
    return rounded(scores, ["acc"], 8)


@query
def metric_f1_weighted(spark, d):
    scores = me.class_scores(v.predictions(spark, d), KDIGO_BOUNDS).select("set", "fold", "f1")
    return rounded(scores, ["f1"], 8)


@query
def confusion_matrix(spark, d):
    return rounded(me.confusion_matrix(v.predictions(spark, d), KDIGO_BOUNDS), ["share"], 9)


@query
def metrics_by_fold(spark, d):
    scores = me.score_table(v.predictions(spark, d), KDIGO_BOUNDS)
    table = me.metrics_by_fold(scores, range(K))
    path = wr.write_metrics(table, scratch_path(spark, "metrics"))
    saved = spark.read.option("header", True).schema(table.schema).csv(path)
    return rounded(saved, [c for c in saved.columns if c not in ("set", "metric")], 10)


@query
def metrics_by_set(spark, d):
    return rounded(me.score_table(v.predictions(spark, d), KDIGO_BOUNDS, ["set"]), ["value"], 8)


@query
def point_from_quantiles(spark, d):
    several = v.predictions(spark, d).drop("y_pred")
    single = several.withColumn("q_pred", F.slice("q_pred", 1, 1)).withColumn("set", F.lit("single"))
    points = me.point_from_quantiles(several.unionByName(single))
    return rounded(points.select("ind", "set", "y_pred"), ["y_pred"], 8)


@query
def prediction_sheet(spark, d):
    sheet = me.prediction_sheet(v.predictions(spark, d), KDIGO_BOUNDS)
    path = wr.write_predictions(sheet, scratch_path(spark, "predictions"))
    return rounded(spark.read.parquet(path), ["target", "prediction"], 8)


@query
def loss_huber(spark, d):
    return rounded(me.huber_loss(v.predictions(spark, d), 0.8), ["huber"], 10)


@query
def loss_pinball(spark, d):
    losses = me.pinball_loss(v.predictions(spark, d), me.quantile_levels(3))
    return rounded(rounded(losses, ["mean_loss"], 10), ["sum_loss"], 5)


# --- forecasts and sinks -----------------------------------------------------------


@query
def cv_fit_predict(spark, d):
    m = v.measures(spark, d)
    folds = materialise(sp.k_folds(m, K, 1), "folds")
    return rounded(fc.fit_predict_folds(m, _task(spark, d), ALL, folds, K, ONE_FEATURE), ["y_pred"])


def _cv_fitted(spark, d, settings: fc.FitSettings) -> DataFrame:
    m = v.measures(spark, d)
    folds = materialise(sp.k_folds(m, K, 1), "folds")
    return fc.fit_predict_folds(m, _task(spark, d), ALL, folds, K, settings)


@query
def cv_fit_huber(spark, d):
    """All features, the default loss; a fixed number of steps, which SQL can follow."""
    return rounded(_cv_fitted(spark, d, fc.FitSettings(iterations=6, tolerance=0.0)), ["y_pred"], 5)


QUANTILES = fc.FitSettings(loss="pinball", iterations=6, tolerance=0.0)


@query
def cv_fit_quantiles(spark, d):
    low, high = F.col("q_pred")[0].alias("low"), F.col("q_pred")[2].alias("high")
    fitted = _cv_fitted(spark, d, QUANTILES).select("ind", "fold", "set", "y_true", low, "y_pred", high)
    return rounded(fitted, ["low", "y_pred", "high"], 5)


@query
def cv_quantile_loss(spark, d):
    losses = me.pinball_loss(_cv_fitted(spark, d, QUANTILES), QUANTILES.levels)
    return rounded(rounded(losses, ["mean_loss"], 5), ["sum_loss"], 3)


def _cv_features(spark, d, fit_on: str) -> DataFrame:
    m, names = v.measures(spark, d), ["v2", "v4", "gender", "age", "time"]
    folds = materialise(sp.k_folds(m, K, 1), "folds")
    features, stats = fc.prepare_folds(m, _task(spark, d), ALL, folds, K)
    table = fc.fold_features(features, folds, stats, K, names, fit_on).drop("y_mean", "y_std")
    return rounded(table, [f"x_{n}" for n in names] + ["y"])


@query
def cv_features(spark, d):
    return _cv_features(spark, d, "train")


@query
def cv_features_own(spark, d):
    return _cv_features(spark, d, "own")


def mean_of_inputs(batch: dict[str, np.ndarray]) -> np.ndarray:
    """Mean, least and greatest observed value per sample; the time token counts as 0."""
    seen = batch["mask"] == 1
    total = np.where(seen, batch["values"], 0.0).sum(axis=1)
    low = np.where(seen, batch["values"], np.inf).min(axis=1)
    high = np.where(seen, batch["values"], -np.inf).max(axis=1)
    return np.stack([total / seen.sum(axis=1), low, high], axis=1)


@query
def score_batches(spark, d):
    samples = _samples(spark, d)
    batches = se.padded_batches(samples, se.batch_assignment(samples, 10))
    scored = fc.score_batches(batches, mean_of_inputs)
    return scored.select(
        "ind",
        "y_true",
        F.round(F.col("q_pred")[0], 10).alias("mean_pred"),
        F.col("q_pred")[1].alias("low_pred"),
        F.col("q_pred")[2].alias("high_pred"),
    )


@query
def sink_roundtrip(spark, d):
    rows, labels = stages.cohort_and_labels(v.measures(spark, d), STRICT)
    table = wr.write_measures(rows, scratch_path(spark, "cohort"), "csv")
    stay_labels = wr.write_labels(labels, scratch_path(spark, "labels"))
    read = read_measures(spark, table, "csv")
    return read.join(spark.read.schema("ind long, label int").json(stay_labels), "ind")


@query
def stay_lookup(spark, d):
    """Three stays, looked up in a table that is laid out by stay."""
    path = wr.write_measures(v.measures(spark, d), scratch_path(spark, "by_stay"))
    return wr.read_stay(spark, path, 2, 7, 11)
