"""The stages end to end: raw tables to measures, measures to cohort, cohort to scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irregts.functions.expr import Staging, whole_minutes
from irregts.operators.cohort import CohortRules, kept_stays, labels_of_kept, rows_of_kept
from irregts.operators.forecast import FitSettings, ForecastTask, fit_predict_folds, score_cohort
from irregts.operators.layout import join_back, small_table
from irregts.operators.metrics import metrics_by_fold, score_table
from irregts.operators.split import holdout, k_folds, stratified_holdout
from irregts.operators.stays import (
    add_relative_time,
    decimate_wide,
    join_admissions,
    join_patients,
    join_stay_demographics,
    keep_sizes,
    number_stays,
    restricted_rows,
    stay_sizes,
)
from irregts.operators.variables import (
    index_variables,
    keep_origins,
    outlier_bounds,
    select_variables,
    variable_key,
    within_bounds,
)
from irregts.session import materialise
from irregts.sources.writers import PROCESSED


def measures_from_events(
    events: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    catalogue: DataFrame,
    min_hours: float = 0,
    min_measures: int = 10,
    max_measures: int = 30_000,
    origins: Sequence[str] | None = None,
    spread: float = 3.0,
) -> tuple[DataFrame, DataFrame]:
    """Events with absolute times to ``(processed rows, variable key)``.

    ``catalogue`` holds ``label``, ``itemid`` and ``position``. The selected events are
    written once, so that raw text is parsed once. Admissions, patients, stay numbers and
    stay filters meet on a table of (stay, admission, patient); the rows themselves are
    joined once.
    """
    wanted = materialise(select_variables(events, catalogue), "events")
    bounds = small_table(outlier_bounds(wanted, spread=spread))
    key = variable_key(bounds, catalogue)
    clean = within_bounds(wanted, bounds)

    ids = ["stay_id", "hadm_id", "subject_id"]
    visits = clean.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("_n"), F.min("charttime").alias("_first"), F.max("charttime").alias("_last")
    )
    admitted = materialise(join_admissions(visits, admissions), "visits")
    if origins is not None:
        admitted = keep_origins(admitted, origins)
    start = F.col("admittime")
    sizes = admitted.groupBy("stay_id").agg(
        F.sum("_n").alias("n_measures"),
        (F.max(whole_minutes(start, F.col("_last"))) - F.min(whole_minutes(start, F.col("_first")))).alias("minutes"),
    )
    stays = keep_sizes(number_stays(sizes, "stay_id"), min_measures, max_measures, min_hours)
    complete = join_patients(admitted.join(stays.select("stay_id", "ind"), "stay_id"), patients)
    rows = add_relative_time(join_back(index_variables(clean, key), complete.drop("_n", "_first", "_last"), ids))
    return rows.select(*(c for c in PROCESSED if c in rows.columns)), key


def measures_from_offsets(
    labs: DataFrame,
    vitals_wide: DataFrame,
    demographics: DataFrame,
    lab_names: Sequence[str],
    vitals: Sequence[str],
    min_measures: int = 10,
    max_measures: int = 20_000,
    spread: float = 3.0,
    stride: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Lab results and wide vitals in offset minutes to ``(processed rows, variable key)``.

    Outliers are removed from the labs only; the vitals are thinned. Variables are
    numbered vitals first, then labs, each in the listed order.
    """
    spark = labs.sparkSession
    names = [*vitals, *lab_names]
    catalogue = spark.createDataFrame(
        [(v, v, i) for i, v in enumerate(names)], "label string, variable string, position int"
    )
    listed = catalogue.filter(F.col("position") >= len(vitals))
    wanted = materialise(select_variables(labs, listed, "variable"), "labs")
    bounds = small_table(outlier_bounds(wanted, "variable", spread=spread))
    thinned = materialise(decimate_wide(vitals_wide, vitals, stride), "thinned")
    columns = ["patientunitstayid", "time", "variable", "value"]
    measures = thinned.select(*columns).unionByName(
        within_bounds(wanted, bounds, "variable").select(
            "patientunitstayid", F.col("time").cast("long"), "variable", F.col("value").cast("double")
        )
    )
    present = bounds.select("variable").union(thinned.select("variable").distinct())
    key = variable_key(present, catalogue, "variable")
    indexed = index_variables(measures, key, "variable")
    stay = "patientunitstayid"
    stays = keep_sizes(number_stays(stay_sizes(indexed, stay), stay), min_measures, max_measures)
    complete = join_stay_demographics(stays.select(stay, "ind"), demographics, stay)
    rows = join_back(indexed, complete, stay)
    return rows.select(*(c for c in PROCESSED if c in rows.columns)), key.select("label", "key")


def cohort_and_labels(measures: DataFrame, rules: CohortRules) -> tuple[DataFrame, DataFrame | None]:
    """Usable rows, and the exit stage per usable stay when a staging is set. Both come
    from one pass over the measures."""
    kept = materialise(kept_stays(measures, rules), "kept")
    labels = labels_of_kept(kept) if rules.staging is not None else None
    return rows_of_kept(measures, kept, rules), labels


def choose_folds(measures: DataFrame, k: int = 5, seed: int = 1, labels: DataFrame | None = None) -> DataFrame:
    """Test fold per stay. One fold means a hold-out split, stratified where labels are
    given: its test stays are fold 0, its train stays fold 1."""
    if k >= 2:
        return k_folds(measures, k, seed)
    splits = holdout(measures, seed) if labels is None else stratified_holdout(measures, labels, seed)
    return splits.select("ind", F.when(F.col("split") == "test", 0).otherwise(1).alias("fold"))


def evaluate(predictions: DataFrame, folds: Sequence[int], staging: Staging | None = None) -> DataFrame:
    """Scores by fold with their mean and deviation, per result set."""
    return metrics_by_fold(score_table(predictions, staging), folds)


def cross_validate(
    measures: DataFrame,
    task: ForecastTask,
    variables: Sequence[int],
    k: int = 5,
    seed: int = 1,
    labels: DataFrame | None = None,
    staging: Staging | None = None,
    settings: FitSettings = FitSettings(),
    models_path: str | None = None,
    resume: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds, forecasts of every fold's test stays (and train stays, if set) and scores.

    With ``models_path`` the fitted models are saved there for :func:`evaluate_cohort`; with
    ``resume`` an interrupted fit goes on from its saved steps.
    """
    folds = materialise(choose_folds(measures, k, seed, labels), "folds")
    fitted = fit_predict_folds(measures, task, variables, folds, max(k, 1), settings, models_path, resume)
    predictions = materialise(fitted, "predictions")
    return folds, predictions, evaluate(predictions, range(max(k, 1)), staging)


def evaluate_cohort(
    other_cohort: DataFrame,
    splits: DataFrame,
    fold: int,
    models: DataFrame,
    task: ForecastTask,
    variables: Sequence[int],
    staging: Staging | None = None,
    settings: FitSettings | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts and scores of a saved fold on the rows that another cohort has of the
    fold's test stays."""
    rows = decoupled_rows(other_cohort, splits, fold)
    predictions = materialise(score_cohort(rows, models, fold, task, variables, settings), "predictions")
    return predictions, score_table(predictions, staging)


def decoupled_rows(other_cohort: DataFrame, splits: DataFrame, fold: int) -> DataFrame:
    """Rows of another cohort for the saved test stays of a fold, written; none is an error."""
    test = splits.filter((F.col("fold") == fold) & (F.col("split") == "test"))
    return restricted_rows(other_cohort, test)
