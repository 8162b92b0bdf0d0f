"""Scores over a predictions table ``(ind, set, fold, y_true, y_pred)``.

Every score is a map-side aggregate per group. The median of errors is an exact order
statistic over range partitions, since one fold may hold most of the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.functions.expr import Staging, even_quantiles, huber, pinball, stage
from irregts.operators.layout import order_statistics
from irregts.operators.regression import HUBER_DELTA, THREE_QUANTILES

GROUP = ("set", "fold")

# Names of the scores in the result tables.
REGRESSION_SCORES = ("mae", "medae", "r2", "d2")
CLASS_SCORES = ("acc", "f1")

def _nan() -> Column:
    return F.lit(float("nan"))


def mae() -> Column:
    return F.avg(F.abs(F.col("y_true") - F.col("y_pred")))


def r2() -> Column:
    """1 - SSres/SStot; a constant truth scores 1 when met exactly, else 0; one row has none."""
    n = F.count("y_true")
    residual = F.sum((F.col("y_true") - F.col("y_pred")) * (F.col("y_true") - F.col("y_pred")))
    total = F.var_pop("y_true") * n
    return (
        F.when(n < 2, _nan())
        .when(total > 0, 1 - F.try_divide(residual, total))
        .when(residual == 0, 1.0)
        .otherwise(0.0)
    )


def d2_gamma() -> Column:
    """Share of gamma deviance explained; 0 where a truth or forecast is not positive.

    The deviance from the mean reduces to logarithms of the truth alone, so one pass
    is enough.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    usable = (y > 0) & (p > 0)
    deviance = F.avg(F.when(usable, F.ln(p) - F.ln(y) + y / F.when(usable, p) - 1))
    from_mean = F.ln(F.when(F.avg(y) > 0, F.avg(y))) - F.avg(F.when(y > 0, F.ln(F.when(y > 0, y))))
    return (
        F.when((F.min(y) <= 0) | (F.min(p) <= 0), 0.0)
        .when(F.count(y) < 2, _nan())
        .otherwise(F.coalesce(1 - F.try_divide(deviance, from_mean), _nan()))
    )


def regression_scores(predictions: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    return predictions.groupBy(*by).agg(mae().alias("mae"), r2().alias("r2"), d2_gamma().alias("d2"))


def median_error(predictions: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Median absolute error: the mean of the middle two."""
    errors = predictions.select(*by, F.abs(F.col("y_true") - F.col("y_pred")).alias("_error"))
    middle = order_statistics(
        errors,
        by,
        "_error",
        {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)},
    )
    return middle.select(*by, ((F.col("_low") + F.col("_high")) / 2).alias("medae"))


def with_classes(predictions: DataFrame, staging: Staging) -> DataFrame:
    return predictions.withColumn("target_class", stage(F.col("y_true"), staging)).withColumn(
        "prediction_class", stage(F.col("y_pred"), staging)
    )


def confusion_counts(predictions: DataFrame, staging: Staging, by: Sequence[str] = GROUP) -> DataFrame:
    """Number of rows per pair of classes that occurs."""
    return (
        with_classes(predictions, staging)
        .groupBy(*by, "target_class", "prediction_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_scores(predictions: DataFrame, staging: Staging, by: Sequence[str] = GROUP) -> DataFrame:
    """Accuracy, and F1 per class weighted by true counts; an undefined F1 is 0."""
    pairs = confusion_counts(predictions, staging, by)
    # A pair counts as true row of its target class and as forecast of its other class.
    hit = F.col("target_class") == F.col("prediction_class")
    sides = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("target_class").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(hit, F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col("prediction_class").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    classes = sides.groupBy(*by, "c").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("said")), F.lit(0.0))
    return classes.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"),
    )


def confusion_matrix(predictions: DataFrame, staging: Staging, by: Sequence[str] = GROUP) -> DataFrame:
    """Share of all rows per pair of classes.

    With declared bounds, pairs of occurring classes that never met are 0. A callable
    staging may make any number of classes, so only pairs that met are given.
    """
    counts = confusion_counts(predictions, staging, by)
    if callable(staging):
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        share = (F.col("n") / F.col("_total")).alias("share")
        return counts.join(totals, list(by)).select(*by, "target_class", "prediction_class", share)
    # At most (number of stages) ** 2 rows per group from here on.
    classes = F.array_sort(F.array_union(F.collect_set("target_class"), F.collect_set("prediction_class")))
    dense = (
        counts.groupBy(*by)
        .agg(classes.alias("_classes"), F.sum("n").alias("_total"))
        .withColumn("target_class", F.explode("_classes"))
        .withColumn("prediction_class", F.explode("_classes"))
        .drop("_classes")
    )
    share = F.coalesce("n", F.lit(0)) / F.col("_total")
    return dense.join(counts, [*by, "target_class", "prediction_class"], "left").select(
        *by, "target_class", "prediction_class", share.alias("share")
    )


def score_table(
    predictions: DataFrame, staging: Staging | None = None, by: Sequence[str] = GROUP
) -> DataFrame:
    """All scores per group in long form ``(…, metric, value)``."""
    by = list(by)
    wide = regression_scores(predictions, by).join(median_error(predictions, by), by)
    names = REGRESSION_SCORES
    if staging is not None:
        wide = wide.join(class_scores(predictions, staging, by), by)
        names = names + CLASS_SCORES
    return wide.select(*by, *names).unpivot(by, list(names), "metric", "value")


def metrics_by_fold(scores: DataFrame, folds: Sequence[int]) -> DataFrame:
    """One row per set and score: a column per fold, the mean and the deviation over the
    folds, and the deviation over folds and mean together."""
    summary = scores.groupBy("set", "metric").agg(
        *(F.max(F.when(F.col("fold") == f, F.col("value"))).alias(f"fold_{f}") for f in folds),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("_k"),
    )
    # Adding the mean itself as one more member keeps the sum of squares.
    widened = F.col("std") * F.sqrt(F.col("_k") / (F.col("_k") + 1))
    return summary.withColumn("std_with_mean", widened).drop("_k")


def point_from_quantiles(predictions: DataFrame, quantiles: str = "q_pred") -> DataFrame:
    """Point forecast: the second output where there are several, else the only one."""
    q = F.col(quantiles)
    return predictions.withColumn(
        "y_pred", F.when(F.size(q) > 1, F.try_element_at(q, F.lit(2))).otherwise(F.element_at(q, 1))
    )


def prediction_sheet(predictions: DataFrame, staging: Staging) -> DataFrame:
    """Per stay: target, prediction and their classes."""
    return with_classes(predictions, staging).select(
        "set",
        "fold",
        F.col("ind").alias("stay_id"),
        F.col("y_true").alias("target"),
        F.col("y_pred").alias("prediction"),
        "target_class",
        "prediction_class",
    )


def huber_loss(predictions: DataFrame, delta: float = HUBER_DELTA, by: Sequence[str] = GROUP) -> DataFrame:
    error = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy(*by).agg(F.avg(huber(error, delta)).alias("huber"))


def quantile_levels(n: int = 3, manual: Sequence[float] | None = None) -> list[float]:
    """Given levels, the usual three, or n evenly spaced ones."""
    if manual is not None:
        return list(manual)
    return list(THREE_QUANTILES) if n == len(THREE_QUANTILES) else even_quantiles(n)


def pinball_loss(
    predictions: DataFrame, levels: Sequence[float], by: Sequence[str] = GROUP, quantiles: str = "q_pred"
) -> DataFrame:
    """Mean and sum of the pinball loss per group and level. ``q_pred`` holds one
    forecast per level."""
    losses = [
        pinball(F.col("y_true"), F.element_at(F.col(quantiles), i), F.lit(float(q)))
        for i, q in enumerate(levels, start=1)
    ]
    wide = predictions.groupBy(*by).agg(
        *(F.avg(loss).alias(f"_mean{i}") for i, loss in enumerate(losses)),
        *(F.sum(loss).alias(f"_sum{i}") for i, loss in enumerate(losses)),
    )
    rows = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(float(q)).alias("q"), F.col(f"_mean{i}").alias("mean_loss"), F.col(f"_sum{i}").alias("sum_loss")
                )
                for i, q in enumerate(levels)
            )
        )
    )
    return wide.select(*by, rows.alias("_row")).select(*by, "_row.*")
