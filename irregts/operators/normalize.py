"""Normalisation statistics and their application.

Statistics are one small table: a row per group and variable with the variable's
value statistics and the group's age and time statistics. Age and time are measured
over rows, so long stays weigh more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.functions.expr import (
    min_max_scale,
    min_max_unscale,
    standardise,
    unstandardise,
)
from irregts.operators.layout import small_side
from irregts.session import materialise

MODES = ("standard", "minmax")
_MEASURED = ("value", "time", "age")


def _check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: choose " + " or ".join(MODES))


def item_moments(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, variance, minimum and maximum of value, time and age per group and
    variable. NaN counts as missing. One pass, aggregated map-side."""
    aggregates = []
    for c in _MEASURED:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggregates += [
            F.count(x).alias(f"{c}_n"),
            F.avg(x).alias(f"{c}_mean"),
            F.var_pop(x).alias(f"{c}_var"),
            F.min(x).alias(f"{c}_min"),
            F.max(x).alias(f"{c}_max"),
        ]
    return df.groupBy(*by, "itemid").agg(*aggregates)


def merge_moments(moments: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The moments of whole groups of rows of a written table of moments, a row per group."""

    def beside_group(table: DataFrame) -> DataFrame:
        return moments.join(table, list(by)) if by else moments.crossJoin(F.broadcast(table))  # one row

    def grouped(df: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
        return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)

    whole = []
    for c in columns:
        n, mean = F.col(f"{c}_n"), F.col(f"{c}_mean")
        whole += [
            F.sum(n).alias(f"_{c}_n"),
            F.try_divide(F.sum(n * mean), F.sum(n)).alias(f"_{c}_mean"),
            F.min(f"{c}_min").alias(f"_{c}_min"),
            F.max(f"{c}_max").alias(f"_{c}_max"),
        ]
    means = grouped(moments, whole)
    spread = []
    for c in columns:
        off = F.col(f"_{c}_mean") - F.col(f"{c}_mean")
        own = F.col(f"{c}_n") * (F.col(f"{c}_var") + off * off)
        spread.append(F.try_divide(F.sum(own), F.sum(f"{c}_n")).alias(f"{c}_var"))
        spread += [F.first(f"_{c}_{s}").alias(f"{c}_{s}") for s in ("n", "mean", "min", "max")]
    return grouped(beside_group(means), spread)


def _finish(items: DataFrame, by: Sequence[str], mode: str) -> DataFrame:
    """Per variable: its value statistics and the age and time statistics of the group."""
    whole = merge_moments(items, by, ("time", "age"))
    own = items.drop(*(c for c in whole.columns if c not in by))
    joined = own.join(whole, list(by)) if by else own.crossJoin(F.broadcast(whole))  # one row
    if mode == "standard":
        stats = [F.col(f"{c}_mean") for c in _MEASURED]
        stats += [F.sqrt(f"{c}_var").alias(f"{c}_std") for c in _MEASURED]
    else:
        stats = [F.col(f"{c}_{s}") for c in _MEASURED for s in ("min", "max")]
    return joined.select(*by, "itemid", *stats)


def fit_stats(df: DataFrame, by: Sequence[str] = (), mode: str = "standard") -> DataFrame:
    """Statistics of each group of rows (for example each split)."""
    _check_mode(mode)
    return _finish(materialise(item_moments(df, by), "moments"), by, mode)


def fit_fold_stats(df: DataFrame, folds: DataFrame, k: int, mode: str = "standard") -> DataFrame:
    """Statistics of the train and test side of each of k folds from one pass.

    Every row is read once under its test fold; the train side of a fold merges the
    moments of the other folds instead of reading the rows k times.
    """
    _check_mode(mode)
    moments = materialise(item_moments(df.join(folds, "ind"), ["fold"]), "moments")
    spread = moments.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    spread = spread.withColumn("split", F.when(F.col("_of") == F.col("fold"), "test").otherwise("train"))
    spread = spread.drop("fold").withColumnRenamed("_of", "fold")
    side = ["fold", "split"]
    items = merge_moments(spread, [*side, "itemid"], _MEASURED)
    return _finish(materialise(items, "items"), side, mode)


def _mapped(c: str, mode: str, inverse: bool = False, column: str | None = None) -> Column:
    x = F.col(column or c).cast("double")
    if mode == "standard":
        f = unstandardise if inverse else standardise
        return f(x, F.col(f"{c}_mean"), F.col(f"{c}_std"))
    f = min_max_unscale if inverse else min_max_scale
    return f(x, F.col(f"{c}_min"), F.col(f"{c}_max"))


def apply_stats(
    df: DataFrame,
    stats: DataFrame,
    by: Sequence[str] = (),
    mode: str = "standard",
    values: bool = True,
    times: bool = True,
) -> DataFrame:
    """Normalise values (with age) and times. A variable without statistics is an error."""
    _check_mode(mode)
    joined = df.join(small_side(stats.withColumn("_known", F.lit(True))), [*by, "itemid"], "left")
    problem = F.concat(F.lit("variable without statistics: "), F.col("itemid").cast("string"))
    joined = joined.withColumn(
        "value", F.when(F.col("_known").isNull(), F.raise_error(problem).cast("double")).otherwise(F.col("value"))
    )
    if values:
        joined = joined.withColumn("value", _mapped("value", mode)).withColumn("age", _mapped("age", mode))
    if times:
        joined = joined.withColumn("time", _mapped("time", mode))
    return joined.select(*df.columns)


def normalize(
    df: DataFrame, by: Sequence[str] = (), mode: str = "standard", values: bool = True, times: bool = True
) -> DataFrame:
    """Normalise every group with its own statistics."""
    return apply_stats(df, fit_stats(df, by, mode), by, mode, values, times)


def denormalize_predictions(
    predictions: DataFrame, stats: DataFrame, target: int, by: Sequence[str] = (), mode: str = "standard"
) -> DataFrame:
    """Bring y_true and y_pred back to the target variable's unit."""
    _check_mode(mode)
    own = stats.filter(F.col("itemid") == target)
    names = [c for c in stats.columns if c.startswith("value_")]
    if by:
        joined = predictions.join(small_side(own.select(*by, *names)), list(by))
    else:
        rows = own.select(*names).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"expected one row of statistics for variable {target}, found {len(rows)}")
        joined = predictions.withColumns({c: F.lit(rows[0][c]) for c in names})
    for y in ("y_true", "y_pred"):
        joined = joined.withColumn(y, _mapped("value", mode, inverse=True, column=y))
    return joined.select(*predictions.columns)
