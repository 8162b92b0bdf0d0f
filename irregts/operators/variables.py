"""Selecting, cleaning and numbering variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.operators.layout import global_row_index, order_statistics, small_side, small_table
from irregts.session import materialise


def select_variables(df: DataFrame, catalogue: DataFrame, on: str = "itemid") -> DataFrame:
    """Rows of the variables listed in the catalogue, in one pass over the table."""
    return df.join(small_side(catalogue.select(on).distinct()), on, "left_semi")


def remove_outside_range(df: DataFrame, low: float | Column, high: float | Column, value: str = "value") -> DataFrame:
    """Keep values between low and high, both included."""
    return df.filter(F.col(value).between(low, high))


def keep_origins(df: DataFrame, origins: Sequence[str], column: str = "admission_location") -> DataFrame:
    return df.filter(F.col(column).isin(*origins))


def variable_quantiles(
    df: DataFrame, quantiles: Mapping[str, float], by: str = "itemid", value: str = "value"
) -> DataFrame:
    """Exact nearest-rank quantiles per variable: the value at ``floor((n-1)q + 0.5)``."""
    ranks = {
        name: (lambda n, q=q: F.floor((n - 1) * F.lit(float(q)) + 0.5)) for name, q in quantiles.items()
    }
    return order_statistics(df, [by], value, ranks)


def outlier_bounds(
    df: DataFrame, by: str = "itemid", value: str = "value", spread: float = 3.0,
    low_q: float = 0.25, high_q: float = 0.75,
) -> DataFrame:
    """Per variable: quartiles and the range that reaches ``spread`` IQRs beyond them."""
    iqr = F.col("q3") - F.col("q1")
    return variable_quantiles(df, {"q1": low_q, "q3": high_q}, by, value).select(
        by, "q1", "q3", (F.col("q1") - spread * iqr).alias("low"), (F.col("q3") + spread * iqr).alias("high")
    )


def within_bounds(df: DataFrame, bounds: DataFrame, by: str = "itemid", value: str = "value") -> DataFrame:
    """Rows inside their variable's bounds; variables without bounds vanish."""
    joined = df.join(small_side(bounds.select(by, "low", "high")), by)
    return remove_outside_range(joined, F.col("low"), F.col("high"), value).select(*df.columns)


def remove_outliers(
    df: DataFrame, by: str = "itemid", value: str = "value", spread: float = 3.0,
    low_q: float = 0.25, high_q: float = 0.75,
) -> DataFrame:
    """Drop values outside their variable's :func:`outlier_bounds`."""
    return within_bounds(df, outlier_bounds(df, by, value, spread, low_q, high_q), by, value)


def top_variables(df: DataFrame, k: int, min_count: int = 50_000, by: str = "itemid") -> DataFrame:
    """The k most measured variables with at least ``min_count`` measures each."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count).orderBy(F.desc("n"), by).limit(k)


def variable_key(df: DataFrame, catalogue: DataFrame, on: str = "itemid") -> DataFrame:
    """Dense 0-based ids in catalogue order for the variables that have rows.

    ``catalogue`` holds ``label``, ``position`` and the ``on`` column. The key is computed
    at once, so that using it does not read the rows again.
    """
    present = df.select(on).distinct()
    listed = catalogue.join(present, on, "left_semi")
    extra = [] if on == "label" else [on]
    entries = listed.select("position", "label", *extra)
    key, _ = global_row_index(entries, ["position", "label"], "key")
    return small_table(key.select("label", *extra, "key"))


def first_seen_key(df: DataFrame, on: str, order: Sequence[str]) -> DataFrame:
    """Dense 0-based ids ``(on, key)`` of a column's values in the order in which they first appear,
    rows being ordered by the columns ``order``; values that first appear in equal rows follow their
    own order, null is a value. Needs no catalogue: one map-side aggregate finds the first rows.
    """
    first = df.groupBy(on).agg(F.min(F.struct(*order)).alias("_first"))
    return global_row_index(first, ["_first", on], "key")[0].select(on, "key")


def index_by_first_appearance(df: DataFrame, on: str, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows with the number of each value of on as name, the key)``, as :func:`first_seen_key`."""
    key = materialise(first_seen_key(df, on, order), "key")
    return index_variables(df, key, on, name), key


def index_variables(df: DataFrame, key: DataFrame, on: str = "itemid", name: str = "itemid") -> DataFrame:
    """Replace each variable by its key; a variable without key is an error."""
    lookup = small_side(key.select(F.col(on).alias("_on"), F.col("key").alias("_key")))
    joined = df.join(lookup, df[on].eqNullSafe(F.col("_on")), "left")
    problem = F.concat(F.lit("variable without key: "), F.col(on).cast("string"))
    strict = F.when(F.col("_key").isNull(), F.raise_error(problem).cast("long")).otherwise(F.col("_key"))
    return joined.withColumn("_key", strict).drop("_on", *([name] if name in df.columns else [])).withColumnRenamed(
        "_key", name
    )


def resolve_labels(key: DataFrame, labels: Sequence[str]) -> dict[str, int]:
    """Ids of the given labels. Each must match exactly one row; case matters."""
    wanted = sorted(set(labels))
    matches = key.filter(F.col("label").isin(*wanted)).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("key")
    )
    found = {row["label"]: row for row in matches.collect()}  # a row per wanted label at most
    for label in wanted:
        n = found[label]["n"] if label in found else 0
        if n != 1:
            raise ValueError(f"label {label!r} has {n} matches in the key; labels are case-sensitive")
    return {label: found[label]["key"] for label in wanted}
