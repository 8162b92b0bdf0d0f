"""Input rows of a forecast: what may be seen before the target observation.

All limits are in raw minutes and hours; normalise afterwards. Per-stay facts come
from map-side aggregates joined back on the stay, so that a stay of any size can be
split; no window ever spans a whole stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.operators.layout import join_back
from irregts.schemas import STAY_ORDER

# Into how many pieces a group is cut before its latest rows are ranked together.
PIECES = 32


def target_observations(df: DataFrame, target: int) -> DataFrame:
    """Last observation of the target variable per stay; stays without one have no row."""
    last = F.max(F.struct("time", "value"))
    return (
        df.filter(F.col("itemid") == target)
        .groupBy("ind")
        .agg(last.alias("_last"))
        .select("ind", F.col("_last.time").alias("tgt_time"), F.col("_last.value").alias("tgt_value"))
    )


def input_rows(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows strictly before the target observation, with ``tgt_time`` attached."""
    rows = join_back(df, targets.select("ind", "tgt_time"), "ind")
    return rows.filter(F.col("time") < F.col("tgt_time"))


def mask_variables(df: DataFrame, masked: Sequence[int]) -> DataFrame:
    return df.filter(~F.col("itemid").isin(*masked)) if masked else df


def window_lookback(rows: DataFrame, minutes: float) -> DataFrame:
    """Keep the last ``minutes`` before the target. Where that leaves nothing, the
    window widens by further multiples until it reaches the stay's newest input."""
    if minutes <= 0:
        raise ValueError("the look-back must be positive")
    newest = rows.groupBy("ind").agg(F.max("time").alias("_newest"))
    steps = F.greatest(F.lit(1), F.ceil((F.col("tgt_time") - F.col("_newest")) / minutes))
    joined = join_back(rows, newest, "ind")
    return joined.filter(F.col("time") >= F.col("tgt_time") - steps * minutes).select(*rows.columns)


def window_horizon(rows: DataFrame, hours: float) -> DataFrame:
    """Keep rows at least ``hours`` before the target."""
    return rows.filter(F.col("time") <= F.col("tgt_time") - hours * 60)


def window_history(rows: DataFrame, hours: Sequence[float]) -> DataFrame:
    """Keep the longest listed history from the start that ends before the target.
    A stay whose target comes before the shortest history is an error."""
    if not hours:
        raise ValueError("at least one history length is needed")
    fitting = F.filter(F.array(*(F.lit(float(h) * 60) for h in hours)), lambda h: h < F.col("tgt_time"))
    problem = F.concat(
        F.lit(f"the shortest history ({min(hours)} h) oversteps the target time of stay "),
        F.col("ind").cast("string"),
    )
    end = F.when(F.size(fitting) == 0, F.raise_error(problem).cast("double")).otherwise(F.array_max(fitting))
    return rows.filter(F.col("time") <= end)


def last_n(
    df: DataFrame,
    n: int,
    by: Sequence[str] = ("ind",),
    order: Sequence[str] = STAY_ORDER,
    pieces: int = PIECES,
) -> DataFrame:
    """The n latest rows per group.

    Every group is trimmed in ``pieces`` first, which leaves ``pieces * n`` rows of it,
    and then as a whole. No group size is counted.
    """
    if n < 1:
        raise ValueError("n must be positive")
    latest = [F.desc(c) for c in order]

    def trim(rows: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(*latest))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    # Equal rows land in different pieces when they come from different tasks.
    piece = F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(pieces))
    cut = trim(df.withColumn("_piece", piece), [*by, "_piece"])
    return trim(cut.select(*df.columns), list(by))


def forecast_inputs(
    df: DataFrame,
    target: int,
    masked: Sequence[int] = (),
    back_minutes: float | None = None,
    horizon_hours: float | None = None,
    history_hours: Sequence[float] | None = None,
    max_measures: int | None = None,
    targets: DataFrame | None = None,
) -> DataFrame:
    """All limits in their fixed order. The look-back only counts when neither a
    horizon nor a number of measures is given. ``targets`` saves finding the target
    observations again."""
    targets = target_observations(df, target) if targets is None else targets
    rows = mask_variables(input_rows(df, targets), masked)
    if back_minutes is not None and horizon_hours is None and max_measures is None:
        rows = window_lookback(rows, back_minutes)
    if horizon_hours is not None:
        rows = window_horizon(rows, horizon_hours)
    if history_hours is not None:
        rows = window_history(rows, history_hours)
    if max_measures is not None:
        rows = last_n(rows, max_measures)
    return rows.select(*df.columns)


def empty_inputs(targets: DataFrame, inputs: DataFrame) -> DataFrame:
    """Stays with a target observation but without any input row."""
    return targets.join(inputs.select("ind").distinct(), "ind", "left_anti").select("ind")
