"""Choosing the stays that can be used to forecast a target variable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.functions.expr import Staging, stage
from irregts.operators.layout import join_back
from irregts.operators.variables import resolve_labels


@dataclass(frozen=True)
class CohortRules:
    """Ids are variable keys, horizons and histories are hours."""

    target: int
    skippable: tuple[int, ...] = ()
    include: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    entry_stages: tuple[int, ...] | None = None
    exit_stages: tuple[int, ...] | None = None
    entry_above_exit: bool | None = None
    staging: Staging | None = field(default=None)
    pred_horizon: float = 0
    pred_history: float = 0
    max_hours: float | None = None

    def __post_init__(self) -> None:
        staged = (self.entry_stages, self.exit_stages, self.entry_above_exit)
        if any(rule is not None for rule in staged) and self.staging is None:
            raise ValueError("rules on stages need a staging")


def rules_by_label(
    key: DataFrame,
    target: str,
    skippable: Sequence[str] = (),
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    **limits,
) -> CohortRules:
    """Rules whose variables are given by label, resolved against the variable key."""
    ids = resolve_labels(key, [target, *skippable, *include, *exclude])

    def of(labels: Sequence[str]) -> tuple[int, ...]:
        return tuple(ids[label] for label in labels)

    return CohortRules(ids[target], of(skippable), of(include), of(exclude), **limits)


def _is_in(column: str, ids: tuple[int, ...]) -> Column:
    return F.col(column).isin(*ids) if ids else F.lit(False)


def cap_hours(df: DataFrame, max_hours: float | None) -> DataFrame:
    return df if max_hours is None else df.filter(F.col("time") <= max_hours * 60)


def stay_profile(df: DataFrame, rules: CohortRules) -> DataFrame:
    """One row per stay with everything the rules look at, from one aggregation.

    The first and last target observations are the least and greatest
    ``(time, value)``, which aggregate map-side; no stay is ever sorted or collected.
    """
    on_target = F.col("itemid") == rules.target
    observed = F.when(on_target, F.struct("time", "value"))
    profile = cap_hours(df, rules.max_hours).groupBy("ind").agg(
        F.count_if(on_target).alias("n_tgt"),
        F.min("time").alias("t_first"),
        F.max(F.when(on_target, F.col("time"))).alias("t_last"),
        F.min(observed)["value"].alias("entry_value"),
        F.max(observed)["value"].alias("exit_value"),
        F.count_if(~_is_in("itemid", rules.skippable)).alias("n_non_skipped"),
        (F.bool_or(_is_in("itemid", rules.include)) if rules.include else F.lit(True)).alias("ok_included"),
        (~F.bool_or(_is_in("itemid", rules.exclude)) if rules.exclude else F.lit(True)).alias("ok_excluded"),
    )
    if rules.staging is None:
        none = F.lit(None).cast("int")
        return profile.withColumn("entry_stage", none).withColumn("exit_stage", none)
    return profile.withColumn("entry_stage", stage(F.col("entry_value"), rules.staging)).withColumn(
        "exit_stage", stage(F.col("exit_value"), rules.staging)
    )


def keep_rule(rules: CohortRules) -> Column:
    """True for the profiles of usable stays: all nine rules hold."""
    entry, exit_ = F.col("entry_stage"), F.col("exit_stage")
    tests = [
        F.col("n_tgt") > 0,
        F.col("n_non_skipped") > 0,
        F.col("t_first") < F.col("t_last") - rules.pred_horizon * 60,
        F.col("t_last") > rules.pred_history * 60,
        F.col("ok_included"),
        F.col("ok_excluded"),
    ]
    if rules.entry_stages is not None:
        tests.append(entry.isin(*rules.entry_stages))
    if rules.exit_stages is not None:
        tests.append(exit_.isin(*rules.exit_stages))
    if rules.entry_above_exit is not None:
        tests.append(entry > exit_ if rules.entry_above_exit else entry < exit_)
    kept = F.lit(True)
    for test in tests:
        kept = kept & F.coalesce(test, F.lit(False))
    return kept


def cull_decisions(df: DataFrame, rules: CohortRules) -> DataFrame:
    return stay_profile(df, rules).withColumn("kept", keep_rule(rules))


def kept_stays(df: DataFrame, rules: CohortRules) -> DataFrame:
    return stay_profile(df, rules).filter(keep_rule(rules))


def rows_of_kept(df: DataFrame, kept: DataFrame, rules: CohortRules) -> DataFrame:
    """Rows of the kept stays up to and including the last target observation."""
    rows = join_back(cap_hours(df, rules.max_hours), kept.select("ind", "t_last"), "ind")
    return rows.filter(F.col("time") <= F.col("t_last")).select(*df.columns)


def cull_cohort(df: DataFrame, rules: CohortRules) -> DataFrame:
    """The cohort: rows of the usable stays up to the last target observation."""
    return rows_of_kept(df, kept_stays(df, rules), rules)


def labels_of_kept(kept: DataFrame) -> DataFrame:
    return kept.select("ind", F.col("exit_stage").alias("label"))


def stay_labels(df: DataFrame, rules: CohortRules) -> DataFrame:
    """Exit stage of each usable stay."""
    if rules.staging is None:
        raise ValueError("stay labels need a staging")
    return labels_of_kept(kept_stays(df, rules))
