"""Reproducible splits of stays. Stays are shuffled by the md5 of id and seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.operators.layout import digest_row_index, global_row_index, join_back
from irregts.session import materialise


def shuffle_key(seed: int | str, stay: str = "ind") -> Column:
    return F.md5(F.concat(F.col(stay).cast("string"), F.lit(f":{seed}")))


def _shuffled(stays: DataFrame, seed: int, *extra: str) -> tuple[DataFrame, int]:
    """Distinct stays with their 0-based place in the shuffled order."""
    keyed = stays.select("ind", *extra).distinct().withColumn("_md5", shuffle_key(seed))
    placed, n = digest_row_index(keyed, "_md5", "_place", first=extra)
    return placed.drop("_md5"), n


def k_folds(stays: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Test fold of every stay; sizes differ by one at most, larger folds first."""
    placed, n = _shuffled(stays, seed)
    if not 2 <= k <= n:
        raise ValueError(f"cannot cut {n} stays into {k} folds")
    size, larger = divmod(n, k)
    edge = larger * (size + 1)
    place = F.col("_place")
    fold = F.when(place < edge, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - edge) / size))
    return placed.select("ind", fold.cast("int").alias("fold"))


def fold_splits(folds: DataFrame, k: int) -> DataFrame:
    """One row per stay and fold, telling whether the stay trains or tests there."""
    each = folds.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    side = F.when(F.col("_fold") == F.col("fold"), "test").otherwise("train")
    return each.select("ind", F.col("_fold").alias("fold"), side.alias("split"))


def holdout(stays: DataFrame, seed: int = 1, test_share: float = 0.2) -> DataFrame:
    """One train/test split; the test side has ``ceil(share * n)`` stays."""
    placed, n = _shuffled(stays, seed)
    n_test = math.ceil(round(test_share * n, 9))
    if not 0 < n_test < n:
        raise ValueError(f"a test share of {test_share} leaves one side of {n} stays empty")
    side = F.when(F.col("_place") < n_test, "test").otherwise("train")
    return placed.select("ind", F.lit(0).alias("fold"), side.alias("split"))


def stratified_holdout(stays: DataFrame, labels: DataFrame, seed: int = 1, test_share: float = 0.2) -> DataFrame:
    """A hold-out split that keeps the share of every label.

    Every stay needs a label. Ranks within a label are places in one global
    (label, md5) order minus the label's start, so a frequent label stays spread.
    """
    problem = F.concat(F.lit("stay without label: "), F.col("ind").cast("string"))
    labelled = (
        stays.select("ind")
        .distinct()
        .join(labels.select("ind", "label"), "ind", "left")
        .withColumn("label", F.when(F.col("label").isNull(), F.raise_error(problem).cast("int")).otherwise(F.col("label")))
    )
    placed, n = _shuffled(labelled, seed, "label")
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    n_test = math.ceil(round(test_share * n, 9))
    # Proportional test stays per label; leftovers go to the largest remainders.
    share = F.lit(n_test) * F.col("_n")
    sizes = sizes.withColumn("_rest", -(share % n)).withColumn("_quota", F.floor(share / n))
    sizes = materialise(sizes, "labels")
    facts = sizes.agg(F.min("_n").alias("least"), F.count(F.lit(1)).alias("n"), F.sum("_quota").alias("given")).first()
    if facts["least"] < 2:
        raise ValueError("the least frequent label has a single stay; it cannot be split")
    if n_test < facts["n"] or n - n_test < facts["n"]:
        raise ValueError("each side of the split needs at least one stay per label")
    ranked, _ = global_row_index(sizes, ["_rest", "label"], "_rank")
    more = (F.col("_rank") < n_test - facts["given"]).cast("long")
    edges = ranked.select("label", (F.col("_start") + F.col("_quota") + more).alias("_edge"))
    side = F.when(F.col("_place") < F.col("_edge"), "test").otherwise("train")
    return join_back(placed, edges, "label").select("ind", F.lit(0).alias("fold"), "label", side.alias("split"))


def split_stays(splits: DataFrame, fold: int, split: str) -> DataFrame:
    return splits.filter((F.col("fold") == fold) & (F.col("split") == split)).select("ind")
