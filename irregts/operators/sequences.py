"""Samples, batches and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.functions.expr import gender_code
from irregts.operators.layout import digest_row_index, global_row_index, join_back
from irregts.operators.stays import stay_ordinals
from irregts.operators.windows import last_n
from irregts.session import materialise

# Fillers of padded positions.
PAD_VALUE, PAD_TIME, PAD_VARIABLE = -1e4, -1e4, 0


def time_token_id(key: DataFrame) -> int:
    """Variable id of the time token: one above the largest variable key."""
    return key.agg(F.max("key")).first()[0] + 1


def demog_vector(gender: Column, age: Column) -> Column:
    return F.array(gender_code(gender), age.cast("double"))


def stay_demographics(df: DataFrame) -> DataFrame:
    """Gender and age of each stay, which repeat on all of its rows."""
    return df.groupBy("ind").agg(F.min("gender").alias("gender"), F.min("age").alias("age"))


def sample_targets(df: DataFrame, target: int) -> DataFrame:
    """Target observation of each stay, with gender and age, which repeat on all rows."""
    last = F.max(F.struct("time", "value"))
    stays = df.filter(F.col("itemid") == target).groupBy("ind").agg(
        last.alias("_last"), F.min("gender").alias("gender"), F.min("age").alias("age")
    )
    return stays.select(
        "ind", F.col("_last.time").alias("tgt_time"), F.col("_last.value").alias("tgt_value"), "gender", "age"
    )


def sequence_rows(inputs: DataFrame, targets: DataFrame, token: int) -> DataFrame:
    """Sequences in long form ``(ind, pos, value, time, variable)``, time token last.

    Has no limit on the length of a sequence; :func:`sequences` gives arrays.
    """
    numbered = stay_ordinals(inputs.select("ind", "time", "itemid", "value")).select(
        "ind", "pos", "value", F.col("time").cast("double").alias("time"), F.col("itemid").cast("long").alias("variable")
    )
    # The numbered rows are written already; the inputs are not read again.
    lengths = numbered.groupBy("ind").agg((F.max("pos") + 1).alias("_n"))
    tokens = targets.join(lengths, "ind", "left").select(
        "ind",
        F.coalesce("_n", F.lit(0)).cast("long").alias("pos"),
        F.lit(0.0).alias("value"),
        F.col("tgt_time").cast("double").alias("time"),
        F.lit(token).cast("long").alias("variable"),
    )
    return numbered.unionByName(tokens)


def sequences(
    inputs: DataFrame, targets: DataFrame, token: int, max_measures: int | None = None
) -> DataFrame:
    """One row per stay with ordered arrays, the time token last.

    An array holds a whole stay unless ``max_measures`` limits it to the latest rows, so
    without that limit stays have to fit in a row; :func:`sequence_rows` has no such
    bound. Stays without inputs keep the token alone.
    """
    kept = inputs.select("ind", "time", "itemid", "value")
    if max_measures is not None:
        kept = last_n(kept, max_measures)
    items = kept.groupBy("ind").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("time").cast("double").alias("time"), F.col("itemid").cast("long").alias("itemid"), "value")
            )
        ).alias("_items")
    )

    def with_token(part: str, last: Column) -> Column:
        own = F.transform(F.col("_items"), lambda item: item[part])
        return F.when(F.col("_items").isNull(), F.array(last)).otherwise(F.concat(own, F.array(last)))

    return targets.join(items, "ind", "left").select(
        "ind",
        demog_vector(F.col("gender"), F.col("age")).alias("demog"),
        with_token("value", F.lit(0.0)).alias("values"),
        with_token("time", F.col("tgt_time").cast("double")).alias("times"),
        with_token("itemid", F.lit(token).cast("long")).alias("variables"),
        "tgt_value",
        F.col("tgt_time").cast("double").alias("tgt_time"),
    )


def batch_assignment(
    stays: DataFrame, size: int, drop_last: bool = False, seed: int | None = None, epoch: int = 0
) -> DataFrame:
    """Batch of every stay, in id order or, with a seed, shuffled anew per epoch."""
    if size < 1:
        raise ValueError("the batch size must be positive")
    keyed = stays.select("ind").distinct()
    if seed is None:
        placed, n = global_row_index(keyed, ["ind"], "_place")
    else:
        keyed = keyed.withColumn("_md5", F.md5(F.concat(F.col("ind").cast("string"), F.lit(f":{seed}:{epoch}"))))
        placed, n = digest_row_index(keyed, "_md5", "_place")
    out = placed.select(
        "ind",
        F.floor(F.col("_place") / size).cast("long").alias("batch_id"),
        (F.col("_place") % size).cast("long").alias("row_in_batch"),
    )
    return out.filter(F.col("batch_id") < n // size) if drop_last else out


def long_batches(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Padded batches in long form, one row per position: ``(ind, batch_id, row_in_batch,
    pos, value, time, variable, mask)``.

    ``rows`` are those of :func:`sequence_rows`. Padding is generated per stay from two
    lengths; no array is built, so sequences and batches of any length are rows.
    """
    own = rows.groupBy("ind").agg((F.max("pos") + 1).alias("_len"))
    placed = materialise(own.join(batches, "ind"), "places")
    widths = placed.groupBy("batch_id").agg(F.max("_len").alias("_width"))
    order = ["ind", "batch_id", "row_in_batch", "pos", "value", "time", "variable", "mask"]
    real = join_back(rows, placed, "ind").withColumn("mask", F.lit(1))
    gaps = placed.join(widths, "batch_id").filter(F.col("_len") < F.col("_width"))
    fill = gaps.withColumn("pos", F.explode(F.sequence("_len", F.col("_width") - 1))).withColumns(
        {
            "value": F.lit(PAD_VALUE),
            "time": F.lit(PAD_TIME),
            "variable": F.lit(PAD_VARIABLE).cast("long"),
            "mask": F.lit(0),
        }
    )
    return real.select(*order).unionByName(fill.select(*order))


def padded_batches(samples: DataFrame, batches: DataFrame) -> DataFrame:
    """Pad every sample to the longest of its batch; the mask is 1 on real positions.

    The window spans one batch, that is a batch size of rows.
    """
    joined = samples.join(batches, "ind")
    length = F.size("values")
    joined = joined.withColumn("_len", length).withColumn(
        "_fill", F.max(length).over(W.partitionBy("batch_id")) - length
    )

    def pad(column: str, filler: Column) -> Column:
        return F.concat(F.col(column), F.array_repeat(filler, F.col("_fill"))).alias(column)

    mask = F.concat(F.array_repeat(F.lit(1), F.col("_len")), F.array_repeat(F.lit(0), F.col("_fill")))
    return joined.select(
        "ind",
        "batch_id",
        "row_in_batch",
        "demog",
        pad("values", F.lit(PAD_VALUE)),
        pad("times", F.lit(PAD_TIME)),
        pad("variables", F.lit(PAD_VARIABLE).cast("long")),
        mask.alias("mask"),
        "tgt_value",
        "tgt_time",
    )
