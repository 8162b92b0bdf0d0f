"""Global positions and exact order statistics without a single-task window.

Rows are range-partitioned on the wanted order and written once to the shared folder, so that partition number and position are stable under executor loss.
Whatever is global then follows from one small total per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irregts.session import materialise, scratch_path

# Bytes of a written table that may be broadcast.
MAX_SMALL_BYTES = 2 << 20
_PART, _POS, _COPIES = "_part", "_pos", "_copies"


def _written_bytes(path: str, spark: SparkSession) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def fetch_small(df: DataFrame, max_bytes: int = MAX_SMALL_BYTES) -> tuple[DataFrame, bool]:
    """``df`` computed once and written; as a local table if that has at most ``max_bytes``.

    This is the size check in front of every broadcast of a computed table: nothing
    larger reaches the driver, and what is larger is read back, not computed again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "small")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _written_bytes(path, spark) > max_bytes:
        return table, False
    return spark.createDataFrame(table.toArrow(), schema=df.schema), True


def small_table(df: DataFrame, max_bytes: int = MAX_SMALL_BYTES) -> DataFrame:
    """``df`` to compute further on: in one local partition, without shuffles, if it is
    checked to be small, otherwise as written."""
    table, small = fetch_small(df, max_bytes)
    return table.coalesce(1) if small else table


def small_side(df: DataFrame, max_bytes: int = MAX_SMALL_BYTES) -> DataFrame:
    """``df`` ready to be joined to a large table: broadcast if it is checked to be
    small, otherwise written for a shuffle join as in :func:`join_back`."""
    table, small = fetch_small(df, max_bytes)
    return F.broadcast(table) if small else table


def join_back(rows: DataFrame, per_key: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows to a computed table that has one row per key.

    The table is written first. Its size is then known, so the planner broadcasts it
    below the session's threshold and shuffles it above; and the adaptive skew join can
    split a hot key, which it cannot do where an aggregate feeds the join directly.
    """
    return rows.join(materialise(per_key, "keys"), on, how)


def _range_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted range partitions with stable numbers (_part) and positions (_pos)."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    placed = materialise(placed, "ranges")
    # monotonically_increasing_id keeps the partition number above bit 33.
    return placed.select(
        *df.columns,
        F.shiftright("_mid", 33).alias(_PART),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias(_POS),
    )


def global_row_index(df: DataFrame, order: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """Add the 0-based position of each row in ``order``; also return the row count.

    Columns outside ``order`` break ties, and equal rows are ordered by the task they
    come from. A group of copies of any size is thus cut into ranges like other rows. The rows
    are written before ranges are chosen, so ``df`` itself is evaluated once.
    """
    ties = [c for c in df.columns if c not in order]
    traced = materialise(df.withColumn("_task", F.spark_partition_id()), "rows")
    parts = _range_parts(traced, [*order, *ties, "_task"])
    return _numbered(parts, [_PART], df.columns, name)


#: Hexadecimal digits of a digest that name its bucket.
DIGITS = 3


def digest_row_index(df: DataFrame, digest: str, name: str, first: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """As :func:`global_row_index` in the order ``first``, ``digest``, all other columns, for a
    column of evenly spread hexadecimal digests.

    The first digits are the bucket of a row, so no ranges have to be sampled: one exchange by
    bucket, a sort, and the rows are written. A bucket is a 4096th of the rows with one ``first``.
    """
    rest = [c for c in df.columns if c not in (digest, *first)]
    keys = [*first, _PART]
    placed = (
        df.withColumn(_PART, F.substring(digest, 1, DIGITS))
        .repartition(*keys)
        .sortWithinPartitions(*keys, digest, *rest)
        .withColumn(_POS, F.monotonically_increasing_id())
    )
    return _numbered(materialise(placed, "buckets"), keys, df.columns, name)


def _numbered(parts: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> tuple[DataFrame, int]:
    """Rows of written parts, named and ordered by ``keys`` and sorted by _pos inside, with their
    position in all. One row per part is summed and joined back."""
    sizes = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.min(_POS).alias("_start"))
    sizes, small = fetch_small(sizes)
    if small:
        ahead, total = [], 0
        for row in sizes.orderBy(*keys).collect():
            ahead.append((*(row[k] for k in keys), total - row["_start"]))
            total += row["_size"]
        schema = T.StructType([*(sizes.schema[k] for k in keys), T.StructField("_offset", T.LongType())])
        offsets = F.broadcast(parts.sparkSession.createDataFrame(ahead, schema))
    else:
        ahead = F.sum("_size").over(W.orderBy(*keys)) - F.col("_size")
        offsets = materialise(sizes.select(*keys, (ahead - F.col("_start")).alias("_offset")), "offsets")
        total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    numbered = parts.join(offsets, list(keys))
    return numbered.select(*columns, (F.col("_offset") + F.col(_POS)).alias(name)), total


def running_sums(df: DataFrame, order: Sequence[str], amounts: Sequence[str]) -> tuple[DataFrame, list[int]]:
    """Add ``_before_<amount>``, the sum of each amount over the rows ahead in ``order``, to a table
    with one row per key; also return the totals. Range partitions are summed, and the sums of
    those ahead are joined back, so no task sees all rows."""
    parts = _range_parts(materialise(df, "amounts"), order)
    sums = small_table(parts.groupBy(_PART).agg(*(F.sum(a).alias(a) for a in amounts)))
    over = W.orderBy(_PART)
    ahead = [(F.sum(a).over(over) - F.col(a)).alias(f"_ahead_{a}") for a in amounts]
    row = sums.agg(*(F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in amounts)).first()
    inside = W.partitionBy(_PART).orderBy(_POS)
    placed = parts.withColumns({f"_in_{a}": F.sum(a).over(inside) - F.col(a) for a in amounts})
    placed = placed.join(materialise(sums.select(_PART, *ahead), "ahead"), _PART)
    before = [(F.col(f"_ahead_{a}") + F.col(f"_in_{a}")).alias(f"_before_{a}") for a in amounts]
    return placed.select(*df.columns, *before), list(row)


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """Exact values at given 0-based ranks per group, one column per rank.

    ``ranks`` maps an output name to the rank as a function of the group size. A first pass makes
    a quantile sketch of each group, whose error is known, and brackets each rank by two values. A
    second pass counts what lies below a bracket map-side and shuffles only the distinct values
    inside it, some hundredths of the table. The counts tell whether the bracket holds the rank;
    where it does not, wider ones are tried, and in the end the whole group. NaN is the largest
    value. A group with any share of the rows is spread over many tasks.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias(_VALUE))
    rows = rows.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by), F.lit(True)))
    pending = materialise(_brackets(rows, by, ranks), "brackets")
    found = None
    for width in range(len(WIDTHS) + 1):
        picked, missed = _select_inside(rows, by, pending, width)
        found = picked if found is None else found.unionByName(picked)
        if width == len(WIDTHS) or missed.isEmpty():
            break
        pending = missed
    return found.groupBy(*by).agg(*(F.max(F.when(F.col(_NAME) == name, F.col(_VALUE))).alias(name) for name in ranks))


#: Size of a group's sketch; the share of ranks by which a value of it may be off, of which a
#: bracket is some multiples wide on either side; steps of the grid of ranks that it is asked for.
SKETCH = 1024
SKETCH_ERROR = 2.296 / SKETCH**0.9723
WIDTHS = (2.5, 25.0)
GRID = 512
_VALUE, _NAME, _K = "_value", "_name", "_k"


def _brackets(rows: DataFrame, by: Sequence[str], ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group and wanted rank: _name, _k and for each width the least and greatest value it
    may have. An open end is minus infinity or NaN, which no value is beyond."""
    number = F.col(_VALUE).cast("double")
    sketches = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.isnan(number)).alias("_numbers"),
        F.kll_sketch_agg_double(number, F.lit(SKETCH)).alias("_sketch"),
    )
    grid = F.kll_sketch_get_quantile_double("_sketch", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))))
    sketches = sketches.withColumn("_grid", F.when(F.col("_numbers") > 0, grid)).drop("_sketch")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("k")) for name, rank in ranks.items()))
    each = sketches.withColumn("_rank", F.explode(wanted)).select("*", F.col("_rank.name").alias(_NAME), F.col("_rank.k").alias(_K))
    each = each.filter((F.col(_K) >= 0) & (F.col(_K) < F.col("_n")))
    at = F.try_divide(F.col(_K) + 0.5, F.col("_numbers"))

    def ends(width: float) -> Column:
        margin = width * SKETCH_ERROR
        low = F.floor((at - margin) * GRID).cast("int")
        high = F.ceil((at + margin) * GRID).cast("int")
        no_grid = F.col("_grid").isNull()
        return F.struct(
            F.when(no_grid | (low <= 0), F.lit(float("-inf"))).otherwise(F.get("_grid", F.least(low, F.lit(GRID)))).alias("low"),
            F.when(no_grid | (high >= GRID), F.lit(float("nan"))).otherwise(F.get("_grid", high)).alias("high"),
        )

    return each.select(*by, _NAME, _K, *(ends(width).alias(f"_ends{i}") for i, width in enumerate(WIDTHS)))


def _select_inside(rows: DataFrame, by: Sequence[str], pending: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``(found, missed)``: the values at the ranks that the brackets of one width hold, and the
    rows of ``pending`` whose rank they do not hold. Beyond the last width nothing is left out."""
    if width < len(WIDTHS):
        low, high = F.col(f"_ends{width}.low"), F.col(f"_ends{width}.high")
    else:
        low, high = F.lit(float("-inf")), F.lit(float("nan"))
    ends = pending.select(*by, F.struct(F.col(_NAME).alias("name"), low.alias("low"), high.alias("high")).alias("_end"))
    ends = small_side(ends.groupBy(*by).agg(F.collect_list("_end").alias("_ends")))  # a struct per rank
    number = F.col(_VALUE).cast("double")
    near = rows.join(ends, list(by)).withColumn("_end", F.explode("_ends")).filter(number <= F.col("_end.high"))
    below = number < F.col("_end.low")
    # All rows below a bracket are one row of a task, those inside one row per distinct value.
    folded = near.groupBy(*by, F.col("_end.name").alias(_NAME), below.alias("_below"), F.when(~below, F.col(_VALUE)).alias(_VALUE)).agg(
        F.count(F.lit(1)).alias(_COPIES)
    )
    folded = materialise(folded, "inside")
    sums = folded.groupBy(*by, _NAME).agg(
        F.sum(F.when(F.col("_below"), F.col(_COPIES)).otherwise(0)).alias("_less"), F.sum(_COPIES).alias("_upto")
    )
    placed = materialise(pending.join(sums, [*by, _NAME], "left"), "placed")
    holds = (F.coalesce("_less", F.lit(0)) <= F.col(_K)) & (F.col(_K) < F.coalesce("_upto", F.lit(0)))
    wanted = placed.filter(holds).select(*by, _NAME, (F.col(_K) - F.col("_less")).alias(_K))
    return _at_ranks(folded.filter(~F.col("_below")).drop("_below"), by, wanted), placed.filter(~holds).drop("_less", "_upto")


def _at_ranks(histogram: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The value at the rank _k of each group and _name of a written histogram.

    The histogram is range-partitioned over all groups together, and only the slices of a
    partition that hold a wanted rank are ranked.
    """
    group = [*by, _NAME]
    parts = _range_parts(histogram, [*group, _VALUE])
    # One row per group and partition: groups + partitions rows at most.
    slices, small = fetch_small(parts.groupBy(*group, _PART).agg(F.sum(_COPIES).alias("_slice")))
    slices = slices.coalesce(1) if small else slices
    upto = F.sum("_slice").over(W.partitionBy(*group).orderBy(_PART))
    located = slices.withColumn("_ahead", upto - F.col("_slice")).join(small_side(wanted), group)
    located = located.select(*group, _PART, (F.col(_K) - F.col("_ahead")).alias(_K), "_slice")
    located = located.filter((F.col(_K) >= 0) & (F.col(_K) < F.col("_slice"))).drop("_slice")
    if small:
        located = F.broadcast(located)
    within = W.partitionBy(*group, _PART).orderBy(_POS)
    return (
        parts.join(located, [*group, _PART])
        .withColumn("_upto", F.sum(_COPIES).over(within))
        .filter((F.col("_upto") - F.col(_COPIES) <= F.col(_K)) & (F.col(_K) < F.col("_upto")))
        .select(*group, _VALUE)
    )
