"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.session import materialise

#: Byte table that lower-cases A-Z and leaves all other bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, with every byte that is neither a-z, 0-9 nor part of a non-ASCII character a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Bytes of an Arrow batch of the operators that cut batches by size.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the bytes of Arrow batches, whatever the length of texts; rows stay as the session
    has them, so other Arrow work of the session is not cut smaller than that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def id_crc32(column: str = "doc_id") -> Column:
    """Unsigned crc32 of an id written as text; that of the empty string where null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def utf8(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null is empty. Workers then need not decode it."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def same_document(documents: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join documents to ``keys`` by doc_id (null-safe) and text_key, the xxhash64 of the text.

    ``keys`` has those two columns and perhaps more, none of which the documents have.
    """
    doc_id, text_key = unused(documents, "_id"), unused(documents, "_key")
    keys = keys.withColumnsRenamed({"doc_id": doc_id, "text_key": text_key})
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(text_key))
    return documents.join(keys, same, how)


def sequenced(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Write ``df`` in global order; add _part and _pos, its place in the sorted partitions.

    Rows that are equal in ``order`` are told apart by where they were read, so a key
    with any share of the rows is spread over the partitions.
    """
    names = [c for c in df.columns]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    traced = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = traced.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = materialise(placed.withColumn("_mid", F.monotonically_increasing_id()), "sequence")
    # monotonically_increasing_id keeps the partition number above bit 33.
    return placed.select(
        *names,
        F.shiftright("_mid", 33).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def running(sequence: DataFrame, by: Sequence[str], amount: str | None = None, name: str = "slot") -> DataFrame:
    """For rows of :func:`sequenced`, sorted by ``by`` first: what is ahead in the group.

    Without ``amount`` that is a gapless number from 0, else the sum of ``amount`` over
    the rows ahead. A window never spans more than one range partition; one total per
    group and partition carries over to the next.
    """
    by = list(by)
    total = F.count(F.lit(1)) if amount is None else F.sum(amount)
    sums = sequence.groupBy("_part", *by).agg(total.alias("_n"), F.min("_pos").alias("_first"))
    over = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_part")
    ahead = sums.withColumn("_ahead", F.sum("_n").over(over) - F.col("_n")).drop("_n")
    if amount is None:
        within = F.col("_pos") - F.col("_first")
    else:
        inside = W.partitionBy("_part", *by).orderBy("_pos")
        within = F.sum(amount).over(inside) - F.col(amount)
        sequence = sequence.withColumn("_within", within)
        within = F.col("_within")
    joined = _null_safe_join(sequence, ahead, ["_part", *by])
    return joined.withColumn(name, F.col("_ahead") + within).drop("_ahead", "_first", "_within")


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    renamed = right.select(*(F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns))
    condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, condition).drop(*(f"_r_{c}" for c in on))
