"""Typed readers: column names are matched by name, types come from a declared schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irregts.schemas import KEY, MEASURES

# Marks "no value" in CSV text; a quoted empty string then stays an empty string.
_UNUSED_NULL = "\u0001"


Paths = str | Sequence[str]


def read_table(
    spark: SparkSession,
    path: Paths,
    schema: T.StructType,
    fmt: str = "csv",
    keep_empty_text: bool = False,
) -> DataFrame:
    """Read the columns of ``schema`` from a CSV or parquet table.

    CSV tables may hold more columns in any order: the header gives the names. All files
    of one path must have the same header; another order, a row with missing or
    surplus cells and, under ANSI casts, a malformed cell are errors. Several paths are
    matched by name, so each may have an order of its own.
    """
    if not isinstance(path, str):
        return reduce(DataFrame.unionByName, (read_table(spark, p, schema, fmt, keep_empty_text) for p in path))
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "csv":
        reader = spark.read.option("header", True)
        if keep_empty_text:
            reader = reader.option("nullValue", _UNUSED_NULL)
        names = reader.csv(path).columns
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        # Headers are compared and rows counted only where no column is pruned.
        strict = reader.schema(text).option("enforceSchema", False).option("columnPruning", False)
        raw = strict.option("mode", "FAILFAST").csv(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', got {fmt!r}")
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")
    return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def read_measures(spark: SparkSession, path: Paths, fmt: str = "parquet") -> DataFrame:
    """The six columns of a processed or cohort table."""
    return read_table(spark, path, MEASURES, fmt)


def read_key(spark: SparkSession, path: Paths, fmt: str = "csv") -> DataFrame:
    """The label to id dictionary written by the first stage."""
    return read_table(spark, path, KEY, fmt)
