"""Tables that carry minutes since admission instead of absolute times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irregts.functions.expr import all_present, recode_age
from irregts.sources.tables import Paths, read_table

LAB_OFFSETS = T.StructType(
    [
        T.StructField("patientunitstayid", T.LongType()),
        T.StructField("labresultoffset", T.LongType()),
        T.StructField("labname", T.StringType()),
        T.StructField("labresult", T.DoubleType()),
    ]
)

STAY_DEMOGRAPHICS = T.StructType(
    [
        T.StructField("patientunitstayid", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.StringType()),
    ]
)

STAY, TIME = "patientunitstayid", "time"


def clean_lab_offsets(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(
        {"labresultoffset": TIME, "labname": "variable", "labresult": "value"}
    )


def read_lab_offsets(spark: SparkSession, path: Paths, fmt: str = "csv") -> DataFrame:
    return clean_lab_offsets(read_table(spark, path, LAB_OFFSETS, fmt))


def unpivot_vitals(wide: DataFrame, vitals: Sequence[str], stay: str = STAY, time: str = TIME) -> DataFrame:
    """Wide vitals to long ``(stay, time, variable, value)`` without the empty cells."""
    doubles = wide.select(stay, time, *(F.col(v).cast("double").alias(v) for v in vitals))
    return doubles.unpivot([stay, time], list(vitals), "variable", "value").filter(all_present(stay, time, "value"))


def read_vitals(spark: SparkSession, path: Paths, vitals: Sequence[str], fmt: str = "csv") -> DataFrame:
    """Read the listed vitals of a wide periodic table; feeds :func:`unpivot_vitals`."""
    schema = T.StructType(
        [T.StructField(STAY, T.LongType()), T.StructField("observationoffset", T.LongType())]
        + [T.StructField(v, T.DoubleType()) for v in vitals]
    )
    return read_table(spark, path, schema, fmt).withColumnRenamed("observationoffset", TIME)


def clean_stay_demographics(raw: DataFrame) -> DataFrame:
    return raw.withColumn("age", recode_age(F.col("age")))


def read_stay_demographics(spark: SparkSession, path: Paths, fmt: str = "csv") -> DataFrame:
    return clean_stay_demographics(read_table(spark, path, STAY_DEMOGRAPHICS, fmt, keep_empty_text=True))
