"""Event tables with absolute times, and the two dimension tables they join to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irregts.functions.expr import all_present, parse_timestamp, whole_minutes
from irregts.operators.layout import join_back
from irregts.session import materialise
from irregts.sources.tables import Paths, read_table


@dataclass(frozen=True)
class EventLayout:
    """Where an event table keeps its time and value, and what the value is."""

    time: str = "charttime"
    value: str = "valuenum"
    ids: tuple[str, ...] = ("hadm_id", "stay_id", "subject_id")
    value_is_date: bool = False

    @property
    def schema(self) -> T.StructType:
        value_type = T.StringType() if self.value_is_date else T.DoubleType()
        return T.StructType(
            [T.StructField(c, T.LongType()) for c in self.ids]
            + [
                T.StructField(self.time, T.StringType()),
                T.StructField("itemid", T.LongType()),
                T.StructField(self.value, value_type),
            ]
        )


# The six event tables by their column names.
LAYOUTS = {
    "chartevents": EventLayout(),
    "datetimeevents": EventLayout(value="value", value_is_date=True),
    "inputevents": EventLayout(time="starttime", value="amount"),
    "outputevents": EventLayout(value="value"),
    "procedureevents": EventLayout(time="starttime", value="value"),
    "labevents": EventLayout(ids=("subject_id", "hadm_id")),
}

ADMISSIONS = T.StructType(
    [
        T.StructField("admittime", T.StringType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("deathtime", T.StringType()),
        T.StructField("admission_location", T.StringType()),
    ]
)

PATIENTS = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("anchor_age", T.IntegerType()),
    ]
)


def clean_events(raw: DataFrame, layout: EventLayout) -> DataFrame:
    """Complete rows only, as ``(ids, charttime, itemid, value)``.

    A date value becomes whole minutes since the earliest charttime of its admission.
    The earliest times are aggregated map-side and joined back, not taken from a window,
    so that an admission of any size stays spread.
    """
    columns = [*layout.ids, layout.time, "itemid", layout.value]
    events = raw.filter(all_present(*columns)).select(
        *layout.ids,
        parse_timestamp(F.col(layout.time)).alias("charttime"),
        "itemid",
        (parse_timestamp(F.col(layout.value)) if layout.value_is_date else F.col(layout.value).cast("double")).alias(
            "value"
        ),
    )
    if not layout.value_is_date:
        return events
    events = materialise(events, "dates")  # the text is parsed once
    earliest = events.groupBy("hadm_id").agg(F.min("charttime").alias("_earliest"))
    return (
        join_back(events, earliest, "hadm_id")
        .withColumn("value", whole_minutes(F.col("_earliest"), F.col("value")))
        .select(*events.columns)
    )


def read_events(spark: SparkSession, path: Paths, kind: str, fmt: str = "csv") -> DataFrame:
    """Read one of the six event tables into the common columns."""
    if kind not in LAYOUTS:
        raise ValueError(f"unknown event table {kind!r}; known: {sorted(LAYOUTS)}")
    layout = LAYOUTS[kind]
    return clean_events(read_table(spark, path, layout.schema, fmt), layout)


def clean_admissions(raw: DataFrame) -> DataFrame:
    return raw.withColumn("admittime", parse_timestamp(F.col("admittime")))


def read_admissions(spark: SparkSession, path: Paths, fmt: str = "csv") -> DataFrame:
    return clean_admissions(read_table(spark, path, ADMISSIONS, fmt))


def clean_patients(raw: DataFrame) -> DataFrame:
    return raw.withColumn("age", F.col("anchor_age"))


def read_patients(spark: SparkSession, path: Paths, fmt: str = "csv") -> DataFrame:
    return clean_patients(read_table(spark, path, PATIENTS, fmt))
