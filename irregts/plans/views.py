"""Stand-ins for the clinical tables, derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irregts.functions.expr import timestamp_text, whole_minutes
from irregts.operators.cohort import CohortRules, cull_cohort

LABELS = ("purchase", "click", "view", "error", "signup")
VITALS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
STAGES = (20.0, 45.0, 80.0)
TARGET = 0
BASE_RULES = CohortRules(target=TARGET, skippable=(TARGET,), staging=STAGES)


SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def text_time(column: str) -> F.Column:
    return timestamp_text(F.col(column))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("hadm_id"),
        F.col("user_id").alias("stay_id"),
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("charttime"),
        F.col("event_type").alias("itemid"),
        "value",
    )


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a source file holds them: text times and missing values."""
    return events(spark, d).select(
        "hadm_id",
        "stay_id",
        "subject_id",
        text_time("charttime").alias("charttime"),
        "itemid",
        F.when(F.col("value") >= 5, F.col("value")).alias("valuenum"),
    )


def raw_order_events(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_custkey").alias("subject_id"),
        text_time("o_orderdate").alias("starttime"),
        F.col("l_returnflag").alias("itemid"),
        F.col("l_quantity").alias("amount"),
        F.col("l_extendedprice").alias("value"),
    )


def raw_datetime_events(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("hadm_id"),
        F.col("o_orderkey").alias("stay_id"),
        F.col("o_custkey").alias("subject_id"),
        text_time("o_orderdate").alias("charttime"),
        F.col("l_returnflag").alias("itemid"),
        text_time("l_shipdate").alias("value"),
    )


def admissions(spark: SparkSession, d: str) -> DataFrame:
    wait = F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 48).cast("int"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("hadm_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + wait).alias("admittime"),
        F.col("c_mktsegment").alias("admission_location"),
    )


def patients(spark: SparkSession, d: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"),
        F.when(nation % 3 == 0, "M").when(nation % 3 == 1, "F").alias("gender"),
        (20 + 3 * nation).cast("int").alias("anchor_age"),
    )


def catalogue(spark: SparkSession, labels=LABELS) -> DataFrame:
    return spark.createDataFrame(
        [(label, label, i) for i, label in enumerate(labels)], "label string, itemid string, position int"
    )


def offset(column) -> F.Column:
    return whole_minutes(F.lit("1995-01-01").cast("timestamp_ntz"), column)


def raw_lab_offsets(spark: SparkSession, d: str, stay: str = "l_suppkey") -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col(stay).alias("patientunitstayid"),
        offset(F.col("l_shipdate")).alias("labresultoffset"),
        F.col("l_returnflag").alias("labname"),
        (F.col("l_quantity") * F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax")).alias("labresult"),
    )


def vitals_wide(spark: SparkSession, d: str, stay: str = "l_suppkey") -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col(stay).alias("patientunitstayid"),
        offset(F.col("l_shipdate")).alias("time"),
        "l_quantity",
        "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
    )


def raw_stay_demographics(spark: SparkSession, d: str) -> DataFrame:
    nation = F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("patientunitstayid"),
        F.when(nation % 3 == 0, "Male").when(nation % 3 == 1, "Female").otherwise("").alias("gender"),
        F.when(nation > 20, "> 89").when(nation == 0, "").otherwise((20 + 3 * nation).cast("string")).alias("age"),
    )


def measures(spark: SparkSession, d: str) -> DataFrame:
    """The processed table: a user's events in minutes since admission."""
    key = catalogue(spark).select("itemid", F.col("position").cast("long").alias("key"))
    joined = (
        events(spark, d)
        .join(admissions(spark, d), "hadm_id")
        .join(patients(spark, d), "subject_id")
        .join(F.broadcast(key), "itemid")  # five rows
    )
    return joined.select(
        F.col("stay_id").alias("ind"),
        F.col("key").alias("itemid"),
        whole_minutes(F.col("admittime"), F.col("charttime")).alias("time"),
        "value",
        "gender",
        F.col("anchor_age").cast("double").alias("age"),
    )


def line_measures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as short stays: few rows and not every variable in each."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ind"),
        F.col("l_linenumber").cast("long").alias("itemid"),
        offset(F.col("l_shipdate")).alias("time"),
        F.col("l_quantity").alias("value"),
    )


def cohort(spark: SparkSession, d: str) -> DataFrame:
    return cull_cohort(measures(spark, d), BASE_RULES)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Two measures of a line item as truth and forecast; fold 0 has forecasts below zero."""
    fold = F.col("l_linenumber") % 5
    forecast = F.col("l_extendedprice") / 20000 - F.when(fold == 0, 0.5).otherwise(0.0)
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ind"),
        F.when(F.col("l_linestatus") == "O", "test").otherwise("train").alias("set"),
        fold.cast("int").alias("fold"),
        (F.col("l_quantity") / 10).alias("y_true"),
        forecast.alias("y_pred"),
        F.array(forecast * 0.8, forecast, forecast * 1.2).alias("q_pred"),
    )
