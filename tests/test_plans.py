"""Shape of the physical plans: splits of hot keys, exchanges, pushdown."""

import re

import pytest
from pyspark.sql import functions as F

from compare import DATA
from irregts.operators import cohort as co
from irregts.operators import stays as st
from irregts.operators import windows as wi
from irregts.plans import queries as qu
from irregts.plans import views as v


def executed(df) -> str:
    df.toArrow()
    return df._jdf.queryExecution().executedPlan().toString()


def final(plan: str) -> str:
    return plan.split("== Initial Plan ==")[0]


@pytest.fixture
def small_cluster(spark):
    """Thresholds that make the test table look like a large one."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    yield spark
    for k, value in before.items():
        spark.conf.unset(k) if value is None else spark.conf.set(k, value)


@pytest.fixture
def hot_stay(small_cluster):
    """A third of all rows belong to stay 7."""
    i = F.col("id")
    return small_cluster.range(0, 150_000, 1, 8).select(
        F.when(i % 3 == 0, 7).otherwise(i % 4000).cast("long").alias("ind"),
        (i % 5).alias("itemid"),
        (i * 7919 % 40_000).alias("time"),
        (i * 31 % 977 / 7).alias("value"),
        F.lit("M").alias("gender"),
        F.lit(50.0).alias("age"),
    )


def test_hot_stay_is_split_where_rows_meet_stay_tables(hot_stay):
    rules = co.CohortRules(target=0, skippable=(0,), staging=(20.0, 45.0, 80.0))
    jobs = {
        "cohort": co.cull_cohort(hot_stay, rules),
        "filter": st.filter_stays(hot_stay, 1, 1_000_000),
        "restrict": st.restrict_to_stays(hot_stay, hot_stay.filter("time > 100")),
        "lookback": wi.forecast_inputs(hot_stay, 0, masked=(0,), back_minutes=1000),
        "index": st.index_stays(hot_stay, "ind", "n"),
    }
    for name, df in jobs.items():
        assert "skew=true" in executed(df), name


def test_hot_stay_is_ranked_in_pieces_after_the_split(hot_stay):
    plain = wi.forecast_inputs(hot_stay, 0, horizon_hours=1, max_measures=50)
    targets = wi.target_observations(hot_stay, 0)
    rows = wi.window_horizon(wi.input_rows(hot_stay, targets), 1)
    pieces = wi.last_n(rows, 50, pieces=8).select(*hot_stay.columns)
    plan = final(executed(pieces))
    assert "skew=true" in plan and re.search(r"hashpartitioning\(ind#\w+, _piece", plan)
    assert plain.exceptAll(pieces).isEmpty() and pieces.exceptAll(plain).isEmpty()


@pytest.mark.parametrize(
    "name",
    [
        "cull_cohort", "cull_labels", "forecast_inputs", "normalize_standard", "stay_count_filter", "remove_outliers",
        "stay_ordinals", "decimate", "split_kfold", "metric_medae", "sequences", "metrics_by_fold",
    ],
)
def test_no_row_passes_a_cross_join_or_a_single_task_window(spark, name):
    plan = executed(qu.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window [^\n]*\n[^\n]*\n?[^\n]*SinglePartition", plan)


def test_scans_read_only_what_they_need(spark):
    m = v.measures(spark, DATA)
    plan = co.stay_profile(m, v.BASE_RULES)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert not any("props" in s or "event_id" in s or "c_name" in s for s in schemas)
    labs = st.filter_stays(qu._vitals(spark, DATA).withColumnRenamed("patientunitstayid", "ind"), 1)
    assert "l_partkey" not in executed(labs)


def test_profile_aggregates_before_its_only_exchange(spark):
    i = F.col("id")
    m = spark.range(1000).select((i % 9).alias("ind"), (i % 3).alias("itemid"), i.alias("time"), (i / 2).alias("value"))
    plan = executed(co.stay_profile(m, v.BASE_RULES))
    assert final(plan).count("Exchange hashpartitioning") == 1 and "partial_" in final(plan)
