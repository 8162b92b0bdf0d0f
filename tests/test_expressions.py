import math

import pytest
from pyspark.sql import functions as F

from irregts.functions import expr as ex


def column(spark, values, schema, expression):
    rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_whole_minutes_cut_toward_zero_in_any_zone(spark):
    seconds = [-150.0, -90.0, -30.0, 30.0, 90.0, 150.0]
    start = F.lit("2024-03-10 01:59:00").cast("timestamp_ntz")
    end = start + F.make_dt_interval(secs=F.col("s"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert column(spark, seconds, "s double", ex.whole_minutes(start, end)) == [-2, -1, 0, 0, 1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_timestamp_is_strict(spark):
    good = column(spark, ["2157-11-20 19:54:00", None], "s string", ex.parse_timestamp(F.col("s")).cast("string"))
    assert good == ["2157-11-20 19:54:00", None]
    for bad in ("2157-11-20", "2157-11-20T19:54:00", "20/11/2157 19:54:00", "2157-13-20 19:54:00"):
        with pytest.raises(Exception):
            column(spark, [bad], "s string", ex.parse_timestamp(F.col("s")))


def test_age_words(spark):
    out = column(spark, ["> 89", "", "45", None], "s string", ex.recode_age(F.col("s")))
    assert out == [95, 50, 45, None]


def test_gender_codes(spark):
    out = column(spark, ["M", "Male", "F", "Female", "X", "", None], "s string", ex.gender_code(F.col("s")))
    assert out == [-1, -1, 1, 1, 0, 0, 0]


def test_stages(spark):
    values = [0.0, 1.34, 1.35, 2.67, 2.68, 4.15, 4.16, 9.0, math.nan, None]
    assert column(spark, values, "x double", ex.stage(F.col("x"), "KDIGO")) == [0, 0, 1, 1, 2, 2, 3, 3, 3, None]
    assert column(spark, [1.0, 3.0], "x double", ex.stage(F.col("x"), [2])) == [0, 1]
    with pytest.raises(ValueError):
        ex.stage(F.col("x"), "unknown")
    with pytest.raises(ValueError):
        ex.stage(F.col("x"), [3, 1])


def test_normalisation_has_an_inverse(spark):
    x = F.col("x")
    for std in (2.5, 0.0):
        back = ex.unstandardise(ex.standardise(x, F.lit(1.5), F.lit(std)), F.lit(1.5), F.lit(std))
        assert column(spark, [4.0, -3.0], "x double", back) == [4.0, -3.0]
    for high in (6.0, 2.0):
        back = ex.min_max_unscale(ex.min_max_scale(x, F.lit(2.0), F.lit(high)), F.lit(2.0), F.lit(high))
        assert column(spark, [4.0, -3.0], "x double", back) == [4.0, -3.0]


def test_losses(spark):
    assert column(spark, [0.5, -0.5, 3.0, -3.0], "e double", ex.huber(F.col("e"), 1.0)) == [0.125, 0.125, 2.5, 2.5]
    out = column(spark, [(2.0, 1.0), (1.0, 2.0)], "y double, p double", ex.pinball(F.col("y"), F.col("p"), F.lit(0.9)))
    assert out == pytest.approx([0.9, 0.1])
    assert ex.even_quantiles(3) == [0.25, 0.5, 0.75]
    with pytest.raises(ValueError):
        ex.even_quantiles(0)
