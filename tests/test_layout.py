import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from irregts.operators import layout as la
from irregts.operators import stays as st
from irregts.operators import variables as va


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index_is_the_sort_position(spark, parts):
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(data, "s string, x long, i long").repartition(parts)
    indexed, n = la.global_row_index(df, ["s", "x"], "pos")
    assert n == 500
    got = [tuple(r) for r in indexed.orderBy("pos").collect()]
    assert [r[3] for r in got] == list(range(500))
    assert [r[:3] for r in got] == sorted(data)


def test_copies_are_spread_over_ranges(spark):
    """A third of the rows are equal; no written range holds them all."""
    df = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexed, n = la.global_row_index(df, ["x"], "pos")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert n == 30_000
    copies = indexed.filter("x = -1").agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert tuple(copies) == (10_000, 0, 9_999, 10_000)
    per_file = [r["n"] for r in indexed.filter("x = -1").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(per_file) > 1


def test_decimation_keeps_every_third_row_with_copies(spark):
    rng = random.Random(5)
    data = [(rng.randrange(4), rng.randrange(3), float(rng.randrange(2))) for _ in range(400)]
    df = spark.createDataFrame(data, "stay long, time long, value double").repartition(5)
    kept = sorted(tuple(r) for r in st.decimate(df, ["stay", "time", "value"], 3).collect())
    assert kept == sorted(data)[::3]


def test_ordinals_restart_in_each_stay(spark):
    rng = random.Random(6)
    data = [(rng.choice([1, 1, 1, 2, 9]), rng.randrange(50), rng.randrange(3), float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(data, "ind long, time long, itemid long, value double")
    expected = []
    for ind in {d[0] for d in data}:
        expected += [(*row, i) for i, row in enumerate(sorted(d for d in data if d[0] == ind))]
    assert sorted(tuple(r) for r in st.stay_ordinals(df).collect()) == sorted(expected)


@pytest.mark.parametrize("n, q1, q3", [(1, 0, 0), (2, 0, 1), (3, 1, 2), (4, 1, 2), (7, 2, 5), (11, 3, 8)])
def test_nearest_rank_quartiles(spark, n, q1, q3):
    df = spark.createDataFrame([(0, float(i)) for i in range(n)], "itemid long, value double")
    row = va.variable_quantiles(df, {"q1": 0.25, "q3": 0.75}).first()
    assert (row["q1"], row["q3"]) == (q1, q3)


def test_order_statistics_with_hot_groups_and_values(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.normal(size=3000)]
    data += [("flat", 1.0)] * 2000 + [("mix", 1.0)] * 700 + [("mix", float(x)) for x in rng.normal(size=300)]
    df = spark.createDataFrame(data, "g string, value double").repartition(6)
    ranks = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "high": lambda n: n - 1}
    got = {r["g"]: (r["low"], r["mid"], r["high"]) for r in la.order_statistics(df, ["g"], "value", ranks).collect()}
    for g in ("hot", "flat", "mix"):
        ordered = sorted(x for name, x in data if name == g)
        assert got[g] == (ordered[0], ordered[len(ordered) // 2], ordered[-1])


def test_small_tables_are_checked(spark):
    df = spark.range(50).toDF("k")
    table, small = la.fetch_small(df)
    assert small and table.count() == 50
    table, small = la.fetch_small(df, 10)
    assert not small and table.count() == 50
    large = spark.range(0, 200).select((F.col("id") % 50).alias("k"))
    assert large.join(la.small_side(df, 10), "k").count() == 200  # too large to broadcast, still whole


def test_outliers_and_keys(spark):
    data = [(7, float(x)) for x in [1, 2, 3, 4, 5, 100]] + [(3, 5.0)] * 4 + [(3, 6.0)]
    df = spark.createDataFrame(data, "itemid long, value double")
    clean = sorted(tuple(r) for r in va.remove_outliers(df).select("itemid", "value").collect())
    assert clean == [(3, 5.0)] * 4 + [(7, float(x)) for x in [1, 2, 3, 4, 5]]

    # Rows meet urea last, but the catalogue lists it first; nothing measures lactate.
    measured = ["sodium", "glucose", "sodium", "urea", "glucose", "glucose"]
    rows = spark.createDataFrame([(x,) for x in measured], "name string")
    listed = ["urea", "lactate", "glucose", "sodium"]
    catalogue = spark.createDataFrame([(x, x, 10 * i) for i, x in enumerate(listed)], "label string, name string, position int")
    key = va.variable_key(rows, catalogue, "name")
    expected = {"urea": 0, "glucose": 1, "sodium": 2}
    assert {r["label"]: r["key"] for r in key.collect()} == expected
    indexed = va.index_variables(rows, key, "name")
    assert sorted((r["name"], r["itemid"]) for r in indexed.collect()) == sorted((x, expected[x]) for x in measured)
    with pytest.raises(Exception, match="variable without key"):
        va.index_variables(rows, key.filter("label <> 'urea'"), "name").collect()


def test_labels_must_match_once(spark):
    key = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "label string, key long")
    assert va.resolve_labels(key, ["a"]) == {"a": 0}
    for bad in ("b", "A", "none"):
        with pytest.raises(ValueError, match="matches"):
            va.resolve_labels(key, [bad])


def test_stay_filters(spark):
    data = [(1, t) for t in range(0, 700, 60)] + [(2, 0), (2, 60)] + [(3, 0), (3, 600), (3, 601)]
    df = spark.createDataFrame(data, "ind long, time long")

    def left(**limits):
        return sorted(r[0] for r in st.filter_stays(df, **limits).select("ind").distinct().collect())

    assert left(min_measures=3) == [1, 3] and left(min_measures=2, max_measures=3) == [2, 3]
    assert left(min_hours=10) == [1, 3] and left(min_hours=11) == []
    with pytest.raises(ValueError, match="none of the given stays"):
        st.restrict_to_stays(df, spark.createDataFrame([(77,)], "ind long"))


def test_scratch_tables_can_be_cleared(spark):
    from irregts import session

    path = session.scratch_path(spark, "probe")
    table = session.materialise(spark.range(5).toDF("x"), "probe")
    assert table.count() == 5 and spark.sparkContext.applicationId in path
    other = spark.newSession()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    assert folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert session.scratch_path(other, "probe").startswith(folder.toString().removeprefix("file:"))


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from irregts import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def _shuffled_pairs(n):
    rng = random.Random(n)
    return [(rng.choice("abc"), rng.randrange(10**6)) for _ in range(n)]


@pytest.mark.parametrize("limit", [la.MAX_SMALL_BYTES, 0])
def test_digest_index_is_the_sort_position(spark, monkeypatch, limit):
    """With counts per part summed by the driver, and with counts that are too many for it."""
    monkeypatch.setattr(la.fetch_small, "__defaults__", (limit,))
    df = spark.createDataFrame(_shuffled_pairs(700), "s string, i long").distinct().withColumn("d", F.md5(F.col("i").cast("string")))
    for first in ((), ("s",)):
        indexed, n = la.digest_row_index(df.repartition(5), "d", "pos", first)
        order = [*first, "d", *(c for c in ("s", "i") if c not in first)]
        got = indexed.orderBy("pos").collect()
        assert n == len(got) and [r["pos"] for r in got] == list(range(n))
        assert [tuple(r[c] for c in order) for r in got] == sorted(tuple(r[c] for c in order) for r in got)
    assert la.digest_row_index(df.limit(0), "d", "pos")[1] == 0
    indexed, n = la.global_row_index(df, ["i"], "pos")
    assert [r["pos"] for r in indexed.orderBy("i").collect()] == list(range(n))


def test_rows_are_evaluated_once(spark):
    """Neither ranges nor buckets sample the rows: each is counted once on its way."""
    for number in (
        lambda df: la.global_row_index(df, ["x"], "pos")[0],
        lambda df: la.digest_row_index(df.withColumn("d", F.md5(F.col("x").cast("string"))), "d", "pos")[0],
        lambda df: st.stay_ordinals(df.select((F.col("x") % 7).alias("ind"), "x"), ["x"]),
    ):
        seen = spark.sparkContext.accumulator(0)

        def tell(batches, seen=seen):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        df = spark.range(0, 5000, 1, 4).toDF("x").mapInArrow(tell, "x long")
        assert number(df).count() == 5000
        assert seen.value == 5000


def test_ordinals_of_hot_stays_come_from_the_global_order(spark):
    rng = random.Random(7)
    data = [(rng.choice([1, 1, 1, 2, 9]), rng.randrange(50), rng.randrange(3), float(i % 4)) for i in range(300)]
    df = spark.createDataFrame(data, "ind long, time long, itemid long, value double").repartition(3)
    usual = sorted(map(tuple, st.stay_ordinals(df).collect()))
    assert sorted(map(tuple, st.stay_ordinals(df, hot=100).collect())) == usual
    assert sorted(map(tuple, st.stay_ordinals(df, hot=0).collect())) == usual


def _quantiles(values, ranks):
    ordered = sorted(values, key=lambda x: (x != x, x))
    return tuple(ordered[r(len(ordered))] for r in ranks)


@pytest.mark.parametrize("widths", [la.WIDTHS, (0.0, 0.0), (0.0, 3.0)])
def test_brackets_of_any_width_give_the_exact_value(spark, monkeypatch, widths):
    monkeypatch.setattr(la, "WIDTHS", widths)
    monkeypatch.setattr(la, "SKETCH", 16)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=4000).tolist(),
        "steps": rng.integers(0, 3, 900).astype(float).tolist(),
        "nan": [float("nan")] * 30 + rng.normal(size=20).tolist(),
        "all nan": [float("nan")] * 5,
        "wide": [*rng.normal(size=50).tolist(), float("inf"), float("-inf"), 1e300, -0.0, 0.0],
        "one": [3.0],
    }
    data = [(g, x) for g, values in groups.items() for x in values] + [("one", None), (None, 2.0)]
    rng.shuffle(data)
    df = spark.createDataFrame([(g if g != "None" else None, None if x is None else float(x)) for g, x in data], "g string, value double").repartition(4)
    ranks = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "q": lambda n: F.floor(n * 0.9), "high": lambda n: n - 1}
    got = {r["g"]: (r["low"], r["mid"], r["q"], r["high"]) for r in la.order_statistics(df, ["g"], "value", ranks).collect()}
    assert set(got) == set(groups)
    python = [lambda n: 0, lambda n: n // 2, lambda n: int(n * 0.9), lambda n: n - 1]
    for g, values in groups.items():
        assert repr(got[g]) == repr(tuple(x + 0.0 for x in _quantiles(values, python))), g


def test_few_rows_leave_the_map_side(spark, monkeypatch):
    """Quartiles of a continuous column, most of it one variable: under five hundredths are shuffled."""
    moved = []
    real = la.materialise

    def recording(df, name, *more):
        table = real(df, name, *more)
        if name == "inside":
            moved.append(table.count())
        return table

    monkeypatch.setattr(la, "materialise", recording)
    n = 400_000
    df = spark.range(0, n, 1, 4).select(F.when(F.col("id") % 20 == 0, F.col("id") % 3 + 1).otherwise(0).alias("itemid"), F.randn(3).alias("value"))
    df = real(df, "values")
    got = {r["itemid"]: (r["q1"], r["q3"]) for r in va.variable_quantiles(df, {"q1": 0.25, "q3": 0.75}).collect()}
    for item, pair in got.items():
        ordered = np.sort(np.array([r["value"] for r in df.filter(F.col("itemid") == item).collect()]))
        at = [int(np.floor((len(ordered) - 1) * q + 0.5)) for q in (0.25, 0.75)]
        assert pair == tuple(ordered[at])
    assert len(got) == 4 and len(moved) == 1 and moved[0] < 0.05 * n


def test_values_are_numbered_by_first_appearance(spark):
    """The example A, B, C, A, D, B, E gives 0, 1, 2, 0, 3, 1, 4; null is a value."""
    data = list(enumerate(["A", "B", "C", "A", "D", "B", "E", None, "A"]))
    df = spark.createDataFrame(data, "place long, x string").repartition(4)
    rows, key = va.index_by_first_appearance(df, "x", ["place"], "n")
    assert [r["n"] for r in rows.orderBy("place").collect()] == [0, 1, 2, 0, 3, 1, 4, 5, 0]
    assert {(r["x"], r["key"]) for r in key.collect()} == {("A", 0), ("B", 1), ("C", 2), ("D", 3), ("E", 4), (None, 5)}
    same = spark.createDataFrame([(1, "b"), (1, "a"), (0, "c")], "t long, x string")
    assert {r["x"]: r["key"] for r in va.first_seen_key(same, "x", ["t"]).collect()} == {"c": 0, "a": 1, "b": 2}
    assert va.first_seen_key(same.limit(0), "x", ["t"]).count() == 0


def test_restricted_rows_evaluate_their_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 900, 1, 3).selectExpr("id % 30 as ind", "id as time").mapInArrow(tell, "ind long, time long")
    kept = st.restricted_rows(df, spark.range(5).toDF("ind"))
    assert kept.count() == 150 and kept.agg(F.max("ind")).first()[0] == 4 and seen.value == 900
    with pytest.raises(ValueError, match="none of the given stays"):
        st.restricted_rows(df, spark.createDataFrame([(77,)], "ind long"))


@pytest.mark.parametrize("hot", [st.HOT_STAY, 40, 0])
def test_thinning_wide_rows_equals_thinning_their_cells(spark, hot):
    """Missing cells, several rows of one stay and time, equal cells, an empty column, null stays."""
    from irregts.sources.offsets import unpivot_vitals

    rng = random.Random(13)
    data = [
        (rng.choice([3, 3, 3, 1, 8, 11, None]), rng.choice([None, *range(25)]), *(rng.choice([None, 1.0, 2.0, rng.random()]) for _ in "abc"), None)
        for _ in range(500)
    ]
    data += [(30 + i, i, 0.5, float("nan") if i % 2 else 1.5, None, None) for i in range(40)]
    wide = spark.createDataFrame(data, "patientunitstayid long, time long, b double, a double, c double, d double").repartition(4)
    names = ["b", "a", "c", "d"]
    want = st.decimate_vitals(unpivot_vitals(wide, names), names)
    got = st.decimate_wide(wide, names, hot=hot)
    assert got.columns == want.columns and want.count() > 300
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert st.decimate_wide(wide.limit(0), names).count() == 0


def test_only_kept_cells_become_rows(spark):
    """No exchange of the plan moves unpivoted cells where no two rows have one stay and time."""
    wide = spark.range(0, 3000, 1, 3).selectExpr("id % 10 as patientunitstayid", "id as time", "1.0D as a", "2.0D as b")
    thinned = st.decimate_wide(wide, ["a", "b"])
    lines = thinned._jdf.queryExecution().executedPlan().toString().splitlines()
    start = next(i for i, line in enumerate(lines) if line.lstrip().startswith(":- "))
    single = lines[start : next(i for i, line in enumerate(lines) if i > start and line.lstrip().startswith("+- ") and "Project" in line)]
    cells = next(i for i, line in enumerate(single) if "Generate" in line)
    assert not any("Exchange" in line for line in single[:cells]) and any("Exchange" in line for line in single[cells:])
    assert thinned.count() == 2000


def test_running_sums(spark):
    rng = random.Random(2)
    data = [(i, rng.randrange(9), rng.randrange(3)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "k long, a long, b long").repartition(5)
    summed, totals = la.running_sums(df, ["k"], ["a", "b"])
    a = b = 0
    for row in summed.orderBy("k").collect():
        assert (row["_before_a"], row["_before_b"]) == (a, b)
        a, b = a + row["a"], b + row["b"]
    assert totals == [a, b] and la.running_sums(df.limit(0), ["k"], ["a"])[1] == [0]
