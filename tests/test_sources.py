import pytest

from irregts.operators.stays import index_stays
from irregts.operators.windows import target_observations
from irregts.plans import stages
from irregts.sources import events as ev
from irregts.sources import offsets as off
from irregts.sources import writers as wr
from irregts.sources.tables import read_key, read_measures


def write(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, x) for x in r])


CHARTED = """subject_id,hadm_id,stay_id,caregiver_id,charttime,storetime,itemid,value,valuenum,valueuom
1,10,100,,2157-11-20 19:54:00,x,7,abc,1.5,mg
1,10,100,,2157-11-20 20:54:00,x,7,abc,,mg
1,,100,,2157-11-20 20:55:00,x,7,abc,2.5,mg
2,20,200,,2157-11-21 00:00:30,x,8,abc,NaN,mg
"""


def test_charted_events_drop_incomplete_rows_but_keep_nan(spark, tmp_path):
    df = ev.read_events(spark, write(tmp_path / "c.csv", CHARTED), "chartevents")
    assert df.columns == ["hadm_id", "stay_id", "subject_id", "charttime", "itemid", "value"]
    out = sorted((r["hadm_id"], str(r["charttime"]), str(r["value"])) for r in df.collect())
    assert out == [(10, "2157-11-20 19:54:00", "1.5"), (20, "2157-11-21 00:00:30", "nan")]


def test_csv_scans_convert_only_the_needed_columns(spark, tmp_path):
    df = ev.read_events(spark, write(tmp_path / "c.csv", CHARTED), "chartevents")
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert sorted(scan.requiredSchema().names()) == ["charttime", "hadm_id", "itemid", "stay_id", "subject_id", "valuenum"]


def test_lab_events_have_no_stay(spark, tmp_path):
    df = ev.read_events(spark, write(tmp_path / "c.csv", CHARTED), "labevents")
    assert df.columns == ["subject_id", "hadm_id", "charttime", "itemid", "value"]


def test_date_values_become_minutes_since_the_admissions_first_chart(spark, tmp_path):
    text = """hadm_id,stay_id,subject_id,charttime,itemid,value
10,1,1,2150-01-01 10:00:00,5,2150-01-01 10:30:00
10,2,1,2150-01-01 09:00:00,5,2150-01-01 08:58:30
"""
    df = ev.read_events(spark, write(tmp_path / "d.csv", text), "datetimeevents")
    assert rows(df, "stay_id", "value") == [(1, 90), (2, -1)]


@pytest.mark.parametrize(
    "kind, header", [("inputevents", "starttime,itemid,amount"), ("procedureevents", "starttime,itemid,value"),
                     ("outputevents", "charttime,itemid,value")],
)
def test_other_events(spark, tmp_path, kind, header):
    text = f"hadm_id,stay_id,subject_id,{header}\n1,2,3,2150-01-01 10:00:00,9,40\n1,2,3,2150-01-01 11:00:00,9,0.5\n"
    df = ev.read_events(spark, write(tmp_path / "e.csv", text), kind)
    assert dict(df.dtypes)["value"] == "double" and dict(df.dtypes)["charttime"] == "timestamp_ntz"
    assert rows(df, "itemid", "value") == [(9, 0.5), (9, 40.0)]


def test_reader_errors(spark, tmp_path):
    path = write(tmp_path / "x.csv", "hadm_id,stay_id\n1,2\n")
    with pytest.raises(ValueError, match="no column"):
        ev.read_events(spark, path, "chartevents")
    with pytest.raises(ValueError, match="unknown event table"):
        ev.read_events(spark, path, "other")
    bad = write(tmp_path / "y.csv", "patientunitstayid,labresultoffset,labname,labresult\nabc,1,x,2\n")
    with pytest.raises(Exception):
        off.read_lab_offsets(spark, bad).collect()


LABS = "patientunitstayid,labresultoffset,labname,labresult\n9,50,x,2.5\n"
SWAPPED = "labresultoffset,patientunitstayid,labname,labresult\n50,9,x,2.5\n"


def test_files_of_one_path_must_agree_on_their_columns(spark, tmp_path):
    write(tmp_path / "a.csv", LABS)
    write(tmp_path / "b.csv", SWAPPED)
    with pytest.raises(Exception, match="CSV header does not conform"):
        off.read_lab_offsets(spark, str(tmp_path)).collect()
    both = off.read_lab_offsets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert rows(both, "patientunitstayid", "time", "value") == [(9, 50, 2.5)] * 2


@pytest.mark.parametrize("line", ["9,50,x", "9,50,x,2.5,7"])
def test_rows_with_missing_or_surplus_cells_are_errors(spark, tmp_path, line):
    path = write(tmp_path / "a.csv", LABS + line + "\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        off.read_lab_offsets(spark, path).collect()


def test_second_source_numbers_vitals_before_labs(spark):
    labs = spark.createDataFrame([(1, t, "L", float(t)) for t in range(12)], "patientunitstayid long, time long, variable string, value double")
    wide = spark.createDataFrame([(1, t, 2.0) for t in range(9)], "patientunitstayid long, time long, hr double")
    people = spark.createDataFrame([(1, "Male", 60)], "patientunitstayid long, gender string, age int")
    _, key = stages.measures_from_offsets(labs, wide, people, ["L"], ["hr"])
    assert rows(key, "label", "key") == [("L", 1), ("hr", 0)]


def test_lookups_read_only_the_row_groups_of_their_stays(spark, tmp_path):
    data = spark.range(40_000).selectExpr(
        "id % 40 as ind", "id % 3 as itemid", "id as time", "rand(1) as value", "'M' as gender", "50.0D as age"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = wr.write_measures(data, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stay = wr.read_stay(spark, path, 3, 4)
    assert stay.count() == 2000
    metrics = stay._jdf.queryExecution()
    stay.collect()
    leaves = metrics.executedPlan().collectLeaves()
    read = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert 2000 <= read < 40_000


def test_lookups_open_only_the_files_that_the_manifest_names(spark, tmp_path):
    data = spark.range(6000).selectExpr(
        "case when id % 3 = 0 then 20 else id % 60 end as ind", "id % 3 as itemid", "id as time", "1.0D as value", "'M' as gender", "50.0D as age"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = wr.write_measures(data, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = spark.read.parquet(f"{path}/{wr.MANIFEST}").collect()
    assert len(manifest) > 4 and sum(r["rows"] for r in manifest) == spark.read.parquet(path).count() == 6000
    for inds in ((1,), (20,), (2, 41, 58), (1, 1), (999,)):
        named = [r["file"] for r in manifest if any(r["least"] <= i <= r["greatest"] for i in inds)]
        stay = wr.read_stay(spark, path, *inds)
        opened = [f.rsplit("/", 1)[1] for f in stay.inputFiles()]
        assert sorted(opened) == sorted(named) or not named
        assert sorted(map(tuple, stay.collect())) == sorted(map(tuple, spark.read.parquet(path).filter(f"ind in ({', '.join(map(str, inds))})").collect()))
    assert len(wr.files_of_stays(spark, path, 20)) > 1  # a long stay spans files
    moved = str(tmp_path / "moved")
    (tmp_path / "m").rename(moved)
    assert wr.read_stay(spark, moved, 2).count() == data.filter("ind = 2").count()


def test_demographics_tell_empty_from_missing(spark, tmp_path):
    text = 'patientunitstayid,gender,age\n1,Male,"> 89"\n2,Female,""\n3,,\n4,Female,45\n'
    df = off.read_stay_demographics(spark, write(tmp_path / "p.csv", text))
    assert rows(df, "patientunitstayid", "gender", "age") == [
        (1, "Male", 95), (2, "Female", 50), (3, None, None), (4, "Female", 45)
    ]


def test_vitals_lose_empty_cells(spark, tmp_path):
    text = "patientunitstayid,observationoffset,b,extra,a\n1,5,2.0,z,1\n1,10,,z,3\n"
    long = off.unpivot_vitals(off.read_vitals(spark, write(tmp_path / "v.csv", text), ["a", "b"]), ["a", "b"])
    assert rows(long, "time", "variable", "value") == [(5, "a", 1.0), (5, "b", 2.0), (10, "a", 3.0)]


def test_events_stage_from_files(spark, tmp_path):
    lines = ["hadm_id,stay_id,subject_id,charttime,itemid,valuenum"]
    for stay, n in ((30, 12), (20, 3), (10, 11)):
        lines += [f"{stay},{stay},1,2150-01-01 {h:02d}:30:00,{220 if h % 2 else 110},{h}" for h in range(n)]
    lines.append("99,99,1,2150-01-01 00:30:00,110,1")  # no admission
    events = ev.read_events(spark, write(tmp_path / "c.csv", "\n".join(lines) + "\n"), "chartevents")
    text = "hadm_id,admittime,deathtime,admission_location\n" + "".join(
        f"{h},2150-01-01 01:00:00,,{place}\n" for h, place in ((10, "ER"), (20, "ER"), (30, "WARD"))
    )
    admissions = ev.read_admissions(spark, write(tmp_path / "a.csv", text))
    patients = ev.read_patients(spark, write(tmp_path / "p.csv", "subject_id,gender,anchor_age,x\n1,F,61,0\n"))
    catalogue = spark.createDataFrame(
        [("never", 5, 0), ("second", 220, 1), ("first", 110, 2)], "label string, itemid long, position int"
    )
    measures, key = stages.measures_from_events(events, admissions, patients, catalogue)
    assert rows(key, "label", "key") == [("first", 1), ("second", 0)]
    assert measures.columns == ["itemid", "value", "deathtime", "time", "ind", "gender", "age"]
    counted = {(r["ind"], r["count"]) for r in measures.groupBy("ind").count().collect()}
    assert counted == {(0, 11), (2, 12)}  # stay 20 is too short and leaves the gap at 1
    first = measures.filter("ind = 0").orderBy("time").first()
    assert (first["time"], first["value"], first["itemid"], first["gender"], first["age"]) == (-30, 0.0, 1, "F", 61)
    only_er, _ = stages.measures_from_events(events, admissions, patients, catalogue, origins=["ER"])
    assert only_er.select("ind").distinct().count() == 1


def test_written_tables_read_back(spark, tmp_path):
    data = spark.createDataFrame(
        [(1, 2.5, 30, 7, "M", 50.0, "helper"), (0, 1.0, 10, 7, None, None, "helper"), (0, 9.0, 5, 8, "F", 40.0, "x")],
        "itemid long, value double, time long, ind long, gender string, age double, hadm string",
    )
    for fmt in ("parquet", "csv"):
        path = wr.write_measures(data, str(tmp_path / fmt), fmt)
        back = read_measures(spark, path, fmt)
        assert rows(back, "ind", "itemid", "time") == [(7, 0, 10.0), (7, 1, 30.0), (8, 0, 5.0)]
        assert "hadm" not in back.columns
    stay = wr.read_stay(spark, str(tmp_path / "parquet"), 8)
    assert stay.count() == 1
    assert "EqualTo(ind,8)" in stay._jdf.queryExecution().executedPlan().toString()

    key = spark.createDataFrame([("a", 0), ("b", 1)], "label string, key long")
    assert rows(read_key(spark, wr.write_key(key, str(tmp_path / "key"))), "label", "key") == [("a", 0), ("b", 1)]

    splits = spark.createDataFrame([(1, 0, "test"), (2, 0, "train")], "ind long, fold int, split string")
    saved = spark.read.parquet(wr.write_splits(splits, str(tmp_path / "splits")))
    assert rows(saved.filter("fold = 0 and split = 'test'"), "ind") == [(1,)]
    assert (tmp_path / "splits" / "fold=0" / "split=train").is_dir()

    scores = spark.createDataFrame([("test", "mae", 0.5)], "set string, metric string, value double")
    assert spark.read.option("header", True).csv(wr.write_metrics(scores, str(tmp_path / "m"))).count() == 1


def test_small_helpers_do_not_depend_on_row_order(spark):
    data = spark.createDataFrame([(9, 5), (3, 1), (9, 2), (4, 4)], "stay long, time long")
    indexed = index_stays(data, "stay")
    assert rows(indexed, "stay", "time", "ind") == [(3, 1, 0), (4, 4, 1), (9, 2, 2), (9, 5, 2)]
    ties = spark.createDataFrame(
        [(1, 0, 5, 2.0), (1, 0, 5, 3.0), (1, 1, 9, 1.0)], "ind long, itemid long, time long, value double"
    )
    assert rows(target_observations(ties, 0), "ind", "tgt_time", "tgt_value") == [(1, 5, 3.0)]
