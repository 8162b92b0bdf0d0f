"""Stay-level tables: relative time, stay numbers, stay filters, demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irregts.functions.expr import all_present, whole_minutes
from irregts.operators.layout import global_row_index, join_back, running_sums
from irregts.schemas import STAY_ORDER
from irregts.session import materialise


def join_admissions(events: DataFrame, admissions: DataFrame) -> DataFrame:
    """Events with their admission; events without one vanish."""
    return events.join(admissions, "hadm_id")


def join_patients(events: DataFrame, patients: DataFrame) -> DataFrame:
    return events.join(patients, "subject_id")


def join_stay_demographics(measures: DataFrame, demographics: DataFrame, stay: str = "patientunitstayid") -> DataFrame:
    return measures.join(demographics, stay)


def add_relative_time(df: DataFrame, start: str = "admittime", at: str = "charttime") -> DataFrame:
    """Whole minutes since admission, negative before it."""
    return df.withColumn("time", whole_minutes(F.col(start), F.col(at)))


def stay_sizes(df: DataFrame, stay: str = "ind") -> DataFrame:
    """Number of measures and duration in minutes of each stay."""
    return df.groupBy(stay).agg(
        F.count(F.lit(1)).alias("n_measures"), (F.max("time") - F.min("time")).alias("minutes")
    )


def keep_sizes(
    sizes: DataFrame, min_measures: int | None = None, max_measures: int | None = None, min_hours: float = 0
) -> DataFrame:
    """Stays by number of measures (bounds included) and by duration (strictly longer
    than ``min_hours``; 0 keeps every duration)."""
    if min_measures is not None:
        sizes = sizes.filter(F.col("n_measures") >= min_measures)
    if max_measures is not None:
        sizes = sizes.filter(F.col("n_measures") <= max_measures)
    if min_hours > 0:
        sizes = sizes.filter(F.col("minutes") > min_hours * 60)
    return sizes


def number_stays(stays: DataFrame, stay: str, name: str = "ind") -> DataFrame:
    """Dense 0-based number of each stay in stay id order, for a table with a row per stay."""
    return global_row_index(stays, [stay], name)[0]


def index_stays(df: DataFrame, stay: str, name: str = "ind") -> DataFrame:
    """Add the stay number to every row. Later stay filters leave gaps."""
    return df.join(number_stays(df.select(stay).distinct(), stay, name), stay)


def filter_stays(
    df: DataFrame,
    min_measures: int | None = None,
    max_measures: int | None = None,
    min_hours: float = 0,
    stay: str = "ind",
) -> DataFrame:
    """Rows of the stays that :func:`keep_sizes` keeps."""
    kept = keep_sizes(stay_sizes(df, stay), min_measures, max_measures, min_hours)
    return join_back(df, kept.select(stay), stay, "left_semi")


def restrict_to_stays(df: DataFrame, stays: DataFrame, stay: str = "ind", check: bool = True) -> DataFrame:
    """Rows of the listed stays. With ``check``, no common stay is an error; that evaluates the
    join until a row is found. See :func:`restricted_rows`."""
    kept = join_back(df, stays.select(stay).distinct(), stay, "left_semi")
    if check and kept.isEmpty():
        raise ValueError("none of the given stays occurs in the table")
    return kept


def restricted_rows(df: DataFrame, stays: DataFrame, stay: str = "ind") -> DataFrame:
    """Rows of the listed stays, written. ``df`` is evaluated once; that no stay is common, an
    error, shows in what was written."""
    kept = materialise(restrict_to_stays(df, stays, stay, check=False), "restricted")
    if kept.isEmpty():
        raise ValueError("none of the given stays occurs in the table")
    return kept


def common_stays(left: DataFrame, right: DataFrame, stay: str = "ind") -> DataFrame:
    """Stays present in both tables. Each side is folded to one row per stay first."""
    return left.select(stay).distinct().join(right.select(stay).distinct(), stay, "left_semi")


#: Rows above which a stay is not ranked by one task.
HOT_STAY = 1_000_000


def stay_ordinals(
    df: DataFrame, order: Sequence[str] = STAY_ORDER, stay: str = "ind", name: str = "pos", hot: int = HOT_STAY
) -> DataFrame:
    """Rows numbered from 0 within their stay, in stay order; other columns break ties.

    The rows are written once, and the sizes of stays read from there. Stays of up to ``hot`` rows
    are ranked after an exchange by stay. The rows of the others, of which there cannot be many,
    get their positions from one global order over (stay, order), which many tasks rank.
    """
    rows = materialise(df, "rows")
    sizes = rows.groupBy(stay).agg(F.count(F.lit(1)).alias("_n"))
    large = materialise(sizes.filter(F.col("_n") > hot).select(stay), "hot_stays")
    ties = [c for c in df.columns if c not in (stay, *order)]
    place = F.row_number().over(W.partitionBy(stay).orderBy(*order, *ties)) - 1
    if large.isEmpty():
        return rows.withColumn(name, place.cast("long"))
    usual = rows.join(large, stay, "left_anti").withColumn(name, place.cast("long"))
    placed, _ = global_row_index(rows.join(large, stay, "left_semi"), [stay, *order], "_place")
    first = placed.groupBy(stay).agg(F.min("_place").alias("_first"))
    ranked = join_back(placed, first, stay).select(*df.columns, (F.col("_place") - F.col("_first")).alias(name))
    return usual.unionByName(ranked)


def decimate(df: DataFrame, order: Sequence[str], stride: int = 3) -> DataFrame:
    """Every ``stride``-th row of the declared order, starting with the first."""
    placed, _ = global_row_index(df, order, "_place")
    return placed.filter(F.col("_place") % stride == 0).select(*df.columns)


def decimate_vitals(long: DataFrame, vitals: Sequence[str], stride: int = 3, stay: str = "patientunitstayid") -> DataFrame:
    """:func:`decimate` in the order variable (as listed), stay, time, value."""
    names = F.array(*(F.lit(v) for v in vitals))
    placed = long.select(
        F.array_position(names, F.col("variable")).cast("int").alias("_listed"), stay, "time", "value"
    )
    kept = decimate(placed, ["_listed", stay, "time", "value"], stride)
    return kept.withColumn("variable", F.element_at(names, F.col("_listed"))).select(*long.columns)


def decimate_wide(
    wide: DataFrame, vitals: Sequence[str], stride: int = 3, stay: str = "patientunitstayid", time: str = "time", hot: int = HOT_STAY
) -> DataFrame:
    """:func:`decimate_vitals` of the unpivoted ``wide``, as ``(stay, time, variable, value)``, found by
    counting: only cells that are kept become rows.

    A cell's place in the declared order is the number of present cells of the variables listed
    before, of its variable in lesser stays (prefix sums over a table per stay), and of its variable
    earlier in its stay (running counts over the wide rows, exchanged once, by stay). Cells of one
    stay and time are settled by value among themselves. Rows of a stay above ``hot`` are unpivoted
    and placed by one order of many tasks.
    """
    names = list(vitals)
    doubles = [F.col(v).cast("double").alias(v) for v in names]
    rows = materialise(wide.filter(all_present(stay, time)).select(stay, time, *doubles), "vitals")
    counts = [f"_n{j}" for j in range(len(names))]
    sizes = rows.groupBy(stay).agg(F.count(F.lit(1)).alias("_rows"), *(F.count(v).alias(n) for v, n in zip(names, counts)))
    sizes, totals = running_sums(sizes, [stay], counts)
    starts = {f"_start{j}": F.col(f"_before_{n}") + sum(totals[:j]) for j, n in enumerate(counts)}
    placed = join_back(rows, sizes.withColumns(starts).select(stay, "_rows", *starts), stay)

    upto = W.partitionBy(stay).orderBy(time).rangeBetween(W.unboundedPreceding, W.currentRow)
    peers = W.partitionBy(stay, time)
    usual = placed.filter(F.col("_rows") <= hot).withColumns(
        {"_peers": F.count(F.lit(1)).over(peers)}
        | {f"_first{j}": F.col(f"_start{j}") + F.count(v).over(upto) - F.count(v).over(peers) for j, v in enumerate(names)}
    )

    def cells(df: DataFrame, first: str) -> DataFrame:
        """The present cells, with the place of the first one of their variable, stay and time."""
        each = [
            F.struct(F.lit(j).alias("_listed"), F.lit(v).alias("variable"), F.col(v).alias("value"), F.col(f"{first}{j}").alias("_first"))
            for j, v in enumerate(names)
        ]
        present = F.filter(F.array(*each), lambda cell: cell["value"].isNotNull())
        return df.select(stay, time, F.explode(present).alias("_cell")).select(stay, time, "_cell.*")

    def kept(df: DataFrame, place: Column) -> DataFrame:
        return df.filter(place % stride == 0).select(stay, time, "variable", "value")

    single = kept(cells(usual.filter("_peers = 1"), "_first"), F.col("_first"))
    among = F.row_number().over(W.partitionBy(stay, time, "_listed").orderBy("value")) - 1
    tied = cells(usual.filter("_peers > 1"), "_first").withColumn("_among", among)
    found = single.unionByName(kept(tied, F.col("_first") + F.col("_among")))
    large = materialise(sizes.filter(F.col("_rows") > hot).select(stay), "hot_stays")
    if large.isEmpty():
        return found
    placed, _ = global_row_index(cells(placed.filter(F.col("_rows") > hot), "_start"), ["_listed", stay, time, "value"], "_place")
    least = placed.groupBy("_listed", stay).agg(F.min("_place").alias("_least"))
    inside = join_back(placed, least, ["_listed", stay])
    return found.unionByName(kept(inside, F.col("_first") + F.col("_place") - F.col("_least")))


def dataset_report(df: DataFrame) -> DataFrame:
    """Number of rows, stays and variables. Rows fold to pairs before anything distinct."""
    pairs = df.groupBy("ind", "itemid").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        F.sum("_n").alias("n_rows"),
        F.count_distinct("ind").alias("n_stays"),
        F.count_distinct("itemid").alias("n_variables"),
    )
