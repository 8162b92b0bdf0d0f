"""Writers of the tables that one stage leaves for the next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irregts.schemas import STAY_ORDER

# Columns of a processed table, in order. The last two columns of
# events without absolute times are absent there.
PROCESSED = ("itemid", "value", "deathtime", "time", "ind", "gender", "age")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


#: Folder beside the data files that tells which stays each file holds; readers skip it.
MANIFEST = "_manifest"
_MANIFEST = "file string, least long, greatest long, rows long"


def write_measures(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Processed or cohort rows without helper columns, laid out by stay.

    Files cover ranges of (stay, time) and are sorted inside, so a long stay spans several files.
    Beside parquet files a manifest is written, a row per file with the stays that it holds
    (file names are relative, so a table may be moved); it reads one column of what was written.
    """
    rows = df.select(*(c for c in PROCESSED if c in df.columns))
    order = ["ind", *STAY_ORDER]
    write_table(rows.repartitionByRange(*order).sortWithinPartitions(*order), path, fmt)
    if fmt == "parquet":
        write_manifest(df.sparkSession, path)
    return path


def write_manifest(spark: SparkSession, path: str) -> None:
    """The manifest of a parquet table that has a column ``ind``."""
    ind = F.col("ind").cast("long")
    stays = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file"))
    ranges = stays.agg(F.min(ind).alias("least"), F.max(ind).alias("greatest"), F.count(F.lit(1)).alias("rows"))
    ranges.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def files_of_stays(spark: SparkSession, path: str, *inds: int) -> list[str] | None:
    """The files that may hold rows of the stays, by the manifest; None without one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    asked = reduce(lambda a, b: a | b, (F.lit(i).between(F.col("least"), F.col("greatest")) for i in sorted(set(inds))), F.lit(False))
    found = spark.read.schema(_MANIFEST).parquet(str(folder)).filter(asked).select("file").collect()
    return sorted(f"{path}/{r['file']}" for r in found)


def read_stay(spark: SparkSession, path: str, *inds: int) -> DataFrame:
    """Rows of the given stays. With a manifest only the files that hold them are opened; the
    filter then reaches their row groups."""
    files = files_of_stays(spark, path, *inds)
    if files is None:
        table = spark.read.parquet(path)
    elif files:
        table = spark.read.parquet(*files)
    else:
        return spark.read.parquet(path).limit(0)
    wanted = F.col("ind") == inds[0] if len(inds) == 1 else F.col("ind").isin(*inds)
    return table.filter(wanted)


def write_key(key: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(key, path, fmt)


def write_labels(labels: DataFrame, path: str, fmt: str = "json") -> str:
    return write_table(labels.select("ind", "label"), path, fmt)


def write_splits(splits: DataFrame, path: str) -> str:
    return write_table(splits.select("ind", "fold", "split"), path, partition_by=("fold", "split"))


def write_predictions(sheet: DataFrame, path: str) -> str:
    return write_table(sheet, path, partition_by=("set", "fold"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ind long, fold int, split string").parquet(path)


def write_metrics(table: DataFrame, path: str, fmt: str = "csv") -> str:
    return write_table(table, path, fmt)
