"""Tables in a shared store: whole replacement, immutable vintages, idempotent upserts by date, compaction.

Paths are any that Spark can write; nothing here touches a local file system.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and Spark is local, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: what follows scans the result, however often it is used."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """The table is df and nothing else; ``by`` names a partition column."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def merge_dates(df: DataFrame, path: str, keys: list[str] | None = None, date: str = "date") -> None:
    """Adds rows to the dates they belong to. Stored rows of a date stay, but those whose keys df has again; without
    keys, rows alike in all columns count once. Running it again changes nothing."""
    rows = df
    if exists(df.sparkSession, path):
        held = read_table(df.sparkSession, path).select(df.columns).join(df.select(date).distinct(), date, "left_semi").select(df.columns)
        rows = (held.join(df.select(keys).distinct(), keys, "left_anti").select(df.columns) if keys else held).unionByName(df)
    upsert_dates(stored(rows if keys else rows.distinct(), "merged"), path, date)  # a table cannot be read while its dates are replaced


def replace_codes(df: DataFrame, path: str, code: str = "code") -> None:
    """The table without its rows of the codes that df holds, and df."""
    held = read_table(df.sparkSession, path).select(df.columns).join(df.select(code).distinct(), code, "left_anti").select(df.columns) if exists(df.sparkSession, path) else df.limit(0)
    replace_table(stored(held.unionByName(df), "codes"), path)


def write_snapshot(df: DataFrame, root: str, date: str) -> bool:
    """Writes df as the snapshot of a date, unless the latest one before has the same rows. Whether it was written."""
    spark = df.sparkSession
    if exists(spark, root):
        dates = [r[0] for r in spark.read.parquet(root).select(F.col("snapshot").cast("string")).distinct().collect()]  # one a snapshot
        before = max((d for d in dates if d <= date), default=None)
        if before and content_hash(spark.read.parquet(root).filter(F.col("snapshot") == before).select(df.columns)) == content_hash(df):
            return False
    df.withColumn("snapshot", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(root)
    return True


def upsert_dates(df: DataFrame, path: str, date: str = "date", dates: list[str] | None = None) -> None:
    """Replaces the dates that df holds, and of ``dates`` also those it doesn't hold; leaves all others. Running it again changes nothing."""
    if dates and exists(df.sparkSession, path):
        kept = {str(r[0]) for r in df.select(date).distinct().collect()}  # a value a day
        for day in dates:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{date}={day}")
            if day not in kept:
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
    dealt = df.repartition(date)  # a file per date
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(date).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-free digest of them."""
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return row[0], str(row[1])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_vintage(df: DataFrame, root: str, partition: str) -> int:
    """Appends df as the partition's next immutable vintage, unless the latest has the same rows. Gives the latest number."""
    spark, number = df.sparkSession, 0
    while exists(spark, f"{root}/{partition}/v{number + 1:03d}"):
        number += 1
    if number and content_hash(spark.read.parquet(f"{root}/{partition}/v{number:03d}")) == content_hash(df):
        return number
    df.write.parquet(f"{root}/{partition}/v{number + 1:03d}")
    return number + 1


def latest_vintages(spark: SparkSession, root: str) -> DataFrame:
    """The rows of each partition's latest vintage, with ``partition`` and ``vintage``."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(root)
    place = r"/([^/]+)/v(\d+)/[^/]+$"
    rows = rows.withColumns({"partition": F.regexp_extract("_metadata.file_path", place, 1), "vintage": F.regexp_extract("_metadata.file_path", place, 2).cast("int")})
    newest = rows.groupBy("partition").agg(F.max("vintage").alias("vintage"))
    return rows.join(newest, ["partition", "vintage"])


def snapshot_asof(dated: DataFrame, date: str, asof: str) -> DataFrame:
    """The rows of the latest date at or before ``asof``."""
    before = dated.filter(F.col(date) <= F.lit(asof).cast("date"))
    return before.join(F.broadcast(before.agg(F.max(date).alias(date))), date)


def compact_month(spark: SparkSession, path: str, month: str, date: str = "date") -> None:
    """Rewrites a month's dates (``yyyy-MM``) into a file each; running it again changes nothing."""
    rows = spark.read.parquet(path).filter(F.date_format(date, "yyyy-MM") == month)
    upsert_dates(stored(rows, "compact"), path, date)  # a table cannot be read while its dates are replaced


def register(spark: SparkSession, tables: dict[str, str]) -> None:
    """A view for each table path."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
