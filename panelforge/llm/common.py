"""Helpers the text operators share: table access, word splitting, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Separator runs of the "letters, digits and anything beyond ASCII" word rule.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The largest table, in bytes of its text, that is sent whole to every task.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and Spark is local, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null stays null. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters after lower-casing A-Z; null text has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % k, F.lit(0))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, a scan of a table, with a number for each row; every use of it numbers the rows alike, as splits and row order are the table's own."""
    return df.withColumn(name, F.monotonically_increasing_id())


def unite(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
