"""Daily updates as micro-batches: idempotent upserts, catch-up of pending sessions, a publish pointer, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.sources.store import exists, merge_dates, replace_table


def pending(sessions: DataFrame, done: DataFrame, target: str, most: int | None = None, date: str = "date") -> DataFrame:
    """Sessions after the last done one, up to the target, oldest first. A calendar: a row per session."""
    last = done.agg(F.max(date).alias("_last"))
    found = sessions.select(date).distinct().filter(F.col(date) <= F.lit(target).cast("date")).crossJoin(F.broadcast(last))
    found = found.filter(F.col("_last").isNull() | (F.col(date) > F.col("_last"))).select(date).orderBy(date)
    return found.limit(most) if most else found


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], date: str = "date", keys: list[str] | None = None) -> StreamingQuery:
    """Processes all that is there, then ends. Late rows join the stored rows of their date; a repeated batch changes nothing.

    Rows replace stored ones with the same keys; without keys, rows alike in all columns count once.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: merge_dates(transform(batch), path, keys, date)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(spark: SparkSession, pointer: str, session: str, status: str) -> bool:
    """Moves the pointer to the session if its gates passed; a failed session stays written but unpublished."""
    if status == "FAIL":
        return False
    if exists(spark, pointer) and spark.read.parquet(pointer).filter(F.col("session") >= session).count():
        return True
    replace_table(spark.createDataFrame([(session, status)], "session string, status string"), pointer)
    return True


def merge_watermarks(old: DataFrame, new: DataFrame) -> DataFrame:
    """source and the later of both watermarks."""
    return old.unionByName(new).groupBy("source").agg(F.max("watermark").alias("watermark"))


def running_ewma(stream: DataFrame, key: str, time: str, x: str, half_life: float) -> DataFrame:
    """key, time, ewma after each row: s = a x + (1 - a) s, seeded by the first; the state of a key is one number.

    Rows of a key within a batch are taken by time; a later batch continues from the state.
    """
    keep = 0.5 ** (1 / half_life)
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        value = state.get[0] if state.exists else None
        out = []
        for v in rows[x].tolist():
            value = v if value is None else (1 - keep) * v + keep * value
            out.append(value)
        state.update((value,))
        yield pd.DataFrame({key: k[0], time: rows[time], "ewma": out})

    some = stream.select(key, time, x).na.drop()
    return some.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}, ewma double", "value double", "append", "NoTimeout")
