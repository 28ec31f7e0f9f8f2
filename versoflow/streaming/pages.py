"""The event log as a stream: stage totals in windows, the state of pages, journal appends."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from versoflow.operators.events import parse_events

#: A page that is over is forgotten so long after its last event, by the watermark.
FORGET_MS = 24 * 3600 * 1000

PAGE_STATE = "run string, page_index int, state string, seconds double, error string"


def event_stream(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """Events of a folder of JSON lines with a watermark on their time."""
    raw = spark.readStream.schema("value string").text(path)
    return parse_events(raw).withWatermark("at", late)


def stage_windows(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Count and seconds of each stage in tumbling windows; later events than the watermark are dropped."""
    e = events.where("event = 'stage_finished' and elapsed_seconds is not null")
    g = e.groupBy(F.window("at", width).alias("w"), "run", "stage").agg(F.count("*").alias("n"), F.sum("elapsed_seconds").alias("seconds"))
    return g.select(F.col("w.start").alias("begins"), "run", "stage", "n", "seconds")


def page_states(events: DataFrame) -> DataFrame:
    """Each page's state after every batch that touched it: started, finished or failed; the last end wins.

    Pages that are over leave the state ``FORGET_MS`` after their last event; started ones
    stay until they end. ``events`` must carry a watermark on ``at``.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, kind, seconds, error = state.get if state.exists else (-1.0, "", None, None)
        for pdf in batches:
            for r in pdf.sort_values("ts", kind="stable").itertuples():
                if r.ts >= at:
                    fresh = r.event != "page_started"
                    at, kind = float(r.ts), r.event.removeprefix("page_")
                    seconds = (None if pd.isna(r.elapsed_seconds) else float(r.elapsed_seconds)) if fresh else None
                    error = r.error if fresh and isinstance(r.error, str) else None
        state.update((at, kind, seconds, error))
        if kind != "started":
            state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs()) + FORGET_MS)
        yield pd.DataFrame([(key[0], key[1], kind, seconds, error)], columns=["run", "page_index", "state", "seconds", "error"])

    e = events.where("event in ('page_started', 'page_finished', 'page_failed') and page_index is not null and run is not null")
    e = e.select("run", "page_index", "ts", "at", "event", "elapsed_seconds", "error")
    return e.groupBy("run", "page_index").applyInPandasWithState(step, PAGE_STATE, "at double, kind string, seconds double, error string", "update", GroupStateTimeout.EventTimeTimeout)


def journal_sink(path: str, key: list[str], buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends rows whose key the journal lacks, so that a batch played again adds nothing.

    The journal is a folder per bucket of keys (``_bucket``); a batch reads the keys of its
    own buckets and of no others. The buckets' number is fixed when the journal begins.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = fresh
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            hit = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            out = fresh.join(spark.read.parquet(path).where(F.col("_bucket").isin(hit)).select(*key), key, "left_anti")
        out.write.mode("append").partitionBy("_bucket").parquet(path)
        fresh.unpersist()

    return write
