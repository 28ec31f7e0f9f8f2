"""Event logs: parsing, stage totals, pages in flight, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EVENT_SCHEMA = "ts double, event string, run string, page_index int, stage string, elapsed_seconds double, error string, project_id bigint, pages int, max_workers int"


def parse_events(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (``value``); blank, cut-off and nameless lines are left out."""
    e = lines.where("value is not null and trim(value) <> ''").select(F.from_json("value", EVENT_SCHEMA).alias("e")).select("e.*")
    return e.where("event is not null and event <> ''").withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("bigint")))


def stage_totals(events: DataFrame, stage: str, value: str) -> DataFrame:
    return events.where(F.col(value).isNotNull()).groupBy(stage).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def in_flight(events: DataFrame, key: str, order: list[str], kind: str, started: str, ended: list[str]) -> DataFrame:
    """Keys whose last start has no later end."""
    e = events.where(F.col(kind).isin([started, *ended]))
    last = e.groupBy(key).agg(F.max_by(kind, F.struct(*order)).alias("last_event"), F.max(order[0]).alias("last_at"))
    return last.where(F.col("last_event") == started).select(key, "last_at")


def slowest(events: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Top k by value, ties by key; a heap per partition, no full sort."""
    return events.groupBy(key).agg(F.max(value).alias("slowest")).orderBy(F.desc("slowest"), key).limit(k)


def sessions(events: DataFrame, key: str, at: str, idle_seconds: int) -> DataFrame:
    """Activity runs with no pause longer than ``idle_seconds``."""
    by = W.partitionBy(key).orderBy(at)
    t = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce((t - F.lag(t).over(by) > idle_seconds * 1_000_000).cast("int"), F.lit(1))
    e = events.withColumn("_n", new).withColumn("session", F.sum("_n").over(by.rangeBetween(W.unboundedPreceding, 0)))
    return e.groupBy(key, "session").agg(F.count("*").alias("events"), F.min(at).alias("begins"), F.max(at).alias("ends"))


def workers(cpu: Column, budget_mib: Column, per_page_mib: Column) -> Column:
    return F.greatest(F.lit(1), F.least(cpu, F.floor(budget_mib / per_page_mib)))


def schedule(plans: DataFrame) -> DataFrame:
    """Waves of ``pages`` over ``workers`` at ``seconds`` a page."""
    waves = F.ceil(F.col("pages") / F.col("workers"))
    return plans.withColumn("waves", waves.cast("bigint")).withColumn("estimate", F.col("waves") * F.col("seconds"))
