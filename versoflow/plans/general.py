"""Queries and oracle SQL of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.operators import drift, history, incremental
from versoflow.session import table

LINE = ["page_id", "pair_index"]


def _deliveries(spark: SparkSession, sf_dir: str, name: str, runs: DataFrame, kind: str) -> DataFrame:
    due = incremental.due_records(table(spark, sf_dir, name), runs, ["id"], F.unix_micros("delivered_at"), ["delivered_at"])
    return due.select(F.lit(kind).alias("record_kind"), F.col("id").alias("record_id"), "run_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "sync_runs").select("run_id", F.unix_micros("started_at").alias("upper"), (F.coalesce("state", F.lit("")) == "succeeded").alias("succeeded"))
    return _deliveries(spark, sf_dir, "decisions", runs, "decision").unionByName(_deliveries(spark, sf_dir, "page_confirmations", runs, "page_confirmation"))


P2_FOUND = """
WITH ok AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS k FROM sync_runs WHERE state = 'succeeded'),
d AS (
  SELECT 'decision' AS record_kind, id AS record_id, delivered_at,
         CAST({'a': page_id, 'b': project_id, 'c': page_index, 'd': pair_index, 'e': selected_text, 'f': actor, 'g': evidence_refs, 'h': risk_score, 'i': risk_reasons, 'j': created_at} AS VARCHAR) AS body FROM decisions
  UNION ALL
  SELECT 'page_confirmation', id, delivered_at,
         CAST({'a': page_id, 'b': project_id, 'c': page_index, 'd': kind, 'e': actor, 'f': reason, 'g': ink_ratio, 'h': verification_id, 'i': raster_sha256, 'j': created_at} AS VARCHAR) FROM page_confirmations),
s AS (SELECT d.*, (SELECT min(k) FROM ok WHERE ok.started_at > d.delivered_at) AS k FROM d),
l AS (SELECT record_kind, record_id, k, arg_max(body, delivered_at) AS body FROM s WHERE k IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT *, lag(body) OVER (PARTITION BY record_kind, record_id ORDER BY k) AS was FROM l)
SELECT record_kind, record_id, ok.run_id AS run_id FROM p JOIN ok USING (k) WHERE was IS DISTINCT FROM body
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "export_records"))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = drift.unified(table(spark, sf_dir, "export_records"))
    return u.withColumn("other", F.to_json("other"))


def p3_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.spans(table(spark, sf_dir, "export_records"))


def line_history(raw: DataFrame, runs: DataFrame, attrs: list[str]) -> DataFrame:
    """Versions of each line's accepted text: what the last succeeded run published, with the chains rebuilt that later deliveries touch."""

    def build(changes: DataFrame) -> DataFrame:
        return history.build_chains(history.newest_deliveries(changes, LINE, "id", "delivered_at"), LINE, "created_at", "id", attrs)

    raw = raw.select("id", *LINE, *attrs, "created_at", "delivered_at")
    last = runs.where("state = 'succeeded'").agg(F.max("started_at").alias("t")).first()
    if last is None or last["t"] is None:
        return build(raw)
    late = F.coalesce(F.col("delivered_at") >= F.lit(last["t"]), F.lit(True))
    return history.apply_updates(build(raw.where(~late)), raw, raw.where(late), LINE, build)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions without their texts: a text is compared by two hashes, so that none is shuffled."""
    hashed = lambda f: F.when(F.col("selected_text").isNotNull(), f)
    raw = table(spark, sf_dir, "decisions").withColumn("a", hashed(F.xxhash64("selected_text"))).withColumn("b", hashed(F.xxhash64(F.lit(1), "selected_text")))
    return line_history(raw, table(spark, sf_dir, "sync_runs"), ["a", "b"]).select("page_id", "pair_index", "version_no", F.col("id").alias("decision_id"))


def p5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = line_history(table(spark, sf_dir, "decisions"), table(spark, sf_dir, "sync_runs"), ["selected_text"])
    return h.select("page_id", "pair_index", "version_no", F.col("id").alias("decision_id"), "selected_text", "valid_from", "valid_to")


_CHAIN = """
WITH d AS (SELECT id, page_id, pair_index, arg_max(selected_text, delivered_at) AS selected_text, arg_max(created_at, delivered_at) AS created_at FROM decisions GROUP BY id, page_id, pair_index),
o AS (SELECT *, lag(selected_text) OVER w AS was, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY page_id, pair_index ORDER BY created_at, id)),
v AS (SELECT * FROM o WHERE n = 1 OR was IS DISTINCT FROM selected_text)
SELECT page_id, pair_index, row_number() OVER w AS version_no, id AS decision_id{more} FROM v WINDOW w AS (PARTITION BY page_id, pair_index ORDER BY created_at, id)
"""
P5_FOUND = _CHAIN.format(more="")
P5_HISTORY = _CHAIN.format(more=", selected_text, created_at AS valid_from, lead(created_at) OVER w AS valid_to")

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_unified": p3_unified, "p3_lifespans": p3_lifespans, "p5_found": p5_found, "p5_history": p5_history}
ORACLES = {"p2_found": P2_FOUND, "p5_found": P5_FOUND, "p5_history": P5_HISTORY}
