"""Queries over event logs, documents as corpora and metric tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.operators import events, measure
from versoflow.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1")
def event_stage_totals(spark, d):
    return events.stage_totals(table(spark, d, "events"), "event_type", "value").select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("WITH t AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), e AS (SELECT user_id, ts, event_id, event_type FROM events, t WHERE event_type IN (a, b)), l AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last_event, max(ts) AS last_at FROM e GROUP BY 1) SELECT user_id, last_at FROM l WHERE last_event = (SELECT a FROM t)")
def event_in_flight(spark, d):
    e = table(spark, d, "events")
    a, b = e.agg(F.min("event_type"), F.max("event_type")).first()  # two names
    return events.in_flight(e, "user_id", ["ts", "event_id"], "event_type", a, [b])


@query("SELECT user_id, max(value) AS slowest FROM events GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 25")
def event_slowest(spark, d):
    return events.slowest(table(spark, d, "events"), "user_id", "value", 25)


@query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) AS all_events FROM events GROUP BY 1")
def event_pivot(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    p = e.groupBy("day").pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)
    return p.join(e.groupBy("day").agg(F.count("*").alias("all_events")), "day")


@query("SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) AS all_events FROM events GROUP BY 1")
def event_pivot_all(spark, d):
    """``event_pivot`` with a column for each of the five types of events."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    p = e.groupBy("day").pivot("event_type", ["click", "view", "purchase", "signup", "error"]).count().na.fill(0)
    return p.join(e.groupBy("day").agg(F.count("*").alias("all_events")), "day")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("SELECT w AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2")
def event_sliding(spark, d):
    """Windows of an hour every half hour."""
    g = table(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("begins"), "event_type", "n", "total")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 0), 6) AS per_minute, max_by(event_type, (value, event_type)) FILTER (value IS NOT NULL) AS slowest FROM events GROUP BY 1""")
def event_rates(spark, d):
    """Events a minute between the first and the last of each day, and the kind of the greatest value."""
    minutes = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60000000.0
    g = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.to_date("ts").alias("day"))
    return g.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.round(F.count("*") / F.nullif(minutes, F.lit(0.0)), 6).alias("per_minute"), F.max_by("event_type", F.when(F.col("value").isNotNull(), F.struct("value", "event_type"))).alias("slowest"))


@query("""WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 1800 * 1000000 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM a) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS begins, max(ts) AS ends FROM b GROUP BY 1, 2""")
def event_sessions(spark, d):
    return events.sessions(table(spark, d, "events"), "user_id", "ts", 1800)


@query("""WITH s AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), q AS (SELECT *, v - lag(v) OVER (PARTITION BY event_type ORDER BY day) AS dv FROM s WHERE v IS NOT NULL), r AS (SELECT *, sum((dv <= 0)::INT) OVER (PARTITION BY event_type ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS ok FROM q WHERE dv IS NOT NULL)
SELECT event_type, count(*) AS points, count(*) FILTER (ok = 0) AS streak, round(max_by(dv, day), 6) AS last_delta FROM r GROUP BY 1""")
def trend_streak(spark, d):
    s = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return measure.streak(s, ["event_type"], "day", "v").withColumn("last_delta", F.round("last_delta", 6))


@query("""WITH p AS (SELECT project_id, count(DISTINCT id) AS pages FROM book_pages GROUP BY 1), w AS (SELECT *, greatest(1, least(8, 24576 // (6144 + 512 * (project_id % 3)))) AS workers FROM p)
SELECT project_id, pages, CAST(workers AS BIGINT) AS workers, CAST(ceil(pages / workers) AS BIGINT) AS waves, ceil(pages / workers) * 0.3 AS estimate FROM w""")
def schedule_plan(spark, d):
    p = table(spark, d, "book_pages").groupBy("project_id").agg(F.countDistinct("id").alias("pages"))
    w = events.workers(F.lit(8), F.lit(24576), 6144 + 512 * (F.col("project_id") % 3)).cast("bigint")
    return events.schedule(p.withColumn("workers", w).withColumn("seconds", F.lit(0.3))).select("project_id", "pages", "workers", "waves", F.col("estimate").cast("double").alias("estimate"))


@query("""SELECT 'null_text' AS rule, doc_id FROM documents WHERE text IS NULL UNION ALL SELECT 'blank_text', doc_id FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[ \\t\\n\\r]*') UNION ALL SELECT 'no_language', doc_id FROM documents WHERE lang IS NULL
UNION ALL SELECT 'odd_language', doc_id FROM documents WHERE NOT regexp_full_match(lang, '[a-z]{2}') UNION ALL SELECT 'wrong_length', doc_id FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'repeated_text', doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1)""")
def corpus_quality(spark, d):
    t = table(spark, d, "documents")
    rule = lambda name, cond: t.where(cond).select(F.lit(name).alias("rule"), "doc_id")
    # Digests, not texts, are shuffled to find repeated texts.
    h = t.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("h"))
    again = h.join(h.groupBy("h").count().where("count > 1").select("h"), "h").select(F.lit("repeated_text").alias("rule"), "doc_id")
    out = rule("null_text", F.col("text").isNull()).unionByName(rule("blank_text", F.col("text").rlike("^[ \\t\\n\\r]*$") & F.col("text").isNotNull())).unionByName(rule("no_language", F.col("lang").isNull()))
    return out.unionByName(rule("odd_language", ~F.col("lang").rlike("^[a-z]{2}$"))).unionByName(rule("wrong_length", F.col("n_chars") != F.length("text"))).unionByName(again)


@query("SELECT coalesce(lang, '(none)') AS lang, source, count(*) AS documents, count(text) AS with_text, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def corpus_strata(spark, d):
    t = table(spark, d, "documents")
    a, b = F.col("lang"), F.col("source")
    g = t.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.sum(F.length("text")).alias("chars"))
    return g.select(F.coalesce("lang", F.lit("(none)")).alias("lang"), "source", "documents", "with_text", "chars")


@query("""WITH c AS (SELECT doc_id, i AS "at", substr(text, i, 1) AS was FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE regexp_matches(text, '[，。！？；：]'))) SELECT doc_id, CAST(c."at" AS INT) AS place, was, translate(was, '，。！？；：', ',.!?;:') AS becomes FROM c WHERE was IN ('，', '。', '！', '？', '；', '：')""")
def change_log(spark, d):
    t = table(spark, d, "documents").where(F.col("text").rlike("[，。！？；：]"))
    c = t.select("doc_id", F.posexplode(F.split("text", "")).alias("k", "was")).where(F.col("was").isin(*"，。！？；："))
    return c.select("doc_id", (F.col("k") + 1).cast("int").alias("place"), "was", F.translate("was", "，。！？；：", ",.!?;:").alias("becomes"))


@query("""WITH m AS (SELECT l_returnflag, year(l_shipdate) AS y, sum(l_extendedprice * l_discount) / sum(l_extendedprice) AS rate FROM lineitem GROUP BY 1, 2), p AS (SELECT l_returnflag, y + 1 AS y, rate FROM m)
SELECT coalesce(p.l_returnflag, m.l_returnflag) AS l_returnflag, CAST(coalesce(p.y, m.y) AS INT) AS y, round(p.rate, 8) AS old_value, round(m.rate, 8) AS new_value, CASE WHEN p.l_returnflag IS NULL THEN 'new' WHEN m.l_returnflag IS NULL THEN 'missing' WHEN m.rate - p.rate IS NULL THEN 'unavailable' WHEN m.rate - p.rate < -1e-9 THEN 'improved' WHEN m.rate - p.rate > 1e-9 THEN 'regressed' ELSE 'unchanged' END AS status FROM p FULL JOIN m ON m.l_returnflag = p.l_returnflag AND m.y = p.y""")
def metric_regression(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice")).alias("rate"))
    c = measure.compare(m.withColumn("y", F.col("y") + 1), m, ["l_returnflag", "y"], "rate")
    return c.select("l_returnflag", "y", F.round("old_value", 8).alias("old_value"), F.round("new_value", 8).alias("new_value"), "status")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def price_summary(spark, d):
    t = table(spark, d, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT e.event_id, e.user_id, o.o_orderkey AS last_order FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON o.o_custkey = e.user_id AND CAST(o.o_orderdate AS TIMESTAMP) <= CAST(e.ts AS TIMESTAMP)")
def event_order_asof(spark, d):
    """Each event with its user's last order before it: both sides in one order, the last order carried on."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("t"), F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(1).alias("k"))
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    o = o.select(F.lit(None).cast("bigint").alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("t"), "o_orderkey", F.lit(0).alias("k"))
    by = W.partitionBy("user_id").orderBy("t", "k").rowsBetween(W.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("last_order", F.last("o_orderkey", ignorenulls=True).over(by)).where("k = 1").select("event_id", "user_id", "last_order")
