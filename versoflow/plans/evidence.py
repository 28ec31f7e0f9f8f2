"""Queries over the evidence store and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.functions import geometry as gm
from versoflow.functions import labels as lb
from versoflow.functions import text as tx
from versoflow.operators import align, evaluate, journal, measure, risk, structure
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


# ---------------------------------------------------------------- shared inputs

_DEC = "dec AS (SELECT id, arg_max(page_id, delivered_at) AS page_id, arg_max(project_id, delivered_at) AS project_id, arg_max(page_index, delivered_at) AS page_index, arg_max(pair_index, delivered_at) AS pair_index, arg_max(selected_text, delivered_at) AS selected_text, arg_max(actor, delivered_at) AS actor, arg_max(evidence_refs, delivered_at) AS evidence_refs, arg_max(risk_score, delivered_at) FILTER (risk_score IS NOT NULL) AS any_risk, max_by(created_at, delivered_at) AS created_at FROM decisions GROUP BY id)"
_LIN = "lin AS (SELECT DISTINCT * FROM ocr_lines)"
_RUN = "run AS (SELECT DISTINCT * FROM engine_runs)"
_PAG = "pag AS (SELECT DISTINCT * FROM book_pages)"
_ALI = "ali AS (SELECT DISTINCT * FROM alignments)"
_LP = "lp AS (SELECT l.*, r.page_id, p.page_index FROM lin l JOIN run r ON r.id = l.run_id JOIN pag p ON p.id = r.page_id)"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return journal.once(table(spark, d, "decisions"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines").distinct()


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "engine_runs").distinct()


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "book_pages").distinct()


def alignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "alignments").distinct()


def placed_lines(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select(F.col("id").alias("run_id"), "page_id", "engine", "scope")
    p = pages(spark, d).select(F.col("id").alias("page_id"), "page_index")
    return lines(spark, d).join(r, "run_id").join(p, "page_id")


def pair_texts(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, pair_index, side, text, confidence, x0, y0, x1, y1`` of every side of every pair."""
    a = alignments(spark, d)
    m = journal.members(a, "primary").withColumn("side", F.lit("primary")).unionByName(journal.members(a, "secondary").withColumn("side", F.lit("secondary")))
    j = m.join(lines(spark, d), ["run_id", "line_index"])
    g = j.groupBy("page_id", "pair_index", "side").agg(
        F.sort_array(F.collect_list(F.struct("member_index", "text"))).alias("_t"), F.min("confidence").alias("confidence"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"),
    )
    return g.select("page_id", "pair_index", "side", tx.assemble(F.transform("_t", lambda s: s["text"])).alias("text"), "confidence", "x0", "y0", "x1", "y1")


def two_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of every pair in one row, by one aggregation: ``p_`` and ``s_`` columns as of ``pair_texts``."""
    a = alignments(spark, d)
    m = journal.members(a, "primary").withColumn("side", F.lit("p")).unionByName(journal.members(a, "secondary").withColumn("side", F.lit("s")))
    j = m.join(lines(spark, d), ["run_id", "line_index"])
    aggs = []
    for p in ("p", "s"):
        of = lambda c: F.when(F.col("side") == p, c)  # noqa: B023, E731
        aggs += [
            F.sort_array(F.collect_list(of(F.struct("member_index", "text")))).alias(f"{p}_t"), F.min(of(F.col("confidence"))).alias(f"{p}_confidence"), F.min(of(F.col("x"))).alias(f"{p}_x0"), F.min(of(F.col("y"))).alias(f"{p}_y0"),
            F.max(of(F.col("x") + F.col("width"))).alias(f"{p}_x1"), F.max(of(F.col("y") + F.col("height"))).alias(f"{p}_y1"),
        ]
    g = j.groupBy("page_id", "pair_index").agg(*aggs)
    for p in ("p", "s"):
        g = g.withColumn(f"{p}_text", F.when(F.size(f"{p}_t") > 0, tx.assemble(F.transform(f"{p}_t", lambda x: x["text"]))))
    return g.select("page_id", "pair_index", *[f"{p}_{c}" for p in ("p", "s") for c in ("text", "confidence", "x0", "y0", "x1", "y1")])


_SIDES = f"""{_LIN}, {_ALI},
mem AS (
  SELECT page_id, pair_index, 'primary' AS side, primary_run_id AS run_id, unnest(primary_members) AS line_index, generate_subscripts(primary_members, 1) AS k FROM ali
  UNION ALL SELECT page_id, pair_index, 'secondary', secondary_run_id, unnest(secondary_members), generate_subscripts(secondary_members, 1) FROM ali),
tex AS (SELECT page_id, pair_index, side, list(l.text ORDER BY k) AS ts, min(confidence) AS confidence, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + height) AS y1 FROM mem JOIN lin l ON l.run_id = mem.run_id AND l.line_index = mem.line_index GROUP BY 1, 2, 3),
sid AS (SELECT page_id, pair_index, side, list_reduce(ts, lambda a, b: a || CASE WHEN regexp_matches(right(a, 1), '[0-9A-Za-zÀ-ÖØ-öø-ÿ]') AND regexp_matches(left(b, 1), '[0-9A-Za-zÀ-ÖØ-öø-ÿ]') AND (regexp_matches(right(a, 1), '[A-Za-zÀ-ÖØ-öø-ÿ]') OR regexp_matches(left(b, 1), '[A-Za-zÀ-ÖØ-öø-ÿ]')) THEN ' ' ELSE '' END || b) AS text, confidence, x0, y0, x1, y1 FROM tex)"""

# ---------------------------------------------------------------- journal and lookups


@query(f"WITH {_DEC} SELECT page_id, pair_index, max(id) AS decision_id, max_by(actor, id) AS actor, max_by(selected_text, id) AS selected_text FROM dec GROUP BY 1, 2")
def journal_latest(spark, d):
    n = journal.newest(decisions(spark, d).select("id", "page_id", "pair_index", "actor", "selected_text"), ["page_id", "pair_index"])
    return n.select("page_id", "pair_index", F.col("id").alias("decision_id"), "actor", "selected_text")


@query(f"WITH {_DEC} SELECT id, page_id, pair_index, lag(id) OVER w AS previous_id, max(id) OVER (PARTITION BY page_id, pair_index) AS latest_id, left(selected_text, 320) AS preview, length(selected_text) > 320 AS truncated FROM dec WINDOW w AS (PARTITION BY page_id, pair_index ORDER BY id)")
def journal_history(spark, d):
    return journal.history(decisions(spark, d))


@query(f"WITH {_DEC}, b AS (SELECT * FROM dec WHERE created_at < TIMESTAMPTZ '2025-04-01 00:00:00+00') SELECT page_id, pair_index, max(id) AS decision_id, max_by(actor, id) AS actor FROM b GROUP BY 1, 2")
def journal_bounded_snapshot(spark, d):
    n = decisions(spark, d).where("created_at < timestamp '2025-04-01 00:00:00'")
    return n.groupBy("page_id", "pair_index").agg(F.max("id").alias("decision_id"), F.max_by("actor", "id").alias("actor"))


@query(f"""WITH {_DEC}, {_ALI}, lv AS (SELECT page_id, max(verification_run_id) AS latest_verification FROM ali GROUP BY 1),
n AS (SELECT page_id, pair_index, max(id) AS decision_id, max_by(evidence_refs, id) AS refs FROM dec GROUP BY 1, 2),
c AS (SELECT *, list_filter(refs, lambda r: regexp_full_match(r, 'verification_run:[1-9][0-9]*')) AS hits FROM n),
k AS (SELECT *, CASE WHEN len(hits) = 1 THEN CAST(string_split(hits[1], ':')[2] AS BIGINT) END AS cited FROM c)
SELECT k.page_id, pair_index, decision_id, cited, latest_verification, CASE WHEN cited IS NULL THEN 'unverified' WHEN cited = latest_verification THEN 'current' ELSE 'historical' END AS binding FROM k LEFT JOIN lv ON lv.page_id = k.page_id""")
def decision_bindings(spark, d):
    return journal.bindings(decisions(spark, d), alignments(spark, d))


@query(f"WITH {_RUN} SELECT page_id, engine, max(id) AS run_id FROM run WHERE scope IS NULL GROUP BY 1, 2")
def latest_engine_run(spark, d):
    return journal.latest_engine_run(runs(spark, d))


@query(f"WITH {_RUN} SELECT page_id, scope, count(*) AS attempts, list(id ORDER BY id) AS run_ids FROM run WHERE scope IS NOT NULL GROUP BY 1, 2")
def scoped_attempts(spark, d):
    return runs(spark, d).where("scope is not null").groupBy("page_id", "scope").agg(F.count("*").alias("attempts"), F.sort_array(F.collect_list("id")).alias("run_ids"))


@query(f"""WITH {_PAG}, {_RUN}, {_ALI}, r AS (SELECT page_id, count(*) AS runs FROM run GROUP BY 1), v AS (SELECT page_id, max(verification_run_id) AS verification FROM ali GROUP BY 1)
SELECT pag.id AS page_id, project_id, page_index, coalesce(runs, 0) AS runs, verification FROM pag LEFT JOIN r ON r.page_id = pag.id LEFT JOIN v ON v.page_id = pag.id""")
def page_run_summary(spark, d):
    r = runs(spark, d).groupBy("page_id").agg(F.count("*").alias("runs"))
    v = alignments(spark, d).groupBy("page_id").agg(F.max("verification_run_id").alias("verification"))
    p = pages(spark, d).select(F.col("id").alias("page_id"), "project_id", "page_index")
    return p.join(r, "page_id", "left").join(v, "page_id", "left").select("page_id", "project_id", "page_index", F.coalesce("runs", F.lit(0)).alias("runs"), "verification")


@query(f"WITH {_LIN} SELECT id, run_id, text FROM lin WHERE instr(text, 'garden') > 0 ORDER BY id DESC LIMIT 51")
def evidence_search(spark, d):
    return journal.search(lines(spark, d).select("id", "run_id", "text"), "text", "garden", 50)


@query("SELECT doc_id, substr(text, greatest(1, instr(text, 'garden') - 33), 72) AS excerpt, instr(text, 'garden') AS at FROM documents WHERE instr(text, 'garden') > 0")
def search_excerpt(spark, d):
    t = table(spark, d, "documents").where(F.instr("text", "garden") > 0)
    return t.select("doc_id", tx.excerpt(F.col("text"), "garden").alias("excerpt"), F.instr("text", "garden").alias("at"))


@query(f"""WITH {_DEC}, {_ALI}, {_PAG}, n AS (SELECT page_id, pair_index, max_by(actor, id) AS actor FROM dec GROUP BY 1, 2), a AS (SELECT DISTINCT page_id, pair_index FROM ali)
SELECT project_id, count(*) AS pairs, count(*) FILTER (actor = 'automatic') AS automatic, count(*) FILTER (actor = 'vlm') AS vlm, count(*) FILTER (actor = 'human') AS human, count(*) FILTER (actor IS NULL) AS open
FROM a LEFT JOIN n USING (page_id, pair_index) JOIN pag ON pag.id = page_id GROUP BY 1""")
def actor_progress(spark, d):
    n = journal.newest(decisions(spark, d).select("id", "page_id", "pair_index", "actor"), ["page_id", "pair_index"]).drop("id")
    a = alignments(spark, d).select("page_id", "pair_index").distinct().join(n, ["page_id", "pair_index"], "left").join(pages(spark, d).select(F.col("id").alias("page_id"), "project_id"), "page_id")
    is_ = lambda x: F.count_if(F.col("actor") == x)
    return a.groupBy("project_id").agg(F.count("*").alias("pairs"), is_("automatic").alias("automatic"), is_("vlm").alias("vlm"), is_("human").alias("human"), F.count_if(F.col("actor").isNull()).alias("open"))


@query(f"WITH {_DEC}, {_ALI} SELECT DISTINCT page_id, pair_index FROM ali WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.page_id = ali.page_id AND dec.pair_index = ali.pair_index)")
def open_pairs(spark, d):
    return alignments(spark, d).select("page_id", "pair_index").distinct().join(table(spark, d, "decisions"), ["page_id", "pair_index"], "left_anti")


@query("SELECT DISTINCT verification_run_id, pair_index FROM vlm_reviews")
def reviewed_pairs(spark, d):
    return table(spark, d, "vlm_reviews").select("verification_run_id", "pair_index").distinct()


@query(f"""WITH {_ALI}, {_LIN}, m AS (SELECT verification_run_id, page_id, pair_index, primary_run_id AS run_id, unnest(primary_members) AS line_index FROM ali)
SELECT verification_run_id, page_id, pair_index, count(*) AS members, count(l.id) AS lines_found, min(l.confidence) AS min_confidence FROM m LEFT JOIN lin l ON l.run_id = m.run_id AND l.line_index = m.line_index GROUP BY 1, 2, 3""")
def line_members(spark, d):
    m = journal.members(alignments(spark, d), "primary").join(lines(spark, d).select("run_id", "line_index", "id", "confidence"), ["run_id", "line_index"], "left")
    return m.groupBy("verification_run_id", "page_id", "pair_index").agg(F.count("*").alias("members"), F.count("id").alias("lines_found"), F.min("confidence").alias("min_confidence"))


@query("""WITH c AS (SELECT DISTINCT * FROM page_confirmations), n AS (SELECT page_id, max(id) AS id FROM c GROUP BY 1)
SELECT n.page_id, n.id AS confirmation_id, max_by(kind, delivered_at) AS kind, max_by(actor, delivered_at) AS actor FROM n JOIN c ON c.id = n.id GROUP BY 1, 2""")
def latest_confirmation(spark, d):
    n = journal.newest(journal.once(table(spark, d, "page_confirmations")).select("id", "page_id", "kind", "actor"), ["page_id"])
    return n.select("page_id", F.col("id").alias("confirmation_id"), "kind", "actor")


@query(f"WITH {_PAG}, {_RUN}, {_LIN} SELECT id AS page_id, project_id, page_index FROM pag WHERE id NOT IN (SELECT r.page_id FROM run r JOIN lin l ON l.run_id = r.id)")
def textless_pages(spark, d):
    have = runs(spark, d).select(F.col("id").alias("run_id"), F.col("page_id").alias("id")).join(lines(spark, d).select("run_id"), "run_id", "left_semi")
    return pages(spark, d).join(have, "id", "left_anti").select(F.col("id").alias("page_id"), "project_id", "page_index")


@query(f"""WITH {_PAG}, {_RUN}, {_LIN}, {_ALI}, mem AS (
  SELECT verification_run_id, pair_index, primary_run_id AS run_id, unnest(primary_members) AS line_index FROM ali UNION ALL SELECT verification_run_id, pair_index, secondary_run_id, unnest(secondary_members) FROM ali)
SELECT 'run_without_page' AS code, id AS subject FROM run WHERE page_id NOT IN (SELECT id FROM pag)
UNION ALL SELECT 'line_without_run', id FROM lin WHERE run_id NOT IN (SELECT id FROM run)
UNION ALL SELECT 'decision_without_page', id FROM (SELECT DISTINCT id, page_id FROM decisions) WHERE page_id NOT IN (SELECT id FROM pag)
UNION ALL SELECT 'line_in_two_pairs', verification_run_id FROM (SELECT verification_run_id, run_id, line_index FROM mem GROUP BY 1, 2, 3 HAVING count(DISTINCT pair_index) > 1)
UNION ALL SELECT 'half_recorded_asset', id FROM pag WHERE (page_asset_sha256 IS NULL)::INT + (page_asset_byte_size IS NULL)::INT + (page_asset_parameters_json IS NULL)::INT + (page_asset_version IS NULL)::INT BETWEEN 1 AND 3""")
def store_audit(spark, d):
    return journal.audit(pages(spark, d), runs(spark, d), lines(spark, d), alignments(spark, d), table(spark, d, "decisions").select("id", "page_id").distinct())


# ---------------------------------------------------------------- text


@query(f"WITH {_LIN} SELECT run_id, count(*) AS lines, count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]')) AS anomalies FROM lin GROUP BY 1")
def unicode_anomalies(spark, d):
    return lines(spark, d).groupBy("run_id").agg(F.count("*").alias("lines"), F.count_if(tx.has_anomaly("text")).alias("anomalies"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\n+', ''), '\\n+$', '') AS scored FROM documents")
def scoring_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.scoring_text(F.col("text")).alias("scored"))


@query("SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '[!-/:-@\\[-`{-~，。！？；：、“”‘’「」『』…—–]', '', 'g')) AS bare FROM documents")
def punctuation_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"), F.length(tx.without_punctuation(F.col("text"))).alias("bare"))


@query("SELECT id, lower(translate(text, '，。！？；：（）［］', ',.!?;:()[]')) AS folded FROM (SELECT DISTINCT id, text FROM vlm_reviews)")
def width_fold(spark, d):
    return table(spark, d, "vlm_reviews").select("id", "text").distinct().select("id", tx.fold_width(F.col("text")).alias("folded"))


@query("""SELECT id, regexp_replace(regexp_replace(regexp_replace(source_uri || ' bearer ab.' || source_sha256 || ' token=' || id, '/(?:home|Users)/[^/ ]+', '~', 'g'), '(?i)bearer [A-Za-z0-9._-]+', 'bearer ***', 'g'), '(?i)(token|secret|password|api_key)=[^ &]+', '\\1=***', 'g') AS shown FROM (SELECT DISTINCT * FROM projects)""")
def redact_secrets(spark, d):
    p = table(spark, d, "projects").distinct()
    return p.select("id", tx.redact(F.concat("source_uri", F.lit(" bearer ab."), "source_sha256", F.lit(" token="), F.col("id").cast("string"))).alias("shown"))


@query(f"WITH {_SIDES} SELECT page_id, pair_index, side, text FROM sid WHERE (page_id, pair_index, side) IN (SELECT (page_id, pair_index, side) FROM tex WHERE len(ts) > 1)")
def assembled_groups(spark, d):
    a = alignments(spark, d)
    m = journal.members(a, "primary").withColumn("side", F.lit("primary")).unionByName(journal.members(a, "secondary").withColumn("side", F.lit("secondary")))
    g = m.join(lines(spark, d), ["run_id", "line_index"]).groupBy("page_id", "pair_index", "side").agg(F.sort_array(F.collect_list(F.struct("member_index", "text"))).alias("t")).where("size(t) > 1")
    return g.select("page_id", "pair_index", "side", tx.assemble(F.transform("t", lambda s: s["text"])).alias("text"))


@query(f"WITH {_LIN} SELECT project_id, count(*) AS lines, count(*) FILTER (regexp_matches(rtrim(text), '[。！？；：…!?;:.][”’」』）】》〉〕］\"'')\\]]*$')) AS sentence_ends FROM lin GROUP BY 1")
def sentence_ends(spark, d):
    return lines(spark, d).groupBy("project_id").agg(F.count("*").alias("lines"), F.count_if(tx.ends_sentence(F.col("text"))).alias("sentence_ends"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, n - 1 AS line_no, regexp_extract(line, '^(.{2,60}?)(?:[ .…·]{2,})([0-9]{1,4}|[ivxlc]{1,8})$', 1) AS title, regexp_extract(line, '^(.{2,60}?)(?:[ .…·]{2,})([0-9]{1,4}|[ivxlc]{1,8})$', 2) AS label FROM l WHERE regexp_matches(line, '^(.{2,60}?)(?:[ .…·]{2,})([0-9]{1,4}|[ivxlc]{1,8})$')""")
def contents_entries(spark, d):
    ls = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(lb.CONTENTS_LINE))
    return ls.select("doc_id", "line_no", F.regexp_extract("line", lb.CONTENTS_LINE, 1).alias("title"), F.regexp_extract("line", lb.CONTENTS_LINE, 2).alias("label"))


# ---------------------------------------------------------------- geometry


@query(f"WITH {_SIDES} SELECT page_id, pair_index, side, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height FROM sid")
def union_boxes(spark, d):
    t = pair_texts(spark, d)
    r = lambda c: F.round(c, 6)
    return t.select("page_id", "pair_index", "side", r(F.col("x0")).alias("x"), r(F.col("y0")).alias("y"), r(F.col("x1") - F.col("x0")).alias("width"), r(F.col("y1") - F.col("y0")).alias("height"))


@query(f"""WITH {_LIN} SELECT run_id, count(*) AS lines, CASE WHEN count(*) >= 3 AND count(*) FILTER (height >= 1.6 * width) >= 0.6 * count(*)
 THEN CASE WHEN min_by(x, line_index) FILTER (height >= 1.6 * width) >= max_by(x, line_index) FILTER (height >= 1.6 * width) THEN 'vertical-rl' ELSE 'vertical-lr' END ELSE 'horizontal-lr' END AS direction FROM lin GROUP BY 1""")
def page_directions(spark, d):
    tall = F.col("height") >= 1.6 * F.col("width")
    at = F.when(tall, F.col("line_index"))
    first, last = F.min_by("x", at), F.max_by("x", at)
    way = F.when((F.count("*") >= 3) & (F.count_if(tall) >= 0.6 * F.count("*")), F.when(first >= last, "vertical-rl").otherwise("vertical-lr")).otherwise("horizontal-lr")
    return lines(spark, d).groupBy("run_id").agg(F.count("*").alias("lines"), way.alias("direction"))


@query(f"""WITH {_SIDES}, p AS (SELECT * FROM sid WHERE side = 'primary'), s AS (SELECT * FROM sid WHERE side = 'secondary'),
b AS (SELECT p.page_id, p.pair_index, greatest(0.0, least(p.x1, s.x1) - greatest(p.x0, s.x0)) * greatest(0.0, least(p.y1, s.y1) - greatest(p.y0, s.y0)) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) AS a FROM p JOIN s ON s.page_id = p.page_id AND s.pair_index = p.pair_index)
SELECT page_id, pair_index, round(CASE WHEN a - i > 0 THEN least(1.0, i / (a - i)) ELSE 0.0 END, 5) AS iou FROM b""")
def pair_iou(spark, d):
    t = two_sides(spark, d).where("p_text is not null and s_text is not null")
    c = F.col
    v = gm.iou(c("p_x0"), c("p_y0"), c("p_x1") - c("p_x0"), c("p_y1") - c("p_y0"), c("s_x0"), c("s_y0"), c("s_x1") - c("s_x0"), c("s_y1") - c("s_y0"))
    return t.select("page_id", "pair_index", F.round(v, 5).alias("iou"))


@query(f"""WITH {_SIDES}, {_PAG} SELECT sid.page_id, pair_index, CAST(greatest(0, floor((x0 - 0.01) * pag.width + 1e-9)) AS BIGINT) AS left_px, CAST(greatest(0, floor((y0 - 0.01) * pag.height + 1e-9)) AS BIGINT) AS top_px,
 CAST(least(pag.width, ceil((x0 + (x1 - x0) + 0.01) * pag.width - 1e-9)) AS BIGINT) AS right_px, CAST(least(pag.height, ceil((y0 + (y1 - y0) + 0.01) * pag.height - 1e-9)) AS BIGINT) AS bottom_px, printf('page-%06d-pair-%04d.png', page_index, pair_index) AS name
 FROM sid JOIN pag ON pag.id = sid.page_id WHERE side = 'primary'""")
def crop_plan(spark, d):
    p = pages(spark, d).select(F.col("id").alias("page_id"), "page_index", F.col("width").alias("pw"), F.col("height").alias("ph"))
    t = pair_texts(spark, d).where("side = 'primary'").join(p, "page_id")
    left, right = gm.pixels(F.col("x0"), F.col("x1") - F.col("x0"), F.col("pw"))
    top, bottom = gm.pixels(F.col("y0"), F.col("y1") - F.col("y0"), F.col("ph"))
    return t.select("page_id", "pair_index", left.alias("left_px"), top.alias("top_px"), right.alias("right_px"), bottom.alias("bottom_px"), F.format_string("page-%06d-pair-%04d.png", "page_index", "pair_index").alias("name"))


@query(f"""WITH {_LIN}, v AS (SELECT run_id, sum(height) > sum(width) AS up FROM lin GROUP BY 1)
SELECT l.id, row_number() OVER (PARTITION BY l.run_id ORDER BY CASE WHEN up THEN -(x + width) ELSE y END, CASE WHEN up THEN y ELSE x END, line_index, l.id) AS place FROM lin l JOIN v ON v.run_id = l.run_id""")
def reading_order(spark, d):
    up = F.sum("height").over(W.partitionBy("run_id")) > F.sum("width").over(W.partitionBy("run_id"))
    l = lines(spark, d).withColumn("up", up)  # noqa: E741
    k1 = F.when(F.col("up"), -(F.col("x") + F.col("width"))).otherwise(F.col("y"))
    l = l.withColumn("k1", k1).withColumn("k2", F.when(F.col("up"), F.col("y")).otherwise(F.col("x")))  # noqa: E741
    return l.select("id", F.row_number().over(W.partitionBy("run_id").orderBy("k1", "k2", "line_index", "id")).alias("place"))


# ---------------------------------------------------------------- comparison, votes, measures

_RISK = f"""WITH {_SIDES}, t AS (SELECT coalesce(p.page_id, s.page_id) AS page_id, coalesce(p.pair_index, s.pair_index) AS pair_index, coalesce(p.text, '') AS p, coalesce(s.text, '') AS s, least(p.confidence, s.confidence) AS c, abs((p.y0 + p.y1) / 2 - (s.y0 + s.y1) / 2) AS shift
 FROM (SELECT * FROM sid WHERE side = 'primary') p FULL JOIN (SELECT * FROM sid WHERE side = 'secondary') s ON s.page_id = p.page_id AND s.pair_index = p.pair_index),
f AS (SELECT *, lower(translate(p, '，。！？；：（）［］', ',.!?;:()[]')) AS fp, lower(translate(s, '，。！？；：（）［］', ',.!?;:()[]')) AS fs FROM t),
b AS (SELECT *, regexp_replace(regexp_replace(fp, '[!-/:-@\\[-`{{-~，。！？；：、“”‘’「」『』…—–]', '', 'g'), '\\s+', '', 'g') AS bp, regexp_replace(regexp_replace(fs, '[!-/:-@\\[-`{{-~，。！？；：、“”‘’「」『』…—–]', '', 'g'), '\\s+', '', 'g') AS bs, (p = '') <> (s = '') AS one FROM f),
r AS (SELECT page_id, pair_index, [CASE WHEN p <> s AND fp = fs THEN 'variant' END, CASE WHEN NOT one AND bp <> bs THEN 'text_conflict' END, CASE WHEN NOT one AND fp <> fs AND bp = bs THEN 'punctuation_conflict' END, CASE WHEN one THEN 'missing_line' END, CASE WHEN c < 0.8 THEN 'low_confidence' END,
 CASE WHEN regexp_matches(p || s, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]') THEN 'unicode_anomaly' END, CASE WHEN shift > 0.04 THEN 'spatial_mismatch' END] AS q FROM b),
n AS (SELECT page_id, pair_index, list_filter(q, lambda x: x IS NOT NULL) AS reasons FROM r),
z AS (SELECT *, least(1.0, CASE WHEN list_contains(reasons, 'variant') THEN 0.10 ELSE 0 END + CASE WHEN list_contains(reasons, 'text_conflict') THEN 0.45 ELSE 0 END + CASE WHEN list_contains(reasons, 'punctuation_conflict') THEN 0.20 ELSE 0 END + CASE WHEN list_contains(reasons, 'missing_line') THEN 0.55 ELSE 0 END + CASE WHEN list_contains(reasons, 'low_confidence') THEN 0.25 ELSE 0 END + CASE WHEN list_contains(reasons, 'unicode_anomaly') THEN 0.35 ELSE 0 END + CASE WHEN list_contains(reasons, 'spatial_mismatch') THEN 0.15 ELSE 0 END) AS score FROM n)
"""


def risks(spark, d) -> DataFrame:
    t = two_sides(spark, d)
    shift = F.abs((F.col("p_y0") + F.col("p_y1")) / 2 - (F.col("s_y0") + F.col("s_y1")) / 2)
    t = t.select("page_id", "pair_index", F.col("p_text").alias("primary_text"), F.col("s_text").alias("secondary_text"), F.least("p_confidence", "s_confidence").alias("min_confidence"), shift.alias("shift"))
    return risk.assess(t)


@query(_RISK + "SELECT page_id, pair_index, round(score, 6) AS score, array_to_string(reasons, '+') AS reasons FROM z")
def risk_score(spark, d):
    return risks(spark, d).select("page_id", "pair_index", F.round("score", 6).alias("score"), F.array_join("reasons", "+").alias("reasons"))


@query(_RISK + ", h AS (SELECT least(9, CAST(floor(score * 10 + 1e-9) AS INT)) AS bucket, count(*) AS n FROM z GROUP BY 1) SELECT g.bucket, coalesce(n, 0) AS pairs FROM (SELECT unnest(range(10))::INT AS bucket) g LEFT JOIN h ON h.bucket = g.bucket")
def risk_histogram(spark, d):
    h = risks(spark, d).groupBy(F.least(F.lit(9), F.floor(F.col("score") * 10 + 1e-9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bucket")).join(h, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("pairs"))


@query(_RISK + ", e AS (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['(none)'] ELSE reasons END) AS reason, score FROM z) SELECT reason, count(*) AS pairs, round(avg(score), 6) AS mean_score FROM e GROUP BY 1")
def reason_strata(spark, d):
    e = risks(spark, d).withColumn("reason", F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("(none)"))).otherwise(F.col("reasons"))))
    return e.groupBy("reason").agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


_READ = f"""{_SIDES}, rd AS (SELECT page_id, pair_index, side AS source, lower(translate(text, '，。！？；：（）［］', ',.!?;:()[]')) AS fold, text FROM sid
 UNION ALL SELECT page_id, pair_index, 'vlm', lower(translate(text, '，。！？；：（）［］', ',.!?;:()[]')), text FROM (SELECT DISTINCT id, page_id, pair_index, text, uncertain FROM vlm_reviews) WHERE NOT uncertain)"""


@query(f"""WITH {_READ}, f AS (SELECT page_id, pair_index, fold, count(DISTINCT source) AS n, min(text) AS text FROM rd WHERE fold <> '' GROUP BY 1, 2, 3), s AS (SELECT page_id, pair_index, count(DISTINCT source) AS sources FROM rd WHERE fold <> '' GROUP BY 1, 2),
g AS (SELECT page_id, pair_index, max(n) AS top, count(*) AS forms, max_by(text, (n, fold)) AS text FROM f GROUP BY 1, 2), t AS (SELECT f.page_id, f.pair_index, count(*) AS ties FROM f JOIN g ON g.page_id = f.page_id AND g.pair_index = f.pair_index AND g.top = f.n GROUP BY 1, 2),
o AS (SELECT g.*, ties, sources, CASE WHEN sources < 2 THEN 'single_reader' WHEN ties > 1 THEN 'tie' WHEN forms = 1 THEN 'unanimous' ELSE 'majority' END AS rationale FROM g JOIN t USING (page_id, pair_index) JOIN s USING (page_id, pair_index))
SELECT page_id, pair_index, CASE WHEN rationale IN ('unanimous', 'majority') THEN text END AS text, top AS supporters, sources, rationale FROM o""")
def consensus_vote(spark, d):
    t = pair_texts(spark, d).select("page_id", "pair_index", F.col("side").alias("source"), "text")
    v = table(spark, d, "vlm_reviews").select("id", "page_id", "pair_index", "text", "uncertain").distinct().where("not uncertain").select("page_id", "pair_index", F.lit("vlm").alias("source"), "text")
    return measure.vote(t.unionByName(v).withColumn("fold", tx.fold_width(F.col("text"))), ["page_id", "pair_index"])


_CER = f"""WITH {_SIDES}, {_PAG}, t AS (SELECT p.page_id, p.pair_index, p.text AS a, s.text AS b FROM sid p JOIN sid s ON s.page_id = p.page_id AND s.pair_index = p.pair_index AND p.side = 'primary' AND s.side = 'secondary' WHERE regexp_full_match(p.text, '[ -~]*') AND regexp_full_match(s.text, '[ -~]*'))"""


def both_sides(spark, d) -> DataFrame:
    return two_sides(spark, d).where("p_text is not null and s_text is not null")


def ascii_pairs(spark, d) -> DataFrame:
    """The pairs on which SQL's distance of bytes is one of characters."""
    t = both_sides(spark, d)
    return t.where(F.col("p_text").rlike("^[ -~]*$") & F.col("s_text").rlike("^[ -~]*$"))


@query(_CER + " SELECT page_id, pair_index, levenshtein(a, b) AS edits, length(a) AS chars, round(CASE WHEN length(a) > 0 THEN levenshtein(a, b) / length(a) WHEN levenshtein(a, b) = 0 THEN 0.0 ELSE 1.0 END, 6) AS cer FROM t")
def cer_line(spark, d):
    return _cer_line(ascii_pairs(spark, d))


@query()
def cer_line_all(spark, d):
    """``cer_line`` of all pairs with two sides, in characters; SQL counts bytes there."""
    return _cer_line(both_sides(spark, d))


def _cer_line(pairs: DataFrame) -> DataFrame:
    e, n = F.levenshtein("p_text", "s_text"), F.length("p_text")
    return pairs.select("page_id", "pair_index", e.alias("edits"), n.alias("chars"), F.round(measure.error_rate(e, n), 6).alias("cer"))


@query(_CER + """, c AS (SELECT project_id, levenshtein(a, b) AS e, length(a) AS n, CASE WHEN length(a) > 0 THEN levenshtein(a, b) / length(a) WHEN levenshtein(a, b) = 0 THEN 0.0 ELSE 1.0 END AS r FROM t JOIN pag ON pag.id = t.page_id),
 g AS (SELECT project_id, count(*) AS lines, sum(e) AS edits, sum(n) AS chars, avg(r) AS m FROM c GROUP BY 1)
 SELECT project_id, lines, edits, chars, round(edits / chars, 6) AS micro_cer, round(m, 6) AS macro_cer, round(greatest(0, ((edits / chars) + 1.959963984540054 * 1.959963984540054 / (2 * chars)) / (1 + 1.959963984540054 * 1.959963984540054 / chars) - 1.959963984540054 * sqrt(greatest(0, (edits / chars) * (1 - edits / chars) / chars + 1.959963984540054 * 1.959963984540054 / (4.0 * chars * chars))) / (1 + 1.959963984540054 * 1.959963984540054 / chars)), 6) AS low FROM g WHERE chars > 0""")
def cer_strata(spark, d):
    return _cer_strata(ascii_pairs(spark, d), pages(spark, d))


@query()
def cer_strata_all(spark, d):
    """``cer_strata`` of all pairs with two sides."""
    return _cer_strata(both_sides(spark, d), pages(spark, d))


def _cer_strata(pairs: DataFrame, of: DataFrame) -> DataFrame:
    e, n = F.levenshtein("p_text", "s_text"), F.length("p_text")
    p = of.select(F.col("id").alias("page_id"), "project_id")
    c = pairs.join(p, "page_id").select("project_id", e.alias("e"), n.alias("n"), measure.error_rate(e, n).alias("r"))
    g = c.groupBy("project_id").agg(F.count("*").alias("lines"), F.sum("e").alias("edits"), F.sum("n").alias("chars"), F.avg("r").alias("m")).where("chars > 0")
    low, _ = measure.wilson(F.col("edits"), F.col("chars"))
    return g.select("project_id", "lines", "edits", "chars", F.round(F.col("edits") / F.col("chars"), 6).alias("micro_cer"), F.round("m", 6).alias("macro_cer"), F.round(low, 6).alias("low"))


@query(f"""WITH {_ALI}, {_PAG}, g AS (SELECT project_id, count(*) AS n, avg(text_similarity) AS m, stddev_samp(text_similarity) AS s FROM ali JOIN pag ON pag.id = page_id GROUP BY 1)
SELECT project_id, n, round(m, 6) AS mean, round(CASE WHEN n > 1 THEN greatest(0, m - 1.959963984540054 * s / sqrt(n)) END, 6) AS low, round(CASE WHEN n > 1 THEN m + 1.959963984540054 * s / sqrt(n) END, 6) AS high FROM g""")
def mean_interval(spark, d):
    p = pages(spark, d).select(F.col("id").alias("page_id"), "project_id")
    g = alignments(spark, d).join(p, "page_id").groupBy("project_id").agg(F.count("*").alias("n"), F.avg("text_similarity").alias("m"), F.stddev_samp("text_similarity").alias("s"))
    low, high = measure.mean_interval(F.col("m"), F.col("s"), F.col("n"))
    return g.select("project_id", "n", F.round("m", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {_RUN}, {_LIN}, j AS (SELECT engine, coalesce(direction, 'horizontal-lr') AS direction, coalesce(lang, '(none)') AS lang, confidence FROM lin l JOIN run r ON r.id = l.run_id JOIN (SELECT DISTINCT id, lang FROM projects) p ON p.id = l.project_id)
SELECT engine, lang, direction, count(*) AS lines, count(confidence) AS measured, round(avg(confidence), 6) AS mean_confidence, CASE WHEN count(*) = count(confidence) THEN round(sum(confidence), 4) END AS complete_sum FROM j GROUP BY GROUPING SETS ((engine), (engine, lang), (engine, direction))""")
def reader_strata(spark, d):
    r = runs(spark, d).select(F.col("id").alias("run_id"), "engine", F.coalesce("direction", F.lit("horizontal-lr")).alias("direction"))
    p = table(spark, d, "projects").select(F.col("id").alias("project_id"), F.coalesce("lang", F.lit("(none)")).alias("lang")).distinct()
    j = lines(spark, d).join(r, "run_id").join(p, "project_id")
    e, g, w = F.col("engine"), F.col("lang"), F.col("direction")
    return j.groupingSets([[e], [e, g], [e, w]], e, g, w).agg(F.count("*").alias("lines"), F.count("confidence").alias("measured"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(measure.complete_sum("confidence"), 4).alias("complete_sum"))


@query(f"""WITH {_LIN}, c AS (SELECT run_id, count(*) AS lines FROM lin GROUP BY 1), i AS (SELECT a.run_id, count(*) AS n FROM lin a JOIN lin b ON b.run_id = a.run_id AND a.line_index < b.line_index AND a.y > b.y GROUP BY 1)
SELECT c.run_id, lines, coalesce(n, 0) AS inversions FROM c LEFT JOIN i ON i.run_id = c.run_id""")
def order_inversions(spark, d):
    return measure.inversions(lines(spark, d), "run_id", "line_index", "y")


@query(f"""WITH {_RUN}, {_LIN}, m AS (SELECT l.project_id, r.engine, avg(1 - confidence) AS v FROM lin l JOIN run r ON r.id = l.run_id GROUP BY 1, 2), o AS (SELECT project_id, v FROM m WHERE engine = (SELECT min(engine) FROM run)), n AS (SELECT project_id, v FROM m WHERE engine = (SELECT max(engine) FROM run))
SELECT coalesce(o.project_id, n.project_id) AS project_id, round(o.v, 6) AS old_value, round(n.v, 6) AS new_value, CASE WHEN o.project_id IS NULL THEN 'new' WHEN n.project_id IS NULL THEN 'missing' WHEN n.v - o.v IS NULL THEN 'unavailable' WHEN n.v - o.v < -1e-9 THEN 'improved' WHEN n.v - o.v > 1e-9 THEN 'regressed' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.project_id = n.project_id""")
def regression_compare(spark, d):
    r = runs(spark, d)
    m = lines(spark, d).join(r.select(F.col("id").alias("run_id"), "engine"), "run_id").groupBy("project_id", "engine").agg(F.avg(1 - F.col("confidence")).alias("v"))
    ends = r.agg(F.min("engine").alias("a"), F.max("engine").alias("b"))
    side = lambda c: m.join(F.broadcast(ends), m["engine"] == ends[c], "left_semi").select("project_id", "v")  # noqa: E731 - one row
    return measure.compare(side("a"), side("b"), ["project_id"], "v").select("project_id", F.round("old_value", 6).alias("old_value"), F.round("new_value", 6).alias("new_value"), "status")


# ---------------------------------------------------------------- structure


@query(f"""WITH {_LIN}, {_RUN}, {_PAG}, {_LP}, m AS (SELECT project_id, page_id, lower(translate(trim(text), '，。！？；：（）［］', ',.!?;:()[]')) AS margin_text FROM lp WHERE y < 0.08 OR y + height > 0.92)
SELECT project_id, margin_text, count(DISTINCT page_id) AS pages FROM m WHERE margin_text <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 3""")
def repeated_margins(spark, d):
    return structure.repeated_margins(placed_lines(spark, d))


_LABEL = f"""{_LIN}, {_RUN}, {_PAG}, {_LP}, rom AS (SELECT i, (['', 'C'])[i // 100 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[(i % 100) // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[i % 10 + 1] AS s FROM range(1, 101) t(i)),
cj AS (SELECT i, CASE WHEN i < 10 THEN (['一', '二', '三', '四', '五', '六', '七', '八', '九'])[i] ELSE CASE WHEN i // 10 > 1 THEN (['一', '二', '三', '四', '五', '六', '七', '八', '九'])[i // 10] ELSE '' END || '十' || CASE WHEN i % 10 > 0 THEN (['一', '二', '三', '四', '五', '六', '七', '八', '九'])[i % 10] ELSE '' END END AS s FROM range(1, 100) t(i)),
mar AS (SELECT *, trim(text) AS t, regexp_replace(trim(text), '^[\\[(\\-–— ]*(?:[pP]\\. *)?|[\\])\\-–—. ]*$', '', 'g') AS b FROM lp WHERE (y < 0.1 OR y + height > 0.9) AND length(trim(text)) <= 12),
lab AS (SELECT mar.*, CASE WHEN regexp_full_match(b, '[0-9]{{1,6}}') AND b <> '0' THEN 'arabic' WHEN regexp_full_match(b, '[ivxlc]+|[IVXLC]+') AND rom.i IS NOT NULL THEN 'roman' WHEN cj.i IS NOT NULL THEN 'cjk' END AS scheme,
 CASE WHEN regexp_full_match(b, '[0-9]{{1,6}}') AND b <> '0' THEN CAST(b AS INT) WHEN regexp_full_match(b, '[ivxlc]+|[IVXLC]+') THEN rom.i ELSE cj.i END AS value FROM mar LEFT JOIN rom ON rom.s = upper(b) LEFT JOIN cj ON cj.s = b),
pl AS (SELECT project_id, page_id, page_index, min_by(scheme, (line_index, value)) AS scheme, min_by(value, (line_index, value)) AS value FROM lab WHERE scheme IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"WITH {_LABEL} SELECT project_id, page_id, page_index, scheme, value FROM pl")
def page_labels(spark, d):
    return structure.page_labels(placed_lines(spark, d))


_RUNS = ", rn AS (SELECT project_id, scheme, value - page_index AS shift, min(page_index) AS first_page, max(page_index) AS last_page, count(DISTINCT page_index) AS pages FROM pl GROUP BY 1, 2, 3 HAVING count(DISTINCT page_index) >= 2)"


@query(f"WITH {_LABEL}{_RUNS} SELECT * FROM rn")
def folio_runs(spark, d):
    return structure.numbering_runs(structure.page_labels(placed_lines(spark, d)))


@query(f"WITH {_LABEL}{_RUNS} SELECT project_id, scheme, shift, first_page, last_page, pages FROM rn QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY pages DESC, first_page DESC, shift DESC, scheme) = 1")
def body_run(spark, d):
    return structure.body_runs(structure.numbering_runs(structure.page_labels(placed_lines(spark, d))))


_CHAP = f"""{_LIN}, {_RUN}, {_PAG}, {_LP}, hd AS (SELECT project_id, page_index, trim(text) AS title, line_index FROM lp WHERE regexp_matches(trim(text), '^(?i:chapter|chapitre|kapitel) [0-9ivxIVX]+|^第[一二三四五六七八九十0-9]+章') AND NOT regexp_matches(trim(text), '^(?i:part|partie|teil) [0-9ivxIVX]+|^第[一二三四五六七八九十0-9]+部')),
hp AS (SELECT project_id, page_index, min_by(title, (line_index, title)) AS title FROM hd GROUP BY 1, 2),
ch AS (SELECT project_id, row_number() OVER w AS ordinal, title, page_index AS start_page, lead(page_index) OVER w - 1 AS end_page FROM hp WINDOW w AS (PARTITION BY project_id ORDER BY page_index))"""


@query(f"WITH {_CHAP} SELECT * FROM ch")
def chapter_ranges(spark, d):
    return structure.chapters(placed_lines(spark, d))


@query(f"WITH {_CHAP} SELECT p.project_id, p.page_index, ch.title AS chapter FROM (SELECT DISTINCT project_id, page_index FROM pag) p ASOF LEFT JOIN ch ON ch.project_id = p.project_id AND ch.start_page <= p.page_index")
def chapter_asof(spark, d):
    return structure.chapter_of_pages(pages(spark, d).select("project_id", "page_index").distinct(), structure.chapters(placed_lines(spark, d)))


@query(f"""WITH {_PAG}, {_RUN}, {_LIN}, t AS (SELECT DISTINCT r.page_id FROM run r JOIN lin l ON l.run_id = r.id), k AS (SELECT page_id, max(ink_ratio) AS ink FROM page_confirmations GROUP BY 1)
SELECT project_id, page_index, pag.id AS page_id, CASE WHEN t.page_id IS NOT NULL THEN 'text' WHEN ink >= 0.02 THEN 'plate' ELSE 'blank' END AS role FROM pag LEFT JOIN t ON t.page_id = pag.id LEFT JOIN k ON k.page_id = pag.id""")
def page_roles(spark, d):
    has = runs(spark, d).select(F.col("id").alias("run_id"), "page_id").join(lines(spark, d).select("run_id").distinct(), "run_id").select("page_id").distinct()
    ink = table(spark, d, "page_confirmations").groupBy("page_id").agg(F.max("ink_ratio").alias("ink_ratio"))
    return structure.page_roles(pages(spark, d), has, ink)


_PARA = f"""{_LIN}, st AS (SELECT *, y - lag(y) OVER (PARTITION BY run_id ORDER BY y, x, line_index) AS step FROM lin), mt AS (SELECT run_id, min(x) AS l, max(x + width) AS r, median(step) FILTER (step > 0) AS gap FROM st GROUP BY 1),
jn AS (SELECT lin.*, mt.l, mt.r, mt.gap, lag(lin.id) OVER w AS pid, lag(y) OVER w AS py, lag(x + width) OVER w AS pend, lag(regexp_matches(rtrim(text), '[。！？；：…!?;:.][”’」』）】》〉〕］"'')\\]]*$')) OVER w AS pdone FROM lin JOIN mt ON mt.run_id = lin.run_id WINDOW w AS (PARTITION BY lin.run_id ORDER BY line_index, lin.id)),
fl AS (SELECT *, (pid IS NULL OR coalesce(y - py > 1.6 * gap, false) OR (x - l > 0.02 AND coalesce(pdone OR r - pend > 0.05, false)))::INT AS s FROM jn), nm AS (SELECT *, sum(s) OVER (PARTITION BY run_id ORDER BY line_index, id) AS paragraph FROM fl)"""


@query(f"""WITH {_PARA} SELECT run_id, CAST(paragraph AS BIGINT) AS paragraph, min(line_index) AS first_line, count(*) AS lines, list_reduce(list_prepend('', list(text ORDER BY line_index, id)), lambda a, t: CASE WHEN a = '' THEN t WHEN t = '' THEN a ELSE a || CASE WHEN regexp_matches(right(a, 1), '[0-9A-Za-z]') AND regexp_matches(left(t, 1), '[0-9A-Za-z]') THEN ' ' ELSE '' END || t END) AS text FROM nm GROUP BY 1, 2""")
def paragraphs(spark, d):
    return structure.paragraphs(lines(spark, d))


@query(f"""WITH {_PAG}, {_ALI}, {_DEC}, {_RUN}, {_LIN}, op AS (SELECT DISTINCT page_id, pair_index FROM ali WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.page_id = ali.page_id AND dec.pair_index = ali.pair_index)),
tx AS (SELECT DISTINCT r.page_id FROM run r JOIN lin l ON l.run_id = r.id),
p AS (SELECT pag.project_id, pag.id, (SELECT count(*) FROM op WHERE op.page_id = pag.id) AS open_pairs, pag.id IN (SELECT page_id FROM tx) AS has_text, pag.id IN (SELECT page_id FROM ali) AS verified, pag.id IN (SELECT page_id FROM page_confirmations) AS confirmed FROM pag)
SELECT project_id, count(*) AS pages, count(*) FILTER (has_text AND NOT verified) AS unverified, CAST(sum(open_pairs) AS BIGINT) AS unresolved, count(*) FILTER (NOT has_text AND NOT confirmed) AS unconfirmed FROM p GROUP BY 1""")
def assembly_gate(spark, d):
    p = pages(spark, d).select("project_id", F.col("id").alias("page_id"))
    o = open_pairs(spark, d).groupBy("page_id").agg(F.count("*").alias("open_pairs"))
    flag = lambda df, n: df.select("page_id").distinct().withColumn(n, F.lit(True))
    has = runs(spark, d).select(F.col("id").alias("run_id"), "page_id").join(lines(spark, d).select("run_id"), "run_id", "left_semi")
    p = p.join(o, "page_id", "left").join(flag(has, "t"), "page_id", "left").join(flag(alignments(spark, d), "v"), "page_id", "left").join(flag(table(spark, d, "page_confirmations"), "c"), "page_id", "left")
    return p.groupBy("project_id").agg(F.count("*").alias("pages"), F.count_if(F.col("t").isNotNull() & F.col("v").isNull()).alias("unverified"), F.coalesce(F.sum("open_pairs"), F.lit(0)).alias("unresolved"), F.count_if(F.col("t").isNull() & F.col("c").isNull()).alias("unconfirmed"))


@query()
def similarity_ratio(spark, d):
    """Matching-blocks similarity of the sides of each pair; SQL has no such function."""
    t = two_sides(spark, d)
    return t.select("page_id", "pair_index", F.round(align.similar(F.col("p_text"), F.col("s_text")), 6).alias("similarity"))


@query()
def align_full(spark, d):
    """Alignment of the newest whole-page runs of the two readers of every page."""
    return align.align_pages(*_two_runs(spark, d))


# ---------------------------------------------------------------- evaluation


@query()
def wer_line(spark, d):
    """Word errors of the second reading against the first; null for languages without spaced words."""
    p = pages(spark, d).select(F.col("id").alias("page_id"), "project_id")
    lang = table(spark, d, "projects").select(F.col("id").alias("project_id"), "lang").distinct()
    t = two_sides(spark, d).where("p_text is not null and s_text is not null").join(p, "page_id").join(lang, "project_id")
    return t.select("page_id", "pair_index", evaluate.word_errors(F.col("p_text"), F.col("s_text"), F.col("lang")).alias("w")).select("page_id", "pair_index", "w.edits", "w.words")


@query(_CER + """, m AS (SELECT page_id, pair_index, regexp_replace(a, '[^!-/:-@\\[-`{-~]', '', 'g') AS r, regexp_replace(b, '[^!-/:-@\\[-`{-~]', '', 'g') AS h FROM t)
SELECT page_id, pair_index, round(CASE WHEN length(r) > 0 THEN greatest(0.0, 1 - levenshtein(r, h) / length(r)) WHEN levenshtein(r, h) = 0 THEN 1.0 ELSE 0.0 END, 6) AS accuracy FROM m""")
def punctuation_accuracy(spark, d):
    return _punctuation(ascii_pairs(spark, d))


@query()
def punctuation_accuracy_all(spark, d):
    """``punctuation_accuracy`` of all pairs with two sides, CJK marks among them."""
    return _punctuation(both_sides(spark, d))


def _punctuation(pairs: DataFrame) -> DataFrame:
    return pairs.select("page_id", "pair_index", F.round(evaluate.punctuation_accuracy(F.col("p_text"), F.col("s_text")), 6).alias("accuracy"))


def _two_runs(spark, d) -> tuple[DataFrame, DataFrame]:
    last = journal.latest_engine_run(runs(spark, d))
    first, second = last.agg(F.min("engine"), F.max("engine")).first()  # two names
    side = lambda name: lines(spark, d).join(last.where(F.col("engine") == name).select("run_id", "page_id"), "run_id").join(runs(spark, d).select(F.col("id").alias("run_id"), "direction"), "run_id")
    return side(first), side(second)


@query()
def line_errors(spark, d):
    """Lines missing, extra and changed in the second reader's page against the first's."""
    a, b = (x.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_index", "id", "text"))), lambda s: s["text"]).alias(n)) for x, n in zip(_two_runs(spark, d), ("a", "b"), strict=True))
    j = a.join(b, "page_id", "full_outer").select("page_id", F.coalesce("a", F.array().cast("array<string>")).alias("a"), F.coalesce("b", F.array().cast("array<string>")).alias("b"))
    return j.select("page_id", evaluate.line_errors("a", "b").alias("e")).select("page_id", "e.missing", "e.extra", "e.changed")


@query()
def box_matches(spark, d):
    a, b = _two_runs(spark, d)
    return evaluate.box_matches(a, b)


@query(f"""WITH {_ALI}, {_LIN}, {_RUN}, tr AS (SELECT DISTINCT page_id, primary_members, secondary_members FROM ali WHERE len(primary_members) > 0 AND len(secondary_members) > 0),
fo AS (SELECT DISTINCT a.page_id, [p.line_index] AS primary_members, [s.line_index] AS secondary_members FROM (SELECT DISTINCT page_id, primary_run_id, secondary_run_id FROM ali) a JOIN lin p ON p.run_id = a.primary_run_id JOIN lin s ON s.run_id = a.secondary_run_id AND s.line_index = p.line_index),
g AS (SELECT coalesce(tr.page_id, fo.page_id) AS page_id, count(*) FILTER (tr.page_id IS NOT NULL AND fo.page_id IS NOT NULL) AS tp, count(*) FILTER (tr.page_id IS NULL) AS fp, count(*) FILTER (fo.page_id IS NULL) AS fn FROM tr FULL JOIN fo ON tr.page_id = fo.page_id AND tr.primary_members = fo.primary_members AND tr.secondary_members = fo.secondary_members GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM g)
SELECT page_id, tp, fp, fn, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM q""")
def alignment_scores(spark, d):
    """Pairing by equal line numbers, scored against the recorded alignments."""
    a = alignments(spark, d)
    truth = a.where("size(primary_members) > 0 and size(secondary_members) > 0")
    two = a.select("page_id", "primary_run_id", "secondary_run_id").distinct()
    side = lambda n: lines(spark, d).select(F.col("run_id").alias(f"{n}_run_id"), "line_index").distinct()
    found = two.join(side("primary"), "primary_run_id").join(side("secondary"), ["secondary_run_id", "line_index"]).select("page_id", F.array("line_index").alias("primary_members"), F.array("line_index").alias("secondary_members"))
    return evaluate.group_scores(truth, found, "page_id").withColumn("f1", F.round("f1", 6))


@query()
def label_sequences(spark, d):
    """Page labels in monotone runs; a fold per book, so without an oracle."""
    return evaluate.sequences(structure.page_labels(placed_lines(spark, d)))


@query(f"""WITH {_LIN}, {_RUN}, {_PAG}, w AS (SELECT r.page_id, max(r.id) AS run_id FROM run r JOIN lin l ON l.run_id = r.id WHERE scope IS NULL GROUP BY 1), b AS (SELECT pag.project_id, pag.page_index, l.* FROM w JOIN lin l ON l.run_id = w.run_id JOIN pag ON pag.id = w.page_id WHERE l.y > 0.1 AND l.y < 0.9),
f AS (SELECT b.project_id, page_index, min_by(x, (line_index, id)) > 0.11 AS first_indented, max_by(text, (line_index, id)) AS last_text FROM b GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN page_index - lag(page_index) OVER v = 1 AND NOT regexp_matches(rtrim(lag(last_text) OVER v), '[。！？；：…!?;:.][”’」』）】》〉〕］\"'')\\]]*$') AND NOT first_indented THEN 0 ELSE 1 END AS s FROM f WINDOW v AS (PARTITION BY project_id ORDER BY page_index))
SELECT project_id, page_index, CAST(sum(s) OVER (PARTITION BY project_id ORDER BY page_index) AS BIGINT) AS flow FROM n""")
def page_flow(spark, d):
    has = lines(spark, d).select("run_id").distinct()
    w = runs(spark, d).where("scope is null").join(has, F.col("id") == F.col("run_id"), "left_semi").groupBy("page_id").agg(F.max("id").alias("run_id"))
    p = pages(spark, d).select(F.col("id").alias("page_id"), F.col("project_id").alias("book"), "page_index")
    b = lines(spark, d).where("y > 0.1 and y < 0.9").join(w, "run_id").join(p, "page_id")
    at = F.struct("line_index", "id")
    f = b.groupBy(F.col("book").alias("project_id"), "page_index").agg((F.min_by("x", at) > 0.11).alias("first_indented"), F.max_by("text", at).alias("last_text"))
    return evaluate.page_turns(f)


@query(f"""WITH {_RUN}, {_SIDES}, a AS (SELECT page_id, CAST(string_split(scope, ':')[2] AS BIGINT) AS pair_index, count(*) AS attempts FROM run WHERE scope LIKE 'pair:%' GROUP BY 1, 2)
SELECT a.page_id, a.pair_index, attempts, round(greatest(0, x0 - least(0.10, 0.01 + 0.02 * attempts)), 6) AS x, round(least(1, x0 + (x1 - x0) + least(0.10, 0.01 + 0.02 * attempts)) - greatest(0, x0 - least(0.10, 0.01 + 0.02 * attempts)), 6) AS width, CAST(least(4, 1 + attempts) AS INT) AS scale FROM a JOIN sid ON sid.page_id = a.page_id AND sid.pair_index = a.pair_index AND side = 'primary'""")
def reread_regions(spark, d):
    """The region of the next attempt at each line that was read again."""
    r = runs(spark, d).where("scope like 'pair:%'").groupBy("page_id", F.split("scope", ":")[1].cast("bigint").alias("pair_index")).agg(F.count("*").alias("attempts"))
    t = pair_texts(spark, d).where("side = 'primary'")
    c = F.col
    j = r.join(t, ["page_id", "pair_index"]).withColumn("g", evaluate.escalated_region(c("x0"), c("y0"), c("x1") - c("x0"), c("y1") - c("y0"), c("attempts")))
    return j.select("page_id", "pair_index", "attempts", F.round("g.x", 6).alias("x"), F.round("g.width", 6).alias("width"), c("g.scale").cast("int").alias("scale"))
