"""Queries of acceptance, review and audit, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.functions import labels as lb
from versoflow.functions import text as tx
from versoflow.operators import accept, journal, structure
from versoflow.plans import evidence as ev
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


def _quoted(s: str) -> str:
    return s.replace("'", "''")


_FOLD = f"lower(translate(text, '{_quoted(tx.FOLD_FROM)}', '{_quoted(tx.FOLD_TO)}'))"
_PAIRS = "prs AS (SELECT DISTINCT page_id, pair_index FROM ali)"
_AGREE = f"""{ev._SIDES}, {_PAIRS},
rdg AS (SELECT prs.page_id, prs.pair_index, g.k AS position, sid.text, {_FOLD} AS fold FROM prs CROSS JOIN (VALUES (0, 'primary'), (1, 'secondary')) g(k, side) LEFT JOIN sid ON sid.page_id = prs.page_id AND sid.pair_index = prs.pair_index AND sid.side = g.side),
frm AS (SELECT page_id, pair_index, fold, count(*) AS n, min(position) AS first, min_by(text, position) AS text, count(DISTINCT text) AS spellings FROM rdg WHERE fold IS NOT NULL GROUP BY 1, 2, 3),
agr AS (SELECT prs.page_id, prs.pair_index, CAST(coalesce(sum(n), 0) AS BIGINT) AS texts, max(n) AS top, max_by(text, n * 10 - first) AS best, max_by(spellings, n * 10 - first) AS spellings FROM prs LEFT JOIN frm ON frm.page_id = prs.page_id AND frm.pair_index = prs.pair_index GROUP BY 1, 2),
ag AS (SELECT page_id, pair_index, texts, CASE WHEN top >= 2 THEN best END AS agreed, CASE WHEN texts = 0 THEN 'no_engine_text' WHEN top >= 2 AND top = texts THEN CASE WHEN spellings = 1 THEN 'engines_agree' ELSE 'variant_agreement' END WHEN top >= 2 THEN 'majority_agreement' WHEN texts < 2 THEN 'missing_engine_text' ELSE 'engines_disagree' END AS rationale FROM agr)"""


def _agreed(spark: SparkSession, d: str) -> DataFrame:
    t = ev.two_sides(spark, d)
    pairs = ev.alignments(spark, d).select("page_id", "pair_index").distinct()
    r = pairs.join(t.select("page_id", "pair_index", "p_text", "s_text"), ["page_id", "pair_index"], "left")
    r = r.select("page_id", "pair_index", F.posexplode(F.array("p_text", "s_text")).alias("position", "text"))
    return accept.agreement(r, ["page_id", "pair_index"])


@query(f"WITH {_AGREE} SELECT page_id, pair_index, texts, agreed, rationale FROM ag")
def agree_vote(spark, d):
    """Whether the readers of each printed line agree, and on what text."""
    return _agreed(spark, d).select("page_id", "pair_index", "texts", "agreed", "rationale")


_VLM = "vl AS (SELECT page_id, pair_index, max_by(text, id) AS vlm_text, max_by(uncertain, id) AS vlm_uncertain FROM vlm_reviews GROUP BY 1, 2)"
_PROPOSED = f"""{_AGREE}, {_VLM}, fl AS (SELECT page_id, pair_index, list(fold) AS folds FROM frm GROUP BY 1, 2),
pj AS (SELECT ag.*, vlm_text, vlm_uncertain, folds, lower(translate(vlm_text, '{_quoted(tx.FOLD_FROM)}', '{_quoted(tx.FOLD_TO)}')) AS vf FROM ag LEFT JOIN vl USING (page_id, pair_index) LEFT JOIN fl USING (page_id, pair_index)),
pw AS (SELECT *, CASE WHEN agreed IS NOT NULL OR texts = 0 OR vlm_uncertain IS NULL THEN rationale WHEN vlm_uncertain THEN 'vlm_uncertain' WHEN trim(coalesce(vlm_text, '')) = '' THEN 'vlm_blank' WHEN NOT coalesce(list_contains(folds, vf), false) THEN 'vlm_uncorroborated' ELSE 'vlm_confident' END AS why FROM pj),
pr AS (SELECT page_id, pair_index, why, CASE WHEN why = 'vlm_confident' THEN vlm_text ELSE agreed END AS proposed, CASE WHEN why = 'vlm_confident' THEN 'vlm' WHEN agreed IS NOT NULL THEN 'automatic' END AS actor FROM pw)"""


def _proposed(spark: SparkSession, d: str) -> DataFrame:
    v = journal.newest(table(spark, d, "vlm_reviews").select("id", "page_id", "pair_index", F.col("text").alias("vlm_text"), F.col("uncertain").alias("vlm_uncertain")), ["page_id", "pair_index"]).drop("id")
    return accept.corroborated(_agreed(spark, d).join(v, ["page_id", "pair_index"], "left"))


@query(f"WITH {_PROPOSED} SELECT page_id, pair_index, why AS rationale, proposed, actor FROM pr")
def corroboration(spark, d):
    """What the readers, or else a certain third reading that one of them shares, propose for each line."""
    return _proposed(spark, d).select("page_id", "pair_index", "rationale", "proposed", "actor")


# The risk of both sides, with the part that comes from the evidence's quality.
_GATE = ev._RISK.replace("WITH ", "", 1).rstrip() + f""",
cs AS (SELECT page_id, pair_index, reasons, least(1.0, CASE WHEN list_contains(reasons, 'low_confidence') THEN 0.25 ELSE 0 END + CASE WHEN list_contains(reasons, 'unicode_anomaly') THEN 0.35 ELSE 0 END + CASE WHEN list_contains(reasons, 'spatial_mismatch') THEN 0.15 ELSE 0 END) AS content FROM z),
mc AS (SELECT page_id, pair_index, min(confidence) AS c FROM sid GROUP BY 1, 2),
{_PROPOSED.replace(ev._SIDES + ", ", "", 1)},
gt AS (SELECT pr.*, list_filter([CASE WHEN trim(proposed) = '' THEN 'blank_text' END, CASE WHEN regexp_matches(regexp_replace(proposed, '[\\t\\n\\r]', '', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\x{{FFFD}}]') THEN 'unrepresentable_text' END,
 CASE WHEN list_contains(reasons, 'unicode_anomaly') THEN 'unicode_anomaly' END, CASE WHEN list_contains(reasons, 'spatial_mismatch') THEN 'spatial_mismatch' END, CASE WHEN content > 0.34 THEN 'high_content_risk' END, CASE WHEN c < 0.3 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS blockers
 FROM pr LEFT JOIN cs USING (page_id, pair_index) LEFT JOIN mc USING (page_id, pair_index) WHERE proposed IS NOT NULL)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    t = ev.risks(spark, d).select("page_id", "pair_index", "reasons", "content_score", "min_confidence")
    j = _proposed(spark, d).where("proposed is not null").join(t, ["page_id", "pair_index"], "left")
    return j.withColumn("blockers", accept.blockers(F.col("proposed"), F.col("reasons"), F.col("content_score"), F.col("min_confidence")))


@query(f"WITH {_GATE} SELECT page_id, pair_index, actor, why AS rationale, array_to_string(blockers, '+') AS blockers FROM gt")
def gate_blockers(spark, d):
    """Why the gate refuses each proposed text; empty where a machine may accept it."""
    return _gated(spark, d).select("page_id", "pair_index", "actor", "rationale", F.array_join("blockers", "+").alias("blockers"))


@query(f"""WITH {_GATE}, {ev._PAG}, al AS (SELECT prs.page_id, prs.pair_index, gt.actor, gt.blockers FROM prs LEFT JOIN gt USING (page_id, pair_index))
SELECT project_id, count(*) AS pairs, count(*) FILTER (actor = 'automatic' AND len(blockers) = 0) AS automatic, count(*) FILTER (actor = 'vlm' AND len(blockers) = 0) AS vlm, count(*) FILTER (len(blockers) > 0) AS blocked, count(*) FILTER (actor IS NULL) AS undecided,
 round(count(*) FILTER (len(blockers) = 0) / count(*), 6) AS acceptance FROM al JOIN pag ON pag.id = al.page_id GROUP BY 1""")
def acceptance_summary(spark, d):
    """What each book would have accepted without a person, and what the gate holds back."""
    g = _gated(spark, d).select("page_id", "pair_index", "actor", F.size("blockers").alias("b"))
    a = ev.alignments(spark, d).select("page_id", "pair_index").distinct().join(g, ["page_id", "pair_index"], "left")
    p = ev.pages(spark, d).select(F.col("id").alias("page_id"), "project_id")
    free = F.col("b") == 0
    return a.join(p, "page_id").groupBy("project_id").agg(
        F.count("*").alias("pairs"), F.count_if((F.col("actor") == "automatic") & free).alias("automatic"), F.count_if((F.col("actor") == "vlm") & free).alias("vlm"),
        F.count_if(F.col("b") > 0).alias("blocked"), F.count_if(F.col("actor").isNull()).alias("undecided"), F.round(F.count_if(free) / F.count("*"), 6).alias("acceptance"),
    )


# ---------------------------------------------------------------- furniture and the review queue

_FURN = f"""{ev._LABEL.replace('mar AS', 'mar0 AS', 1).split('lab AS')[0].rstrip().rstrip(',')},
dir AS (SELECT run_id, sum(height) > sum(width) AS up, count(*) AS lines FROM lin GROUP BY 1),
mg AS (SELECT lp.*, up, lines, trim(text) AS t, regexp_replace(trim(text), '^[\\[(\\-–— ]*(?:[pP]\\. *)?|[\\])\\-–—. ]*$', '', 'g') AS b, {_FOLD} AS key FROM lp JOIN dir ON dir.run_id = lp.run_id WHERE CASE WHEN up THEN x <= 0.08 OR x + width >= 0.92 ELSE y <= 0.08 OR y + height >= 0.92 END),
lb AS (SELECT mg.*, CASE WHEN length(t) > 12 THEN NULL WHEN regexp_full_match(b, '[0-9]{{1,6}}') AND b <> '0' THEN 'arabic' WHEN regexp_full_match(b, '[ivxlc]+|[IVXLC]+') AND rom.i IS NOT NULL THEN 'roman' WHEN cj.i IS NOT NULL THEN 'cjk' END AS scheme,
 CASE WHEN regexp_full_match(b, '[0-9]{{1,6}}') AND b <> '0' THEN CAST(b AS INT) WHEN regexp_full_match(b, '[ivxlc]+|[IVXLC]+') THEN rom.i ELSE cj.i END AS value FROM mg LEFT JOIN rom ON rom.s = upper(b) LEFT JOIN cj ON cj.s = b),
sq AS (SELECT project_id, scheme, value - page_index AS shift FROM lb WHERE scheme IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT page_index) >= 2),
rp AS (SELECT project_id, key FROM mg WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_id) >= 3),
fu AS (SELECT lb.id, lb.page_id, lb.run_id, lb.line_index, CASE WHEN lb.scheme IS NOT NULL AND sq.shift IS NOT NULL THEN 'page_number' WHEN (lb.scheme IS NULL OR lb.scheme = 'roman') AND rp.key IS NOT NULL THEN 'repeated_in_margin' END AS reason
 FROM lb LEFT JOIN sq ON sq.project_id = lb.project_id AND sq.scheme = lb.scheme AND sq.shift = lb.value - lb.page_index LEFT JOIN rp ON rp.project_id = lb.project_id AND rp.key = lb.key WHERE lines > 1)"""


def _furniture(spark: SparkSession, d: str) -> DataFrame:
    return structure.page_furniture(ev.placed_lines(spark, d))


@query(f"WITH {_FURN} SELECT id, page_id, reason FROM fu WHERE reason IS NOT NULL")
def page_furniture(spark, d):
    """Lines at the margin that are page numbers in sequence or texts on three pages and more; a page's only line is none."""
    return _furniture(spark, d).select("id", "page_id", "reason")


@query(f"""WITH {ev._RISK.replace('WITH ', '', 1).rstrip()}, {_FURN.replace(ev._LIN + ', ', '', 1)}, {ev._DEC},
op AS (SELECT DISTINCT page_id, pair_index FROM ali WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.page_id = ali.page_id AND dec.pair_index = ali.pair_index)),
pf AS (SELECT DISTINCT m.page_id, m.pair_index FROM (SELECT page_id, pair_index, primary_run_id AS run_id, unnest(primary_members) AS line_index FROM ali) m JOIN fu ON fu.run_id = m.run_id AND fu.line_index = m.line_index WHERE reason IS NOT NULL),
qu AS (SELECT op.page_id, op.pair_index, coalesce(score, 0) AS score, reasons FROM op LEFT JOIN z USING (page_id, pair_index) WHERE (op.page_id, op.pair_index) NOT IN (SELECT (page_id, pair_index) FROM pf))
SELECT pag.project_id, qu.page_id, qu.pair_index, round(score, 6) AS score, array_to_string(reasons, '+') AS reasons, row_number() OVER (PARTITION BY pag.project_id ORDER BY round(score, 6) DESC, page_index, pair_index, qu.page_id) AS place FROM qu JOIN pag ON pag.id = qu.page_id""")
def review_queue(spark, d):
    """Lines without a decision in the order of their risk, page furniture left out."""
    furn = _furniture(spark, d).select("run_id", "line_index")
    hidden = journal.members(ev.alignments(spark, d), "primary").join(furn, ["run_id", "line_index"], "left_semi").select("page_id", "pair_index")
    r = ev.risks(spark, d).select("page_id", "pair_index", F.round("score", 6).alias("score"), F.array_join("reasons", "+").alias("reasons"))
    p = ev.pages(spark, d).select(F.col("id").alias("page_id"), "project_id", "page_index")
    q = ev.open_pairs(spark, d).join(hidden, ["page_id", "pair_index"], "left_anti").join(r, ["page_id", "pair_index"], "left").join(p, "page_id").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by = W.partitionBy("project_id").orderBy(F.desc("score"), "page_index", "pair_index", "page_id")
    return q.select("project_id", "page_id", "pair_index", "score", "reasons", F.row_number().over(by).alias("place"))


# ---------------------------------------------------------------- audits of citations and third readings


@query(f"""WITH {ev._DEC}, {ev._ALI}, {ev._RUN}, {ev._LIN}, h AS (SELECT id, page_id, pair_index, len(list_filter(coalesce(evidence_refs, []), lambda r: starts_with(r, 'verification_run:'))) AS cites, len(list_filter(coalesce(evidence_refs, []), lambda r: regexp_full_match(r, 'verification_run:[1-9][0-9]*'))) AS good,
 list_filter(coalesce(evidence_refs, []), lambda r: regexp_full_match(r, 'verification_run:[1-9][0-9]*')) AS refs FROM dec),
c AS (SELECT *, CASE WHEN good = 1 THEN CAST(string_split(refs[1], ':')[2] AS BIGINT) END AS cited FROM h),
ap AS (SELECT DISTINCT verification_run_id, page_id FROM ali), aq AS (SELECT DISTINCT verification_run_id, page_id, pair_index FROM ali), vr AS (SELECT DISTINCT id, verification_run_id, page_id, pair_index, crop_sha256 FROM vlm_reviews)
SELECT 'citation_missing' AS code, id AS subject FROM c WHERE cites = 0
UNION ALL SELECT 'citation_malformed', id FROM c WHERE cites > good
UNION ALL SELECT 'citation_contradicts', id FROM c WHERE good > 1
UNION ALL SELECT 'citation_of_other_page', id FROM c WHERE cited IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ap WHERE ap.verification_run_id = c.cited AND ap.page_id = c.page_id)
UNION ALL SELECT 'review_without_pair', id FROM vr WHERE NOT EXISTS (SELECT 1 FROM aq WHERE aq.verification_run_id = vr.verification_run_id AND aq.page_id = vr.page_id AND aq.pair_index = vr.pair_index)
UNION ALL SELECT 'textless_page_with_text', id FROM (SELECT DISTINCT id, page_id FROM page_confirmations) k WHERE page_id IN (SELECT r.page_id FROM run r JOIN lin l ON l.run_id = r.id WHERE scope IS NULL)""")
def citation_audit(spark, d):
    """Findings on what decisions cite, on third readings without their line, and on pages confirmed as textless that have text."""
    refs = F.coalesce("evidence_refs", F.array().cast("array<string>"))
    c = ev.decisions(spark, d).select("id", "page_id", F.size(F.filter(refs, lambda r: r.startswith("verification_run:"))).alias("cites"), F.size(F.filter(refs, lambda r: r.rlike("^verification_run:[1-9][0-9]*$"))).alias("good"), journal.cited_run(refs).alias("verification_run_id"))
    a = ev.alignments(spark, d)
    code = lambda df, name: df.select(F.lit(name).alias("code"), F.col("id").alias("subject"))
    kinds = F.array_compact(F.array(F.when(F.col("cites") == 0, F.lit("citation_missing")), F.when(F.col("cites") > F.col("good"), F.lit("citation_malformed")), F.when(F.col("good") > 1, F.lit("citation_contradicts"))))
    own = c.select(F.explode(kinds).alias("code"), F.col("id").alias("subject"))
    other = c.where("verification_run_id is not null").join(a.select("verification_run_id", "page_id").distinct(), ["verification_run_id", "page_id"], "left_anti")
    v = table(spark, d, "vlm_reviews").select("id", "verification_run_id", "page_id", "pair_index").distinct()
    lost = v.join(a.select("verification_run_id", "page_id", "pair_index").distinct(), ["verification_run_id", "page_id", "pair_index"], "left_anti")
    has = ev.runs(spark, d).where("scope is null").select(F.col("id").alias("run_id"), "page_id").join(table(spark, d, "ocr_lines").select("run_id").distinct(), "run_id", "left_semi")
    full = table(spark, d, "page_confirmations").select("id", "page_id").distinct().join(has.select("page_id").distinct(), "page_id", "left_semi")
    return own.unionByName(code(other, "citation_of_other_page")).unionByName(code(lost, "review_without_pair")).unionByName(code(full, "textless_page_with_text"))


# ---------------------------------------------------------------- numerals and text layers


@query("""WITH l AS (SELECT DISTINCT id, trim(text) AS t FROM ocr_lines WHERE length(trim(text)) BETWEEN 1 AND 15),
r AS (SELECT i, (['', 'M', 'MM', 'MMM'])[i // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[(i // 100) % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[(i % 100) // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[i % 10 + 1] AS s FROM range(1, 4000) t(i)),
c AS (SELECT id, t, list_reduce(list_prepend({'t': 0::BIGINT, 'c': 0::BIGINT}, list_transform(string_split(t, ''), lambda x: {'t': CASE x WHEN '十' THEN 10 WHEN '百' THEN 100 WHEN '千' THEN 1000 ELSE 0 END::BIGINT, 'c': (instr('〇一二三四五六七八九零', x) - 1)::BIGINT})), lambda a, b: CASE WHEN b.t = 0 THEN {'t': a.t, 'c': CASE WHEN b.c = 10 THEN 0 ELSE b.c END} ELSE {'t': a.t + CASE WHEN a.c = 0 THEN 1 ELSE a.c END * b.t, 'c': 0::BIGINT} END) AS v FROM l WHERE regexp_full_match(t, '[〇零一二三四五六七八九十百千]{1,6}'))
SELECT id, 'roman' AS scheme, CAST(r.i AS BIGINT) AS value FROM l JOIN r ON r.s = upper(t) AND (t = upper(t) OR t = lower(t))
UNION ALL SELECT id, 'cjk', v.t + v.c FROM c""")
def numerals(spark, d):
    """Lines that are a roman numeral in canonical form (to 3999) or a Chinese one, with its value."""
    t = table(spark, d, "ocr_lines").select("id", F.trim("text").alias("t")).where("length(t) between 1 and 15").distinct()
    t = t.select("id", lb.roman_value(F.col("t")).alias("r"), lb.cjk_value(F.col("t")).alias("c"))
    return t.where("r is not null or c is not null").select("id", F.when(F.col("r").isNotNull(), "roman").otherwise("cjk").alias("scheme"), F.coalesce("r", "c").alias("value"))


@query(f"""WITH {ev._LIN}, {ev._RUN} SELECT r.page_id, r.engine, r.id AS run_id, count(*) AS lines, count(*) FILTER (tokens_reported > 0) AS with_tokens, count(confidence) AS with_confidence, string_agg(text, chr(10) ORDER BY line_index, l.id) AS page_text FROM run r JOIN lin l ON l.run_id = r.id WHERE scope IS NULL GROUP BY 1, 2, 3""")
def text_layer(spark, d):
    """The text of every whole-page reading with what its reader reported."""
    r = ev.runs(spark, d).where("scope is null").select(F.col("id").alias("run_id"), "page_id", "engine")
    g = ev.lines(spark, d).join(r, "run_id").groupBy("page_id", "engine", "run_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("tokens_reported") > 0).alias("with_tokens"), F.count("confidence").alias("with_confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "id", "text"))), lambda s: s["text"]), "\n").alias("page_text"),
    )
    return g


@query(f"""WITH {ev._LIN}, {ev._RUN}, w AS (SELECT page_id, engine, max(id) AS run_id FROM run WHERE scope IS NULL GROUP BY 1, 2), d AS (SELECT w.page_id, w.engine, CASE WHEN count(*) >= 3 AND count(*) FILTER (height >= 1.6 * width) >= 0.6 * count(*) THEN 'vertical' ELSE 'horizontal' END AS seen, any_value(r.direction) AS declared FROM w JOIN lin l ON l.run_id = w.run_id JOIN run r ON r.id = w.run_id GROUP BY 1, 2)
SELECT page_id, count(*) AS readers, min(seen) AS seen, count(DISTINCT seen) = 1 AS same, CASE WHEN count(DISTINCT declared) > 1 THEN 'contradiction' WHEN count(declared) = 0 THEN 'undeclared' ELSE min(declared) END AS declared FROM d GROUP BY 1""")
def resolved_direction(spark, d):
    """The direction of each page from its newest readings: seen in the boxes and declared by the readers."""
    r = ev.runs(spark, d)
    w = journal.latest_engine_run(r).join(r.select(F.col("id").alias("run_id"), "direction"), "run_id")
    tall = F.count_if(F.col("height") >= 1.6 * F.col("width"))
    s = table(spark, d, "ocr_lines").select("id", "run_id", "height", "width").distinct().join(w, "run_id").groupBy("page_id", "engine", "direction").agg(F.when((F.count("*") >= 3) & (tall >= 0.6 * F.count("*")), "vertical").otherwise("horizontal").alias("seen"))
    said = F.countDistinct("direction")
    return s.groupBy("page_id").agg(F.count("*").alias("readers"), F.min("seen").alias("seen"), (F.countDistinct("seen") == 1).alias("same"), F.when(said > 1, "contradiction").when(said == 0, "undeclared").otherwise(F.min("direction")).alias("declared"))


# ---------------------------------------------------------------- what the pages of a book are

_HINTS = " + ".join(f"contains(tx, '{h}')::INT" for h in structure.COPYRIGHT_HINTS)
_NOISE = structure.NOISE_IN_TITLES.replace("'", "''")
_HEADINGS = ", ".join(f"'{h}'" for h in structure.CONTENTS_HEADINGS)


@query(f"""WITH {ev._LABEL}{ev._RUNS}, bo AS (SELECT project_id, first_page, last_page FROM rn QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY pages DESC, first_page DESC, shift DESC, scheme) = 1),
nw AS (SELECT r.page_id, max(r.id) AS run_id FROM run r JOIN lin l ON l.run_id = r.id WHERE scope IS NULL GROUP BY 1),
ln AS (SELECT nw.page_id, l.line_index, l.id, trim(l.text) AS t FROM nw JOIN lin l ON l.run_id = nw.run_id WHERE trim(l.text) <> ''),
pe AS (SELECT page_id, lower(string_agg(t, chr(10) ORDER BY line_index, id)) AS tx, list(t ORDER BY line_index, id) AS ts, count(*) AS n, count(*) FILTER (regexp_matches(t, '^(.{{2,60}}?)(?:[ .…·]{{2,}})([0-9]{{1,4}}|[ivxlc]{{1,8}})$')) AS entries,
 max((length(t) <= 30 AND NOT regexp_matches(t, '[。，；：！？,.;:]$') AND regexp_matches(t, '^(?i:part|partie|teil) [0-9ivxIVX]+|^第[一二三四五六七八九十0-9]+部|^(?i:chapter|chapitre|kapitel) [0-9ivxIVX]+|^第[一二三四五六七八九十0-9]+章|^[0-9]+\\.[0-9]+ |^第[一二三四五六七八九十0-9]+[節节]'))::INT) AS h FROM ln GROUP BY 1),
ik AS (SELECT page_id, max(ink_ratio) AS ink FROM page_confirmations GROUP BY 1),
al AS (SELECT pag.id AS page_id, pag.project_id, pag.page_index, length(tx) AS characters, {_HINTS} AS hints, (len(list_filter(ts[1:3], lambda x: regexp_replace(lower(x), '{_NOISE}', '', 'g') IN ({_HEADINGS}))) > 0 OR (entries >= 3 AND 2 * entries >= n)) AS contents, h = 1 AS headed, pl.page_id IS NOT NULL AS numbered, ink, first_page, last_page
 FROM pag LEFT JOIN pe ON pe.page_id = pag.id LEFT JOIN (SELECT DISTINCT page_id FROM pl) pl ON pl.page_id = pag.id LEFT JOIN ik ON ik.page_id = pag.id LEFT JOIN bo ON bo.project_id = pag.project_id),
bk AS (SELECT project_id, min(page_index) AS first_of_all, min(page_index) FILTER (characters IS NOT NULL) AS first_text FROM al GROUP BY 1)
SELECT al.project_id, page_index, page_id, CASE WHEN characters IS NULL THEN CASE WHEN coalesce(ink >= 0.02, false) THEN CASE WHEN page_index = first_of_all THEN 'cover' ELSE 'plate' END ELSE 'blank' END WHEN hints >= 2 AND NOT numbered THEN 'copyright' WHEN contents THEN 'contents'
 WHEN page_index = first_text AND NOT numbered AND NOT headed AND (characters <= 40 OR coalesce(ink >= 0.5, false)) THEN 'cover' WHEN first_page IS NULL THEN 'unknown' WHEN page_index < first_page THEN 'front_matter' WHEN page_index <= last_page THEN 'body' ELSE 'back_matter' END AS role FROM al JOIN bk ON bk.project_id = al.project_id""")
def book_roles(spark, d):
    """What every page of a book is: cover, copyright, contents, front matter, body, back matter, plate, blank or unknown."""
    placed = ev.placed_lines(spark, d)
    whole = placed.where("scope is null")
    last = whole.groupBy("page_id").agg(F.max("run_id").alias("run_id"))
    labels = structure.page_labels(placed)
    ink = table(spark, d, "page_confirmations").groupBy("page_id").agg(F.max("ink_ratio").alias("ink_ratio"))
    evidence = structure.page_evidence(whole.join(last, ["page_id", "run_id"], "left_semi"))
    return structure.book_roles(ev.pages(spark, d), evidence, labels, ink, structure.body_runs(structure.numbering_runs(labels)))

