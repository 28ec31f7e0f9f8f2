import itertools

from pyspark.sql import functions as F

from versoflow.functions import labels as lb
from versoflow.functions import text as tx
from versoflow.operators import accept, risk, structure

A, WIDE, B = "the end, so", "the end，SO", "the bend, so"
THIRD = [None, (A, False), (WIDE, False), (B, False), ("another", False), (A, True), ("  ", False)]


def fold(t):
    return t.replace("，", ",").lower()


def brute(engines, third):
    present = [t for t in engines if t is not None]
    if not present:
        return None, None, "no_engine_text"
    groups = {}
    for t in present:
        groups.setdefault(fold(t), []).append(t)
    best = max(groups.values(), key=len)
    if len(best) >= 2:
        if len(best) == len(present):
            return best[0], "automatic", "engines_agree" if len(set(best)) == 1 else "variant_agreement"
        return best[0], "automatic", "majority_agreement"
    if third is None:
        return None, None, "missing_engine_text" if len(present) < 2 else "engines_disagree"
    text, uncertain = third
    if uncertain:
        return None, None, "vlm_uncertain"
    if not text.strip():
        return None, None, "vlm_blank"
    return (text, "vlm", "vlm_confident") if fold(text) in groups else (None, None, "vlm_uncorroborated")


def test_every_case_of_three_readers_and_a_third_reading(spark):
    cases = list(enumerate(itertools.product(itertools.product([A, WIDE, B, None], repeat=3), THIRD)))
    readings = spark.createDataFrame([(k, p, t) for k, (engines, _) in cases for p, t in enumerate(engines)], "line int, position int, text string")
    third = spark.createDataFrame([(k, *v) for k, (_, v) in cases if v], "line int, vlm_text string, vlm_uncertain boolean")
    got = accept.corroborated(accept.agreement(readings, ["line"]).join(third, "line", "left")).collect()
    assert {r.line: (r.proposed, r.actor, r.rationale) for r in got} == {k: brute(*c) for k, c in cases}
    assert accept.agreement(readings.where("false"), ["line"]).count() == 0


def test_blockers_in_their_order(spark):
    rows = [("ok", [], 0.0, None), (" ", [], 0.0, 0.9), ("a�", ["spatial_mismatch", "unicode_anomaly"], 0.5, 0.2), ("a\tb", ["alignment_ambiguity"], 0.34, 0.3), ("soft­", None, None, None)]
    df = spark.createDataFrame(rows, "t string, r array<string>, c double, m double")
    got = [x.b for x in df.select(accept.blockers(F.col("t"), F.col("r"), F.col("c"), F.col("m")).alias("b")).collect()]
    assert got == [[], ["blank_text"], ["unrepresentable_text", "unicode_anomaly", "spatial_mismatch", "high_content_risk", "low_confidence"], ["alignment_ambiguity"], ["unrepresentable_text"]]


def test_risk_of_ambiguous_pairs_and_of_the_evidence_alone(spark):
    df = spark.createDataFrame([("a", "b", 0.5, 0.1, False), ("a", "a", None, None, True)], "primary_text string, secondary_text string, min_confidence double, shift double, ambiguous boolean")
    got = [(round(r.score, 2), round(r.content_score, 2), r.reasons) for r in risk.assess(df).collect()]
    assert got == [(0.85, 0.4, ["text_conflict", "low_confidence", "spatial_mismatch"]), (1.0, 0.0, ["alignment_ambiguity"])]


def test_numerals(spark):
    rows = ["iv", "MCMXCIX", "iiii", "Iv", "mix", "十二", "二十三", "三百", "一千零五", "〇", "", None, "12"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [(r.a, r.b) for r in df.select(lb.roman_value(F.col("t")).alias("a"), lb.cjk_value(F.col("t")).alias("b")).collect()]
    assert got == [(4, None), (1999, None), (None, None), (None, None), (1009, None), (None, 12), (None, 23), (None, 300), (None, 1005), (None, 0), (None, None), (None, None), (None, None)]


def test_comparison_key_keeps_blanks(spark):
    df = spark.createDataFrame([("ＡＢ，ｃ「d」", "New York"), (None, "NewYork")], "a string, b string")
    rows = df.select(tx.fold_comparison(F.col("a")).alias("a"), tx.fold_comparison(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [('ab,c"d"', "new york"), (None, "newyork")]


LINES = "project_id bigint, page_id bigint, page_index bigint, run_id bigint, id bigint, line_index bigint, text string, x double, y double, width double, height double"


def test_furniture_needs_sequence_or_repetition(spark):
    rows, k = [], 0
    for p in range(4):
        for i, (t, y) in enumerate([("A HEAD", 0.04), ("body text", 0.5), (str(p + 7), 0.96), ("40", 0.97)]):
            k += 1
            rows.append((1, p, p, p, k, i, t, 0.1, y, 0.5, 0.02))
    rows.append((1, 9, 9, 9, 99, 0, "A HEAD", 0.1, 0.04, 0.5, 0.02))
    got = {(r.page_id, r.line_index, r.reason) for r in structure.page_furniture(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {(p, 0, "repeated_in_margin") for p in range(4)} | {(p, 2, "page_number") for p in range(4)}
    assert structure.page_furniture(spark.createDataFrame([], LINES)).count() == 0


def test_roles_of_a_book(spark):
    texts = {0: None, 1: ["The Book"], 2: ["ISBN 1", "印刷 2"], 3: ["Contents", "one ..... 1"], 4: ["preface text " * 9], 5: ["body " * 20], 6: ["body " * 20], 7: None, 8: None, 9: ["index " * 20]}
    lines = spark.createDataFrame([(p, i, 10 * p + i, t) for p, ts in texts.items() for i, t in enumerate(ts or [])], "page_id bigint, line_index bigint, id bigint, text string")
    pages = spark.createDataFrame([(p, 1, p) for p in texts], "id bigint, project_id bigint, page_index bigint")
    labels = spark.createDataFrame([(5,), (6,)], "page_id bigint")
    ink = spark.createDataFrame([(0, 0.4), (7, 0.3), (8, 0.001)], "page_id bigint, ink_ratio double")
    body = spark.createDataFrame([(1, 5, 6)], "project_id bigint, first_page bigint, last_page bigint")
    got = {r.page_index: r.role for r in structure.book_roles(pages, structure.page_evidence(lines), labels, ink, body).collect()}
    assert got == {0: "cover", 1: "cover", 2: "copyright", 3: "contents", 4: "front_matter", 5: "body", 6: "body", 7: "plate", 8: "blank", 9: "back_matter"}
    alone = structure.book_roles(pages, structure.page_evidence(lines.where("false")), labels.where("false"), ink.where("false"), body.where("false"))
    assert {r.role for r in alone.collect()} == {"blank"}
