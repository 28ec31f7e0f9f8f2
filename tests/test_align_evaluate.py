import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from versoflow.functions import geometry as gm
from versoflow.functions import labels as lb
from versoflow.functions import text as tx
from versoflow.operators import align, evaluate, journal, measure, risk, structure

COLS = ["page_id", "line_index", "text", "x", "y", "height"]


def side(*lines):
    return pd.DataFrame([(1, k, t, 0.1, y, 0.018) for k, (t, y) in enumerate(lines)], columns=COLS)


def test_one_line_against_two_halves():
    got = align.align_page(side(("the garden of the merchant", 0.2), ("was closed", 0.3)), side(("the garden", 0.2), ("of the merchant", 0.201), ("was closed", 0.3)))
    assert [(a, b) for a, b, _ in got] == [([0], [0, 1]), ([1], [2])]


def test_missing_and_distant_lines_stay_alone():
    got = align.align_page(side(("alpha beta", 0.2), ("gamma delta", 0.4)), side(("gamma delta", 0.4), ("epsilon", 0.8)))
    assert [(a, b) for a, b, _ in got] == [([0], []), ([1], [0]), ([], [1])]


def test_equal_texts_are_told_apart_by_place():
    got = align.align_page(side(("same", 0.2), ("same", 0.6)), side(("same", 0.6)))
    assert [(a, b) for a, b, _ in got] == [([0], []), ([1], [0])]


def boxes(*lines):
    return pd.DataFrame([(1, k, t, *b) for k, (t, b) in enumerate(lines)], columns=["page_id", "line_index", "text", "x", "y", "width", "height"])


def test_columns_go_before_equal_texts():
    left, right = lambda y: (0.05, y, 0.35, 0.04), lambda y: (0.6, y, 0.35, 0.04)
    p = boxes(("same words", left(0.2)), ("same words", right(0.2)), ("next line", left(0.36)), ("next line", right(0.36)))
    s = boxes(("same words", right(0.21)), ("same words", left(0.21)), ("next line", right(0.37)), ("next line", left(0.37)))
    assert {(*a, *b) for a, b, _ in align.align_page(p, s)} == {(0, 1), (1, 0), (2, 3), (3, 2)}


@pytest.mark.parametrize("direction", ["vertical-rl", "vertical-lr"])
def test_upright_columns_split_and_merged(direction):
    p = boxes(("右列完整文字", (0.7, 0.1, 0.05, 0.4)), ("左列", (0.4, 0.1, 0.05, 0.19)), ("完整文字", (0.4, 0.31, 0.05, 0.19)))
    s = boxes(("右列", (0.7, 0.1, 0.05, 0.19)), ("完整文字", (0.7, 0.31, 0.05, 0.19)), ("左列完整文字", (0.4, 0.1, 0.05, 0.4)))
    assert sorted((a, b) for a, b, _ in align.align_page(p, s, direction)) == [([0], [0, 1]), ([1, 2], [2])]


def test_close_alternatives_are_ambiguous_and_turned_text_is_not_forced():
    p = boxes(("same words here", (0.1, 0.3, 0.6, 0.04)))
    s = boxes(("same words here", (0.1, 0.29, 0.6, 0.04)), ("same words here", (0.1, 0.31, 0.6, 0.04)))
    got = align.align_page_with_doubt(p, s)
    assert [x[3] for x in got if x[0] and x[1]] == [True]
    turned = align.align_page(boxes(("turned line", (0.1, 0.2, 0.8, 0.05))), boxes(("turned line", (0.1, 0.2, 0.05, 0.8))), "horizontal-lr")
    assert not [x for x in turned if x[0] and x[1]]
    sure = align.align_page_with_doubt(boxes(("one", (0.1, 0.2, 0.6, 0.04)), ("two", (0.1, 0.4, 0.6, 0.04))), boxes(("one", (0.1, 0.2, 0.6, 0.04)), ("two", (0.1, 0.4, 0.6, 0.04))))
    assert not any(x[3] for x in sure)


def test_align_pages_nulls_and_lonely_pages(spark):
    mk = lambda rows: spark.createDataFrame(rows, "page_id bigint, line_index bigint, text string, x double, y double, height double")
    a = mk([(1, 0, "a b c", 0.1, 0.2, 0.02), (1, 1, None, 0.1, 0.4, 0.02), (2, 0, "x", 0.1, 0.2, 0.02)])
    b = mk([(1, 0, "a b c", 0.1, 0.2, 0.02), (3, 0, "y", None, None, None)])
    got = {(r.page_id, tuple(r.primary_members), tuple(r.secondary_members)) for r in align.align_pages(a, b).collect()}
    assert got == {(1, (0,), (0,)), (1, (1,), ()), (2, (0,), ()), (3, (), (0,))}
    assert align.align_pages(a.where("false"), b.where("false")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_errors_against_brute_force(spark):
    texts = ["a b c", "a  c b", "", None, "b b b a", "x a b c y"]
    rows = list(itertools.product(texts, texts, ["en-GB", "zh", None]))
    df = spark.createDataFrame(rows, "r string, h string, lang string").withColumn("e", evaluate.word_errors(F.col("r"), F.col("h"), F.col("lang")))
    for r in df.collect():
        if r.lang != "en-GB":
            assert r.e is None
        else:
            a, b = (r.r or "").split(), (r.h or "").split()
            assert (r.e.edits, r.e.words) == (levenshtein(a, b), len(a))


def test_line_errors(spark):
    df = spark.createDataFrame([(["a b", "c d", "e f"], ["a b", "c x", "g", "e f"]), ([], ["q"]), (None, [])], "r array<string>, h array<string>")
    assert [tuple(r.e) for r in df.select(evaluate.line_errors("r", "h").alias("e")).collect()] == [(1, 2, 1), (0, 1, 0), (0, 0, 0)]
    chars = spark.createDataFrame([(list("123AB"), list("AB1x2y3"))], "r array<string>, h array<string>")
    assert tuple(chars.select(evaluate.line_errors("r", "h").alias("e")).first().e) == (2, 4, 2)


def test_box_matches_one_to_one(spark):
    mk = lambda rows: spark.createDataFrame(rows, "page_id bigint, id bigint, x double, y double, width double, height double")
    r = mk([(1, 1, 0.1, 0.1, 0.5, 0.1), (1, 2, 0.1, 0.3, 0.5, 0.1), (2, 3, 0.1, 0.1, 0.5, 0.1)])
    h = mk([(1, 7, 0.1, 0.1, 0.5, 0.1), (1, 8, 0.1, 0.11, 0.5, 0.1), (3, 9, 0.0, 0.0, 0.0, 0.0)])
    got = {r.page_id: (r.matched, r.reference_lines, r.hypothesis_lines) for r in evaluate.box_matches(r, h).collect()}
    assert got == {1: (1, 2, 2), 2: (0, 1, 0), 3: (0, 0, 1)}


def test_sequences_drop_misread_labels(spark):
    rows = [(1, k, "arabic", v) for k, v in enumerate([1, 2, 30, 3, 4, 1, 2])] + [(2, 0, "roman", 1), (2, 1, "arabic", 2)]
    got = {(r.project_id, r.page_index): (r.run, r.ordinal) for r in evaluate.sequences(spark.createDataFrame(rows, "project_id bigint, page_index bigint, scheme string, value int")).collect()}
    assert got == {(1, 0): (1, 1000001), (1, 1): (1, 1000002), (1, 3): (1, 1000003), (1, 4): (1, 1000004), (1, 5): (2, 2000001), (1, 6): (2, 2000002)}


def test_contents_are_anchored_by_label_and_heading(spark):
    e = spark.createDataFrame([(1, 0, "The Garden", "12"), (1, 1, "The Sea…", "xx"), (1, 2, "Lost", None), (1, 3, "The River", "3"), (1, 4, "Nowhere", "12")], "project_id bigint, entry_no int, title string, label string")
    lab = spark.createDataFrame([(1, "arabic", 12, 14), (1, "arabic", 12, 44), (1, "arabic", 3, 5), (1, "arabic", 3, 50)], "project_id bigint, scheme string, value int, page_index bigint")
    hd = spark.createDataFrame([(1, 30, "THE SEA"), (1, 14, "II. The Garden"), (1, 44, "Sands"), (1, 50, "Rivers")], "project_id bigint, page_index bigint, title string")
    got = {r.entry_no: r.page_index for r in evaluate.contents_to_pages(e, lab, hd).collect()}
    # Page 5 has the number of entry 3 and no heading; two pages have that of entry 4 and no such heading.
    assert got == {0: 14, 1: 30, 2: None, 3: 50, 4: None}


def test_labels(spark):
    texts = ["12", "[ 7 ]", "— iv —", "IV", "iIv", "p. 9", "十二", "0", "abc", "", None, "1234567", "IC"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.s, r.v) for r in df.select(lb.label_scheme(F.col("t")).alias("s"), lb.label_value(F.col("t")).alias("v")).collect()]
    assert got[:7] == [("arabic", 12), ("arabic", 7), ("roman", 4), ("roman", 4), ("unnumbered", None), ("arabic", 9), ("cjk", 12)]
    assert all(s == "unnumbered" and v is None for s, v in got[7:])
    assert lb.roman(94) == "XCIV" and lb.cjk(20) == "二十" and lb.cjk(7) == "七"


def test_text_rules(spark):
    df = spark.createDataFrame([("a", "b"), ("a-", "b"), ("山", "b"), (None, "b"), ("a", "")], "l string, r string")
    assert [r[0] for r in df.select(tx.join_lines(F.col("l"), F.col("r"))).collect()] == ["a b", "a-b", "山b", "b", "a"]
    a = spark.createDataFrame([(["the", "end", None, "1", "2", "山"],), ([],)], "t array<string>")
    assert [r[0] for r in a.select(tx.assemble(F.col("t"))).collect()] == ["the end 12山".replace("end 1", "end 1"), ""]
    s = spark.createDataFrame([("a.",), ('a."',), ("a",), ("山。」",), (None,)], "t string")
    assert [r[0] for r in s.select(tx.ends_sentence(F.col("t"))).collect()] == [True, True, False, True, None]


def test_votes(spark):
    rows = [(1, "a", "x", "X"), (1, "b", "x", "x"), (1, "c", "y", "y"), (2, "a", "x", "x"), (2, "b", "y", "y"), (3, "a", "x", "x"), (3, "a", "x", "x"), (4, "a", None, None), (5, "a", "x", "x"), (5, "b", "x", "x")]
    got = {r.k: (r.text, r.rationale) for r in measure.vote(spark.createDataFrame(rows, "k int, source string, fold string, text string"), ["k"]).collect()}
    assert got == {1: ("X", "majority"), 2: (None, "tie"), 3: (None, "single_reader"), 5: ("x", "unanimous")}


def test_intervals_streaks_and_comparisons(spark):
    df = spark.createDataFrame([(5, 10), (0, 0), (15, 10)], "e int, n int")
    low, high = measure.wilson(F.col("e"), F.col("n"))
    r = df.select(low.alias("l"), high.alias("h"), measure.error_rate(F.col("e"), F.col("n")).alias("r")).collect()
    assert r[0].l == pytest.approx(0.2366, abs=1e-3) and r[0].h == pytest.approx(0.7634, abs=1e-3) and r[1].l is None and r[1].r == 0.0 and r[2].h >= 1.5
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("a", 4, 3.0), ("b", 1, 3.0), ("b", 2, 1.0)], "k string, t int, v double")
    assert {x.k: (x.points, x.streak) for x in measure.streak(s, ["k"], "t", "v").collect()} == {"a": (2, 2), "b": (1, 0)}
    o, n = (spark.createDataFrame(x, "k int, v double") for x in ([(1, 1.0), (2, 1.0), (3, None)], [(1, 0.5), (3, 1.0), (4, 1.0)]))
    assert {x.k: x.status for x in measure.compare(o, n, ["k"], "v").collect()} == {1: "improved", 2: "missing", 3: "unavailable", 4: "new"}


def test_risk_reasons(spark):
    rows = [("ab", "ab", 0.9, 0.0), ("ab", "AB", 0.9, 0.0), ("ab", "cb", 0.5, 0.1), ("ab", None, None, None), ("ab.", "ab,", 0.9, 0.0), (None, None, None, None)]
    got = [(round(r.score, 2), r.reasons) for r in risk.assess(spark.createDataFrame(rows, "primary_text string, secondary_text string, min_confidence double, shift double")).collect()]
    assert got == [(0.0, []), (0.1, ["variant"]), (0.85, ["text_conflict", "low_confidence", "spatial_mismatch"]), (0.55, ["missing_line"]), (0.2, ["punctuation_conflict"]), (0.0, [])]


def test_citations_and_geometry(spark):
    rows = [(["verification_run:7"],), (["verification_run:7", "verification_run:8"],), (["verification_run:07"],), ([],), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "r array<string>").select(journal.cited_run(F.col("r"))).collect()] == [7, None, None, None, None]
    one = spark.range(1)
    poly = F.array(F.array(F.lit(10.0), F.lit(-5.0)), F.array(F.lit(60.0), F.lit(50.0)))
    assert one.select(gm.polygon_box(poly, F.lit(100.0), F.lit(100.0))).first()[0] == pytest.approx([0.1, 0.0, 0.5, 0.5])
    assert one.select(gm.iou(*[F.lit(v) for v in (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)])).first()[0] == 0.0


def test_chapter_asof_front_matter(spark):
    p = spark.createDataFrame([(1, k) for k in range(5)], "project_id bigint, page_index bigint")
    c = spark.createDataFrame([(1, 1, "A", 2, 3), (1, 2, "B", 4, None)], "project_id bigint, ordinal int, title string, start_page bigint, end_page bigint")
    assert {r.page_index: r.chapter for r in structure.chapter_of_pages(p, c).collect()} == {0: None, 1: None, 2: "A", 3: "A", 4: "B"}
