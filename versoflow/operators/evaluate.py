"""Evaluation of readings: words, punctuation, missing lines, boxes, groups, page sequences, page turns."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from versoflow.functions import geometry as gm
from versoflow.functions import labels as lb
from versoflow.functions import text as tx

# Languages written without spaces between words; they have no word error rate.
UNSPACED = ("zh", "cmn", "yue", "lzh", "ja", "und", "")


def word_errors(reference: Column, hypothesis: Column, language: Column) -> Column:
    """``struct<edits, words>`` of two texts, null for languages without spaced words.

    Each distinct word becomes one private character, so the engine's own edit distance
    counts words; the JVM does it all.
    """
    split = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")
    r, h = split(F.coalesce(reference, F.lit(""))), split(F.coalesce(hypothesis, F.lit("")))
    known = F.array_distinct(F.concat(r, h))
    coded = lambda ws: F.array_join(F.transform(ws, lambda w: _private(F.array_position(known, w))), "")
    applies = ~F.coalesce(F.lower(F.split(language, "-")[0]), F.lit("")).isin(*UNSPACED)
    return F.when(applies, F.struct(F.levenshtein(coded(r), coded(h)).alias("edits"), F.size(r).alias("words")))


def _private(n: Column) -> Column:
    """The n-th character of the private planes as UTF-16 text; 63,000 words of a text are told apart."""
    c = n.cast("int") + 0xF0000 - 1
    b = F.concat(
        F.lpad(F.hex(F.lit(0xF0) + F.shiftright(c, 18)), 2, "0"), F.lpad(F.hex(F.lit(0x80) + F.shiftright(c, 12).bitwiseAND(F.lit(63))), 2, "0"),
        F.lpad(F.hex(F.lit(0x80) + F.shiftright(c, 6).bitwiseAND(F.lit(63))), 2, "0"), F.lpad(F.hex(F.lit(0x80) + c.bitwiseAND(F.lit(63))), 2, "0"),
    )
    return F.decode(F.unhex(b), "UTF-8")


def punctuation_accuracy(reference: Column, hypothesis: Column) -> Column:
    """1 less the edit distance of the marks over the reference's marks, at least 0; without marks 1 or 0."""
    marks = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^!-/:-@\\[-`{-~，。！？；：、“”‘’「」『』…—–]", "")
    r, h = marks(reference), marks(hypothesis)
    d = F.levenshtein(r, h)
    return F.when(F.length(r) > 0, F.greatest(F.lit(0.0), 1 - d / F.length(r))).when(d == 0, F.lit(1.0)).otherwise(F.lit(0.0))


LINE_ERRORS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("missing", "extra", "changed")])


def _left_over(a: list, b: list) -> tuple[list[int], list[int]]:
    """Lines of both that no longest common subsequence holds; of equally long ones that which drops from the second first, seen from the end."""
    n, m = len(a), len(b)
    rows = [[0] * (m + 1)]
    for x in a:
        up, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(up[j + 1], row[j]))
        rows.append(row)
    left, right = [], []
    i, j = n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or rows[i][j - 1] >= rows[i - 1][j]):
            j -= 1
            right.append(j)
        else:
            i -= 1
            left.append(i)
    return left, right


@F.pandas_udf(LINE_ERRORS)
def line_errors(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Lines that the longest common subsequence leaves over on each side, and how many of them are alike (0.5 and more), in order of likeness.

    Changed lines are counted beside the missing and extra ones, not taken from them.
    """
    rows = []
    for a, b in zip(reference, hypothesis, strict=True):
        a, b = list(a if a is not None else []), list(b if b is not None else [])
        left, right = _left_over(a, b)
        near = sorted((-difflib.SequenceMatcher(None, a[i] or "", b[k] or "", autojunk=False).ratio(), i, k) for i in left for k in right)
        used_a: set[int] = set()
        used_b: set[int] = set()
        for score, i, k in near:
            if -score >= 0.5 and i not in used_a and k not in used_b:
                used_a.add(i)
                used_b.add(k)
        rows.append((len(left), len(right), len(used_a)))
    return pd.DataFrame(rows, columns=["missing", "extra", "changed"])


def box_matches(reference: DataFrame, hypothesis: DataFrame, least: float = 0.5) -> DataFrame:
    """``page_id, matched, reference_lines, hypothesis_lines``: boxes matched one to one, best overlap first.

    Candidates meet through bands of the page's height, so no box meets all others.
    """
    band = lambda df, p: df.select("page_id", F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "width", "height")], F.explode(F.sequence(F.floor(F.col("y") * 20).cast("int"), F.floor((F.col("y") + F.col("height")) * 20).cast("int"))).alias("band"))
    c = F.col
    j = band(reference, "r").join(band(hypothesis, "h"), ["page_id", "band"]).drop("band")
    j = j.withColumn("iou", gm.iou(c("r_x"), c("r_y"), c("r_width"), c("r_height"), c("h_x"), c("h_y"), c("h_width"), c("h_height"))).where(c("iou") >= least).select("page_id", "r_id", "h_id", "iou").distinct()

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        r: set[int] = set()
        h: set[int] = set()
        for x in pdf.sort_values(["iou", "r_id", "h_id"], ascending=[False, True, True]).itertuples():
            if x.r_id not in r and x.h_id not in h:
                r.add(x.r_id)
                h.add(x.h_id)
        return pd.DataFrame({"page_id": [pdf.page_id.iloc[0]], "matched": [len(r)]})

    hits = j.groupBy("page_id").applyInPandas(greedy, "page_id bigint, matched bigint")
    n = reference.groupBy("page_id").agg(F.count("*").alias("reference_lines")).join(hypothesis.groupBy("page_id").agg(F.count("*").alias("hypothesis_lines")), "page_id", "full_outer")
    return n.join(hits, "page_id", "left").select("page_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("reference_lines", F.lit(0)).alias("reference_lines"), F.coalesce("hypothesis_lines", F.lit(0)).alias("hypothesis_lines"))


def group_scores(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Hits, false and missed groups (``primary_members, secondary_members``) with precision, recall and F1; 1 where there is nothing."""
    cols = [key, "primary_members", "secondary_members"]
    t = truth.select(*cols).distinct().withColumn("t", F.lit(1))
    f = found.select(*cols).distinct().withColumn("f", F.lit(1))
    g = t.join(f, cols, "full_outer").groupBy(key).agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(F.lit(1.0))
    p, r = ratio(F.col("tp"), F.col("fp")), ratio(F.col("tp"), F.col("fn"))
    return g.select(key, "tp", "fp", "fn", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"))


def sequences(labels: DataFrame, gap: int = 3) -> DataFrame:
    """``project_id, page_index, run, ordinal``: labels in monotone runs.

    Steps of 1 to ``gap`` go on, a step back or another scheme begins a run, a greater
    step is a misread label and dropped without moving on; runs of one page are dropped.
    A fold per book: the dropped labels make a plain lag wrong.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        run, last, scheme, rows = 0, None, None, []
        for x in pdf.sort_values(["page_index", "value"]).itertuples():
            if last is not None and scheme == x.scheme and x.value - last > gap:
                continue
            if last is None or scheme != x.scheme or x.value <= last:
                run += 1
            rows.append((x.project_id, x.page_index, run, x.value))
            last, scheme = x.value, x.scheme
        out = pd.DataFrame(rows, columns=["project_id", "page_index", "run", "value"])
        out = out[out.groupby("run").run.transform("size") > 1].copy()
        out["ordinal"] = out.run * 1_000_000 + out.value
        return out[["project_id", "page_index", "run", "ordinal"]]

    return labels.groupBy("project_id").applyInPandas(fold, "project_id bigint, page_index bigint, run bigint, ordinal bigint")


def contents_to_pages(entries: DataFrame, labels: DataFrame, headings: DataFrame) -> DataFrame:
    """``project_id, entry_no, title, label, page_index``: contents entries anchored on pages, null where unmapped.

    A page is a candidate if it has the printed number of the entry and a heading. Of the
    candidates those whose heading holds the title (or the title it) decide; without one a
    single candidate is taken. Numbers alone say little, as parts of a book begin anew.
    An entry that no number places goes to the first page with just that heading.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s.,;:!?·…–—-]+", ""))
    e = entries.withColumn("value", lb.label_value(F.col("label"))).withColumn("scheme", lb.label_scheme(F.col("label"))).withColumn("k", key(F.col("title")))
    h = headings.groupBy("project_id", "page_index").agg(F.collect_set(key(F.col("title"))).alias("hs"))
    c = e.join(labels.select("project_id", "scheme", "value", "page_index").distinct(), ["project_id", "scheme", "value"]).join(h, ["project_id", "page_index"])
    match = F.exists("hs", lambda x: (F.length(x) >= 2) & (F.length(F.col("k")) >= 2) & (F.contains(x, F.col("k")) | F.contains(F.col("k"), x)))
    g = c.groupBy("project_id", "entry_no").agg(F.min(F.when(match, F.col("page_index"))).alias("sure"), F.countDistinct("page_index").alias("n"), F.min("page_index").alias("only"))
    g = g.select("project_id", "entry_no", F.coalesce("sure", F.when(F.col("n") == 1, F.col("only"))).alias("page_index"))
    same = headings.select("project_id", "page_index", key(F.col("title")).alias("k"))
    by_heading = e.where(F.length("k") >= 2).join(same, ["project_id", "k"]).groupBy("project_id", "entry_no").agg(F.min("page_index").alias("by_heading"))
    j = entries.join(g, ["project_id", "entry_no"], "left").join(by_heading, ["project_id", "entry_no"], "left")
    return j.select("project_id", "entry_no", "title", "label", F.coalesce("page_index", "by_heading").alias("page_index"))


def page_turns(pages: DataFrame) -> DataFrame:
    """``project_id, page_index, flow``: pages whose text runs on share a flow.

    ``pages`` has ``project_id, page_index, first_text, first_indented, last_text``; text
    runs on to the next page if that is the next in number, the last line ends no sentence
    and the first one is not indented.
    """
    by = W.partitionBy("project_id").orderBy("page_index")
    p = pages.withColumn("_prev", F.lag("page_index").over(by)).withColumn("_last", F.lag("last_text").over(by))
    on = (F.col("page_index") - F.col("_prev") == 1) & ~tx.ends_sentence(F.col("_last")) & ~F.col("first_indented")
    p = p.withColumn("_new", (~F.coalesce(on, F.lit(False))).cast("int"))
    return p.select("project_id", "page_index", F.sum("_new").over(by).alias("flow"))


def escalated_region(x: Column, y: Column, w: Column, h: Column, attempt: Column, base: float = 0.01, step: float = 0.02, most: float = 0.10, scale_most: int = 4) -> Column:
    """The region read again at an attempt: wider each time, and enlarged."""
    pad = F.least(F.lit(most), F.lit(base) + F.lit(step) * attempt)
    x0, y0 = F.greatest(F.lit(0.0), x - pad), F.greatest(F.lit(0.0), y - pad)
    return F.struct(x0.alias("x"), y0.alias("y"), (F.least(F.lit(1.0), x + w + pad) - x0).alias("width"), (F.least(F.lit(1.0), y + h + pad) - y0).alias("height"), F.least(F.lit(scale_most), 1 + attempt).alias("scale"))
