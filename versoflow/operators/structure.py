"""Book structure: margins, labels, chapters, roles, paragraphs and their flow over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.functions import labels as lb
from versoflow.functions import text as tx

#: Margin bands: where repeated lines are looked for, and where labels are.
FURNITURE_BAND, LABEL_BAND = 0.08, 0.10
#: Pages on which a margin text must stand.
REPEAT_PAGES = 3


def in_margin(y: Column, h: Column, band: float) -> Column:
    return (y < band) | (y + h > 1 - band)


def repeated_margins(lines: DataFrame, band: float = FURNITURE_BAND, pages: int = REPEAT_PAGES) -> DataFrame:
    """``project_id, margin_text, pages``: margin texts, widths folded, on at least so many pages."""
    m = lines.where(in_margin(F.col("y"), F.col("height"), band)).withColumn("margin_text", tx.fold_width(F.trim("text"))).where("margin_text <> ''")
    return m.groupBy("project_id", "margin_text").agg(F.countDistinct("page_id").alias("pages")).where(F.col("pages") >= pages)


def page_furniture(lines: DataFrame, band: float = FURNITURE_BAND, pages: int = REPEAT_PAGES) -> DataFrame:
    """``id, page_id, run_id, line_index, reason`` of margin lines that are no text of the page.

    ``page_number``: the value keeps one distance to the page's place on two pages at
    least. ``repeated_in_margin``: the folded text stands at the margin of so many pages; a
    number out of sequence never is, a roman one may be a title. The margin of an upright
    page lies left and right. A page's only line is text.
    """
    of_run = lines.groupBy("run_id").agg((F.sum("height") > F.sum("width")).alias("up"), F.count("*").alias("lines"))
    edge = lambda a, size: (F.col(a) <= band) | (F.col(a) + F.col(size) >= 1 - band)
    m = lines.join(of_run, "run_id").where(F.when(F.col("up"), edge("x", "width")).otherwise(edge("y", "height")))
    t = F.trim("text")
    m = m.withColumn("key", tx.fold_comparison(F.col("text"))).withColumn("scheme", lb.label_scheme(t)).withColumn("shift", F.when(F.col("scheme") != "unnumbered", lb.label_value(t)) - F.col("page_index"))
    runs = m.where("shift is not null").groupBy("project_id", "scheme", "shift").agg(F.countDistinct("page_index").alias("n")).where("n >= 2").select("project_id", "scheme", "shift", F.lit(True).alias("_run"))
    heads = m.where("key <> ''").groupBy("project_id", "key").agg(F.countDistinct("page_id").alias("n")).where(F.col("n") >= pages).select("project_id", "key", F.lit(True).alias("_head"))
    j = m.where("lines > 1").join(runs, ["project_id", "scheme", "shift"], "left").join(heads, ["project_id", "key"], "left")
    reason = F.when(F.col("_run"), "page_number").when(F.col("_head") & F.col("scheme").isin("unnumbered", "roman"), "repeated_in_margin")
    return j.withColumn("reason", reason).where("reason is not null").select("id", "page_id", "run_id", "line_index", "reason")


def page_labels(lines: DataFrame) -> DataFrame:
    """First numbered margin line of each page: ``project_id, page_id, page_index, scheme, value``."""
    m = lines.where(in_margin(F.col("y"), F.col("height"), LABEL_BAND)).withColumn("scheme", lb.label_scheme(F.trim("text"))).where("scheme <> 'unnumbered'")
    m = m.withColumn("value", lb.label_value(F.trim("text")))
    return m.groupBy("project_id", "page_id", "page_index").agg(F.min_by(F.struct("scheme", "value"), F.struct("line_index", "value")).alias("_l")).select("project_id", "page_id", "page_index", "_l.scheme", "_l.value")


def numbering_runs(labels: DataFrame) -> DataFrame:
    """Pages whose label keeps one distance to the page's place: ``project_id, scheme, shift, first_page, last_page, pages``; a run has two pages at least."""
    s = labels.withColumn("shift", F.col("value") - F.col("page_index"))
    g = s.groupBy("project_id", "scheme", "shift").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.countDistinct("page_index").alias("pages"))
    return g.where("pages >= 2")


def body_runs(runs: DataFrame) -> DataFrame:
    """The longest numbering run of each project; the later one of equals."""
    best = W.partitionBy("project_id").orderBy(F.desc("pages"), F.desc("first_page"), F.desc("shift"), "scheme")
    return runs.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def chapters(lines: DataFrame) -> DataFrame:
    """``project_id, ordinal, title, start_page, end_page``: each heading's chapter ends before the next one's page."""
    h = lines.withColumn("title", F.trim("text")).where(lb.entry_kind(F.col("title")) == "chapter").groupBy("project_id", "page_index").agg(F.min_by("title", F.struct("line_index", "title")).alias("title"))
    by = W.partitionBy("project_id").orderBy("page_index")
    return h.select("project_id", F.row_number().over(by).alias("ordinal"), "title", F.col("page_index").alias("start_page"), (F.lead("page_index").over(by) - 1).alias("end_page"))


def chapter_of_pages(pages: DataFrame, chapters_: DataFrame) -> DataFrame:
    """As-of join: the last chapter that begins on or before each page, null in the front matter.

    Both sides are laid in one order per project and the last title is carried on, so no
    page is compared with every chapter.
    """
    p = pages.select("project_id", "page_index", F.lit(None).cast("string").alias("title"), F.lit(1).alias("_k"))
    c = chapters_.select("project_id", F.col("start_page").alias("page_index"), "title", F.lit(0).alias("_k"))
    by = W.partitionBy("project_id").orderBy("page_index", "_k").rowsBetween(W.unboundedPreceding, 0)
    return p.unionByName(c).withColumn("chapter", F.last("title", ignorenulls=True).over(by)).where("_k = 1").select("project_id", "page_index", "chapter")


def page_metrics(lines: DataFrame) -> DataFrame:
    """Left margin, right measure and median distance of the lines of a run."""
    by = W.partitionBy("run_id").orderBy("y", "x", "line_index")
    g = lines.withColumn("step", F.col("y") - F.lag("y").over(by)).groupBy("run_id").agg(F.min("x").alias("left"), F.max(F.col("x") + F.col("width")).alias("right"), F.median(F.when(F.col("step") > 0, F.col("step"))).alias("gap"))
    return g


def paragraphs(lines: DataFrame) -> DataFrame:
    """``run_id, paragraph, first_line, lines, text``: lines joined until a break.

    A line begins a paragraph if it is the first, stands 1.6 usual distances below the one
    before, or is indented after a line that ends a sentence or falls short of the measure.
    """
    m = page_metrics(lines)
    by = W.partitionBy("run_id").orderBy("line_index", "id")
    j = lines.join(m, "run_id")
    prev = lambda c: F.lag(c).over(by)
    j = j.withColumn("_end", F.col("x") + F.col("width")).withColumn("_done", tx.ends_sentence(F.col("text")))
    indent = F.col("x") - F.col("left") > 0.02
    short = F.col("right") - prev("_end") > 0.05
    far = F.col("y") - prev("y") > 1.6 * F.col("gap")
    starts = prev("id").isNull() | F.coalesce(far, F.lit(False)) | (indent & F.coalesce(prev("_done") | short, F.lit(False)))
    j = j.withColumn("_starts", starts.cast("int")).withColumn("paragraph", F.sum("_starts").over(by))
    g = j.groupBy("run_id", "paragraph").agg(F.min("line_index").alias("first_line"), F.count("*").alias("lines"), F.sort_array(F.collect_list(F.struct("line_index", "id", "text"))).alias("_l"))
    body = F.aggregate(F.transform("_l", lambda s: s["text"]), F.lit(""), lambda a, t: tx.join_lines(a, t))
    return g.select("run_id", "paragraph", "first_line", "lines", body.alias("text"))


def page_roles(pages: DataFrame, with_text: DataFrame, ink: DataFrame) -> DataFrame:
    """text, plate (ink of 2 % and more) or blank for every page."""
    p = pages.select(F.col("id").alias("page_id"), "project_id", "page_index").join(with_text.withColumn("_t", F.lit(True)), "page_id", "left").join(ink, "page_id", "left")
    role = F.when(F.col("_t"), "text").when(F.col("ink_ratio") >= 0.02, "plate").otherwise("blank")
    return p.select("project_id", "page_index", "page_id", role.alias("role"))


# Words of a copyright page, headings of a contents page, and shares of ink.
COPYRIGHT_HINTS = ("isbn", "图书在版编目", "cip", "版权所有", "出版发行", "责任编辑", "印张", "插页", "开本", "字数", "印次", "印刷", "出版社", "出版者")
CONTENTS_HEADINGS = ("目录", "目次", "contents", "content", "tableofcontents")
PLATE_INK, COVER_INK, COVER_CHARACTERS = 0.02, 0.5, 40
NOISE_IN_TITLES = "[\\s，。、；：！？·…—–.,;:!?《》〈〉\"'“”‘’()（）\\[\\]【】-]+"


def page_evidence(lines: DataFrame) -> DataFrame:
    """``page_id, characters, hints, contents, headed`` of pages from their lines (``page_id, line_index, id, text``).

    A page is contents if one of its first three lines says so, or if three lines and at
    least half of all end in a page number after dots or blanks.
    """
    t = F.trim("text")
    entry = t.rlike(lb.CONTENTS_LINE)
    head = (F.length(t) <= 30) & ~t.rlike("[。，；：！？,.;:]$") & (lb.entry_kind(t) != "entry")
    n = lines.where("trim(text) <> ''").select("page_id", F.struct("line_index", "id", t.alias("t")).alias("l"), entry.cast("int").alias("e"), head.cast("int").alias("h"))
    g = n.groupBy("page_id").agg(F.array_sort(F.collect_list("l")).alias("_l"), F.sum("e").alias("entries"), F.max("h").alias("h"), F.count("*").alias("n"))
    text = F.lower(F.array_join(F.transform("_l", lambda x: x["t"]), "\n"))
    hints = sum((F.contains(text, F.lit(h)).cast("int") for h in COPYRIGHT_HINTS), F.lit(0))
    says = F.exists(F.slice("_l", 1, 3), lambda x: F.regexp_replace(F.lower(x["t"]), NOISE_IN_TITLES, "").isin(*CONTENTS_HEADINGS))
    return g.select("page_id", F.length(text).alias("characters"), hints.alias("hints"), (says | ((F.col("entries") >= 3) & (2 * F.col("entries") >= F.col("n")))).alias("contents"), (F.col("h") == 1).alias("headed"))


def book_roles(pages: DataFrame, evidence: DataFrame, labels: DataFrame, ink: DataFrame, bodies: DataFrame) -> DataFrame:
    """``project_id, page_index, page_id, role``: what every page of a book is, by rules in their order.

    Without text a page is a plate (a cover if it is the book's first) or blank. A page
    with text is copyright, contents, cover (the first one with text, short or inked,
    without number and heading), and else lies before, in or after the body, the longest
    run of numbers; without such a run it is unknown.
    """
    p = pages.select(F.col("id").alias("page_id"), "project_id", "page_index").join(evidence, "page_id", "left").join(labels.select("page_id", F.lit(True).alias("numbered")).distinct(), "page_id", "left").join(ink, "page_id", "left")
    book = p.groupBy("project_id").agg(F.min("page_index").alias("first_page_of_all"), F.min(F.when(F.col("characters").isNotNull(), F.col("page_index"))).alias("first_text"))
    p = p.join(book, "project_id").join(bodies.select("project_id", "first_page", "last_page"), "project_id", "left")
    plain = F.col("numbered").isNull()
    bare = F.when(F.coalesce(F.col("ink_ratio") >= PLATE_INK, F.lit(False)), F.when(F.col("page_index") == F.col("first_page_of_all"), "cover").otherwise("plate")).otherwise("blank")
    cover = (F.col("page_index") == F.col("first_text")) & plain & ~F.col("headed") & ((F.col("characters") <= COVER_CHARACTERS) | F.coalesce(F.col("ink_ratio") >= COVER_INK, F.lit(False)))
    role = (
        F.when(F.col("characters").isNull(), bare).when((F.col("hints") >= 2) & plain, "copyright").when(F.col("contents"), "contents").when(cover, "cover")
        .when(F.col("first_page").isNull(), "unknown").when(F.col("page_index") < F.col("first_page"), "front_matter").when(F.col("page_index") <= F.col("last_page"), "body").otherwise("back_matter")
    )
    return p.select("project_id", "page_index", "page_id", role.alias("role"))
