"""Reader output, manifests and page images as tables.

A reader is any program that gives a JSON document a page (contract versions 1 and 2).
Documents that break the contract are kept apart with the reason, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = """schema_version int, engine string, engine_version string, page_index int, direction string,
lines array<struct<text: string, box: array<double>, confidence: double, tokens: array<struct<text: string, confidence: double, box: array<double>>>>>,
blocks array<struct<type: string, box: array<double>, line_start: int, line_end: int>>, _broken string"""

# Names that readers use for kinds of blocks.
BLOCK_ALIASES = {
    "text": "text", "paragraph": "text", "plain text": "text", "body": "text", "title": "title", "doc_title": "title", "paragraph_title": "title", "heading": "title", "section-header": "title",
    "header": "header", "page-header": "header", "page_header": "header", "footer": "footer", "page-footer": "footer", "page_footer": "footer", "footnote": "footnote", "page_footnote": "footnote",
    "figure": "figure", "image": "figure", "picture": "figure", "chart": "figure", "table": "table", "caption": "caption", "figure_caption": "caption", "table_caption": "caption",
}
DIRECTIONS = ("horizontal-lr", "vertical-rl", "vertical-lr")


def block_type(label: Column) -> Column:
    """Canonical kind of a block; unknown names become ``unknown``."""
    names = F.create_map(*[F.lit(x) for kv in BLOCK_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(label))), F.lit("unknown"))


def direction(value: Column) -> Column:
    """A declared direction, null if it is none of the known ones."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*DIRECTIONS), v)


def clamp(box: Column) -> Column:
    """Box ``x, y, w, h`` cut to the page."""
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    x, y = inside(box[0]), inside(box[1])
    return F.array(x, y, F.greatest(F.lit(0.0), F.least(1 - x, box[2])), F.greatest(F.lit(0.0), F.least(1 - y, box[3])))


def parse_documents(raw: DataFrame, engine: str | None = None) -> DataFrame:
    """``raw`` (``page_index, document``) with the parsed document ``doc`` and ``problem`` (null if it holds to the contract)."""
    d = raw.withColumn("doc", F.from_json("document", DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad_box = F.exists(F.coalesce("doc.lines", F.array().cast("array<struct<text: string, box: array<double>, confidence: double, tokens: array<struct<text: string, confidence: double, box: array<double>>>>>")), lambda x: x["box"].isNotNull() & (F.size(x["box"]) != 4))
    problem = (
        F.when(F.col("doc").isNull() | F.col("doc._broken").isNotNull(), "unreadable").when(~F.coalesce(F.col("doc.schema_version").isin(1, 2), F.lit(False)), "version")
        .when(F.lit(engine is not None) & ~F.col("doc.engine").eqNullSafe(F.lit(engine)), "engine").when(~F.col("doc.page_index").eqNullSafe(F.col("page_index")), "page")
        .when(F.col("doc.lines").isNull(), "no lines").when(bad_box, "box")
    )
    return d.withColumn("problem", problem)


def document_lines(parsed: DataFrame) -> DataFrame:
    """Lines of the good documents; a missing list of tokens stays null, an empty one stays empty."""
    ln = parsed.where("problem is null").select("page_index", "doc.engine", "doc.engine_version", direction(F.col("doc.direction")).alias("direction"), F.posexplode("doc.lines").alias("line_index", "l"))
    least = F.array_min(F.concat(F.array("l.confidence"), F.coalesce(F.transform("l.tokens", lambda t: t["confidence"]), F.array().cast("array<double>"))))
    box = F.when(F.col("l.box").isNotNull(), clamp(F.col("l.box")))
    return ln.select("page_index", "engine", "engine_version", "direction", "line_index", "l.text", box.alias("box"), "l.confidence", F.col("l.tokens").alias("tokens"), least.alias("lowest_confidence"))


def document_blocks(parsed: DataFrame) -> DataFrame:
    b = parsed.where("problem is null").select("page_index", F.posexplode("doc.blocks").alias("block_index", "b"))
    return b.select("page_index", "block_index", block_type(F.col("b.type")).alias("type"), clamp(F.col("b.box")).alias("box"), "b.line_start", "b.line_end")


def lines_with_block(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each line with the first block that covers it: block ranges are spread over their lines, so it is an equi join."""
    spread = blocks.where("line_end > line_start").select("page_index", "block_index", "type", F.explode(F.sequence("line_start", F.col("line_end") - 1)).alias("line_index"))
    first = spread.groupBy("page_index", "line_index").agg(F.min_by("type", "block_index").alias("block_type"))
    return lines.join(first, ["page_index", "line_index"], "left")


def read_pages(images: DataFrame, reader: Callable[[bytes, int], str]) -> DataFrame:
    """Run an injected reader over page images (``page_index, content``), a batch of pages at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"page_index": pdf.page_index, "document": [reader(bytes(c), int(i)) for c, i in zip(pdf.content, pdf.page_index, strict=True)]})

    return images.select("page_index", "content").mapInPandas(run, "page_index int, document string")


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG and JPEG files of a folder with size, digest and the page number in their name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike("\\.(png|jpe?g)$"))
    return f.select("path", F.regexp_extract("path", "([0-9]+)\\.[A-Za-z]+$", 1).try_cast("int").alias("page_index"), "length", F.sha2("content", 256).alias("sha256"), "content")


def new_pages(images: DataFrame, imported: DataFrame) -> DataFrame:
    """Pages not imported yet; a second import of the same source adds nothing."""
    return images.join(imported.select("page_index"), "page_index", "left_anti")


def changed_pages(images: DataFrame, recorded: DataFrame) -> DataFrame:
    """Pages whose digest or size is not the recorded one, with the status changed, missing or unrecorded."""
    r = recorded.select("page_index", F.col("sha256").alias("was"), F.col("length").alias("was_length"))
    j = images.select("page_index", "sha256", "length").join(r, "page_index", "full_outer")
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when((F.col("was") != F.col("sha256")) | ~F.col("was_length").eqNullSafe(F.col("length")), "changed")
    return j.select("page_index", status.alias("status")).where("status is not null")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a benchmark manifest (version 1), one row each; anything else is an error."""
    m = spark.read.option("multiLine", "true").json(path)
    if "cases" not in m.columns or m.select("schema_version").first()[0] != 1:
        raise ValueError("not a manifest of version 1")
    c = m.select(F.explode("cases").alias("c")).select("c.*")
    twice = c.groupBy("id").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a case id occurs twice")
    return c


def synthetic_reader(documents: DataFrame, corrupt: tuple[int, ...] = ()) -> DataFrame:
    """A reader that replays texts line by line with even boxes; lines at ``corrupt`` end in X.

    ``documents`` has ``page_id, text``; null texts have no lines.
    """
    ls = documents.where("text is not null").select("page_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "text"), F.size(F.split("text", "\n", -1)).alias("n"))
    wrong = F.col("line_index").isin(*corrupt) if corrupt else F.lit(False)
    text = F.when(wrong & (F.length("text") > 0), F.concat(F.expr("left(text, length(text) - 1)"), F.lit("X"))).otherwise(F.col("text"))
    step = F.lit(0.9) / F.col("n")
    return ls.select("page_id", "line_index", text.alias("text"), F.lit(0.05).alias("x"), (0.05 + F.col("line_index") * step).alias("y"), F.lit(0.9).alias("width"), (0.6 * step).alias("height"))
