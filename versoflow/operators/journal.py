"""The store's lookups: newest per key, journal, citations, search, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows repeated with the same id count once; of differing deliveries the last one."""
    if "delivered_at" not in df.columns:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.max_by(F.struct(*rest), "delivered_at").alias("_r"))
    return got.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def newest(df: DataFrame, keys: list[str], by: str = "id") -> DataFrame:
    """The row with the greatest ``by`` of each key; hash aggregated, no sort."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def latest_engine_run(runs: DataFrame) -> DataFrame:
    """Newest whole-page run of each page and engine; region runs don't count."""
    return runs.where("scope is null").groupBy("page_id", "engine").agg(F.max("id").alias("run_id"))


def history(decisions: DataFrame, preview: int = 320) -> DataFrame:
    """Each decision with the one before it and the newest of its line."""
    line = W.partitionBy("page_id", "pair_index")
    return decisions.select("id", "page_id", "pair_index", F.lag("id").over(line.orderBy("id")).alias("previous_id"), F.max("id").over(line).alias("latest_id"), F.substring("selected_text", 1, preview).alias("preview"), (F.length("selected_text") > preview).alias("truncated"))


def cited_run(refs: Column) -> Column:
    """The verification run a decision cites, if it cites exactly one in canonical form."""
    hits = F.filter(refs, lambda r: r.rlike("^verification_run:[1-9][0-9]*$"))
    return F.when(F.size(hits) == 1, F.split(hits[0], ":")[1].cast("bigint"))


def bindings(decisions: DataFrame, alignments: DataFrame) -> DataFrame:
    """Whether each newest decision cites the page's newest verification: current, historical or unverified."""
    last = alignments.groupBy("page_id").agg(F.max("verification_run_id").alias("latest_verification"))
    d = newest(decisions.select("id", "page_id", "pair_index", "evidence_refs"), ["page_id", "pair_index"]).withColumn("cited", cited_run(F.col("evidence_refs")))
    status = F.when(F.col("cited").isNull(), "unverified").when(F.col("cited") == F.col("latest_verification"), "current").otherwise("historical")
    return d.join(last, "page_id", "left").select("page_id", "pair_index", F.col("id").alias("decision_id"), "cited", "latest_verification", status.alias("binding"))


def members(alignments: DataFrame, side: str) -> DataFrame:
    return alignments.select("verification_run_id", "page_id", "pair_index", F.col(f"{side}_run_id").alias("run_id"), F.posexplode(f"{side}_members").alias("member_index", "line_index"))


def search(rows: DataFrame, text: str, term: str, limit: int, before: int | None = None, snapshot: int | None = None) -> DataFrame:
    """Literal search, newest first, one page and one row more to tell whether there is another."""
    hits = rows.where(F.instr(F.col(text), term) > 0)
    if before is not None:
        hits = hits.where(F.col("id") < before)
    if snapshot is not None:
        hits = hits.where(F.col("id") <= snapshot)
    return hits.orderBy(F.desc("id")).limit(limit + 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, code: str) -> DataFrame:
    """Findings for child rows without their parent."""
    have = parent.select(F.col("id").alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(have, key, "left_anti").select(F.lit(code).alias("code"), F.col("id").alias("subject"))


def audit(pages: DataFrame, runs: DataFrame, lines: DataFrame, alignments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings of a whole store: missing parents, lines in two pairs, half-recorded page assets."""
    found = orphans(runs, "page_id", pages, "run_without_page").unionByName(orphans(lines, "run_id", runs, "line_without_run")).unionByName(orphans(decisions, "page_id", pages, "decision_without_page"))
    both = members(alignments, "primary").unionByName(members(alignments, "secondary"))
    twice = both.groupBy("verification_run_id", "run_id", "line_index").agg(F.countDistinct("pair_index").alias("n")).where("n > 1").select(F.lit("line_in_two_pairs").alias("code"), F.col("verification_run_id").alias("subject"))
    parts = ["page_asset_sha256", "page_asset_byte_size", "page_asset_parameters_json", "page_asset_version"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in parts), F.lit(0))
    half = pages.where((filled > 0) & (filled < len(parts))).select(F.lit("half_recorded_asset").alias("code"), F.col("id").alias("subject"))
    return found.unionByName(twice).unionByName(half)
