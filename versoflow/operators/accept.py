"""What may be accepted without a person: agreement of readers, corroboration, and the gate.

Agreement asks whether independent readers agree; the gate asks whether the text is fit to
accept. A text that fails the second question stays open though the first says yes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions import text as tx

# The gate's limits and the reasons that always block, in their order.
MOST_CONTENT_RISK, LEAST_CONFIDENCE = 0.34, 0.30
BLOCKING = ("unicode_anomaly", "spatial_mismatch", "alignment_ambiguity")


def agreement(readings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, readers, texts, agreed, rationale, folds, literals`` of the readers of one printed line.

    ``readings`` has ``position, text``, one row per reader in the readers' order; null is
    no text. Texts that differ in width, case and marks of punctuation only are one form;
    the largest form with two readers and more wins, of equal ones that which comes first,
    and its first text is kept as it is. ``folds`` and ``literals`` list what the readers
    have, for corroboration. One aggregation by form and one by line.
    """
    r = readings.withColumn("_fold", tx.fold_comparison(F.col("text")))
    forms = r.groupBy(*keys, "_fold").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.min_by("text", "position").alias("text"), F.collect_set("text").alias("literals"))
    there = F.col("_fold").isNotNull()
    best = F.max_by(F.struct("n", "text", F.size("literals").alias("spellings")), F.when(there, F.struct(F.col("n"), -F.col("first"))))
    g = forms.groupBy(*keys).agg(
        F.sum("n").alias("readers"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("texts"), best.alias("_b"),
        F.collect_set("_fold").alias("folds"), F.flatten(F.collect_list(F.when(there, F.col("literals")))).alias("literals"),
    )
    wins = F.col("_b.n") >= 2
    why = (
        F.when(F.col("texts") == 0, "no_engine_text").when(wins & (F.col("_b.n") == F.col("texts")), F.when(F.col("_b.spellings") == 1, "engines_agree").otherwise("variant_agreement"))
        .when(wins, "majority_agreement").when(F.col("texts") < 2, "missing_engine_text").otherwise("engines_disagree")
    )
    return g.select(*keys, "readers", "texts", F.when(wins, F.col("_b.text")).alias("agreed"), why.alias("rationale"), "folds", "literals")


def corroborated(agreed: DataFrame) -> DataFrame:
    """``proposed, actor, rationale`` from ``agreement`` joined with a third reading ``vlm_text, vlm_uncertain`` (null without one).

    A third reading decides only where the readers do not agree, only if it is certain and
    not blank, and only if it is what one of them has; a text that nobody else has read is
    a third opinion and goes to a person.
    """
    vlm = F.col("vlm_uncertain").isNotNull()
    matches = F.array_contains("folds", tx.fold_comparison(F.col("vlm_text")))
    open_ = F.col("agreed").isNull() & (F.col("texts") > 0)
    why = (
        F.when(~open_ | ~vlm, F.col("rationale")).when(F.col("vlm_uncertain"), "vlm_uncertain").when(F.trim(F.coalesce("vlm_text", F.lit(""))) == "", "vlm_blank")
        .when(~F.coalesce(matches, F.lit(False)), "vlm_uncorroborated").otherwise("vlm_confident")
    )
    out = agreed.withColumn("rationale", why)
    by_vlm = F.col("rationale") == "vlm_confident"
    return out.withColumn("proposed", F.when(by_vlm, F.col("vlm_text")).otherwise(F.col("agreed"))).withColumn("actor", F.when(by_vlm, "vlm").when(F.col("agreed").isNotNull(), "automatic"))


def blockers(text: Column, reasons: Column, content_score: Column, min_confidence: Column) -> Column:
    """Why a machine may not accept a text: defects of the text first, then of the evidence; empty if it may. Null risk columns say nothing."""
    found = [
        F.when(F.trim(text) == "", F.lit("blank_text")), F.when(tx.unrepresentable(text), F.lit("unrepresentable_text")),
        *[F.when(F.array_contains(reasons, r), F.lit(r)) for r in BLOCKING],
        F.when(content_score > MOST_CONTENT_RISK, F.lit("high_content_risk")), F.when(min_confidence < LEAST_CONFIDENCE, F.lit("low_confidence")),
    ]
    return F.array_compact(F.array(*found))
