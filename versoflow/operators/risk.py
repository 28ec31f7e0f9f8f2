"""Disagreement of two readings: conflicts and an additive risk with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versoflow.functions import text as tx

# What each signal adds to the score.
VARIANT, SUBSTITUTION, PUNCTUATION, MISSING, UNSURE, ODD_CHARACTER, MISPLACED = 0.10, 0.45, 0.20, 0.55, 0.25, 0.35, 0.15
SURE, SHIFT = 0.80, 0.04


def assess(pairs: DataFrame) -> DataFrame:
    """``score``, ``content_score`` and ``reasons`` for ``primary_text, secondary_text, min_confidence, shift`` and perhaps ``ambiguous``.

    ``content_score`` is the part that comes from the evidence's quality (an unsure reader,
    odd characters, boxes apart) and not from disagreement. An ambiguous alignment has a
    score of 1.

    A side without text is a missing line; texts that agree without case and width differ
    as variants only, those that agree without punctuation in punctuation only.
    """
    p, s = F.coalesce("primary_text", F.lit("")), F.coalesce("secondary_text", F.lit(""))
    fold = lambda c: tx.fold_width(c)
    bare = lambda c: tx.squash(tx.without_punctuation(fold(c)))
    one_sided = (p == "") != (s == "")
    variant = (p != s) & (fold(p) == fold(s))
    punct = ~one_sided & (fold(p) != fold(s)) & (bare(p) == bare(s))
    real = ~one_sided & (bare(p) != bare(s))
    unsure = F.coalesce(F.col("min_confidence") < SURE, F.lit(False))
    odd = tx.has_anomaly(F.concat(p, s))
    moved = F.coalesce(F.col("shift") > SHIFT, F.lit(False))
    signals = [("variant", variant, VARIANT), ("text_conflict", real, SUBSTITUTION), ("punctuation_conflict", punct, PUNCTUATION), ("missing_line", one_sided, MISSING), ("low_confidence", unsure, UNSURE), ("unicode_anomaly", odd, ODD_CHARACTER), ("spatial_mismatch", moved, MISPLACED)]
    score: Column = F.lit(0.0)
    for _, hit, weight in signals:
        score = score + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit, _ in signals]))
    content = sum((F.when(hit, F.lit(w)).otherwise(F.lit(0.0)) for hit, w in ((unsure, UNSURE), (odd, ODD_CHARACTER), (moved, MISPLACED))), F.lit(0.0))
    score = F.least(F.lit(1.0), score)
    if "ambiguous" in pairs.columns:
        unclear = F.coalesce(F.col("ambiguous"), F.lit(False))
        score = F.when(unclear, F.lit(1.0)).otherwise(score)
        reasons = F.when(unclear, F.array_append(reasons, F.lit("alignment_ambiguity"))).otherwise(reasons)
    return pairs.withColumn("score", score).withColumn("content_score", F.least(F.lit(1.0), content)).withColumn("reasons", reasons)
