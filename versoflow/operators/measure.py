"""Measurement: error rates, intervals, strata, votes, regressions, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Z scores of the usual confidences.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def error_rate(edits: Column, units: Column) -> Column:
    """Edits over units; without units 0 if there are no edits, else 1."""
    return F.when(units > 0, edits / units).when(edits == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def complete_sum(c: str) -> Column:
    """Sum, null unless every row has a value: a missing measure is never read as 0."""
    return F.when(F.count("*") == F.count(c), F.sum(c))


def wilson(hits: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, widened to hold a rate above 1; null without units."""
    z = Z[confidence]
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.least(p, F.greatest(F.lit(0.0), mid - half))), F.when(ok, F.greatest(p, F.least(F.lit(1.0), mid + half)))


def mean_interval(mean: Column, sd: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Interval of a mean, null below two values, lower end at least 0."""
    half = Z[confidence] * sd / F.sqrt(n)
    return F.when(n > 1, F.greatest(F.lit(0.0), mean - half)), F.when(n > 1, mean + half)


def vote(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Plurality of independent sources: ``keys`` and ``text, supporters, sources, rationale``.

    ``readings`` has ``source, fold, text``; a source counts once per form; ties accept nothing.
    """
    r = readings.where("fold is not null and fold <> ''")
    forms = r.groupBy(*keys, "fold").agg(F.collect_set("source").alias("by"), F.min("text").alias("text"))
    forms = forms.withColumn("n", F.size("by"))
    g = forms.groupBy(*keys).agg(
        F.max("n").alias("top"), F.count("*").alias("forms"), F.max_by("text", F.struct("n", "fold")).alias("text"),
        F.collect_list("n").alias("_n"), F.size(F.array_distinct(F.flatten(F.collect_list("by")))).cast("bigint").alias("sources"),
    )
    ties = F.size(F.filter("_n", lambda n: n == F.col("top")))
    why = F.when(F.col("sources") < 2, "single_reader").when(ties > 1, "tie").when(F.col("forms") == 1, "unanimous").otherwise("majority")
    out = g.withColumn("rationale", why)
    return out.select(*keys, F.when(F.col("rationale").isin("unanimous", "majority"), F.col("text")).alias("text"), F.col("top").cast("bigint").alias("supporters"), "sources", "rationale")


def compare(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison of a metric where less is better."""
    o = old.select(*keys, F.col(value).alias("old_value"), F.lit(1).alias("_o"))
    n = new.select(*keys, F.col(value).alias("new_value"), F.lit(1).alias("_n"))
    d = F.col("new_value") - F.col("old_value")
    status = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "missing").when(d.isNull(), "unavailable")
        .when(d < -tolerance, "improved").when(d > tolerance, "regressed").otherwise("unchanged")
    )
    return o.join(n, keys, "full_outer").select(*keys, "old_value", "new_value", status.alias("status"))


def streak(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Length of the trailing run of increases of each series; unmeasured points are bridged."""
    by = W.partitionBy(*keys).orderBy(order)
    s = series.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(by)).where("_d is not null")
    back = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_ok", F.sum((F.col("_d") <= 0).cast("int")).over(back))
    return s.groupBy(*keys).agg(F.count("*").alias("points"), F.sum((F.col("_ok") == 0).cast("bigint")).alias("streak"), F.max_by("_d", order).alias("last_delta"))


def inversions(lines: DataFrame, group: str, order: str, place: str) -> DataFrame:
    """Pairs of lines of a group that stand in the other order than they are numbered; a group is a page's reading.

    Counted within the group's own array, so that no pair becomes a row; null places and numbers count for no pair.
    """
    g = lines.groupBy(group).agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.when(F.col(order).isNotNull() & F.col(place).isNotNull(), F.struct(F.col(order).alias("i"), F.col(place).alias("p"))))).alias("_l"))
    before = F.transform("_l", lambda x: F.size(F.filter("_l", lambda y: (y["i"] < x["i"]) & (y["p"] > x["p"]))))
    return g.select(group, "lines", F.coalesce(F.aggregate(before, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0)).alias("inversions"))
