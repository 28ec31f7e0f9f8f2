"""History of changing attributes: every version with the time in which it was valid.

Versions of an entity form a chain: changes follow each other by time and then id, a
change that keeps the attributes opens no version, a version ends where the next begins
and the last one stays open. Late and corrected changes can alter a chain anywhere, so
``apply_updates`` does not patch it: it takes the raw changes of the touched entities
alone, rebuilds all their intervals and replaces these chains as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A chain with more changes than this is built slice by slice of time.
HOT_CHAIN = 200_000
#: Width of such a slice.
SLICE_SECONDS = 86_400


def newest_deliveries(changes: DataFrame, key: list[str], change_id: str, delivered: str) -> DataFrame:
    """One row per change id: its last delivery. Hash aggregated with a map-side part."""
    rest = [c for c in changes.columns if c not in {*key, change_id}]
    packed = F.struct(F.col(delivered).alias("_d"), *[F.col(f"`{c}`") for c in rest if c != delivered])
    got = changes.where(F.col(change_id).isNotNull()).groupBy(*key, change_id).agg(F.max_by(packed, F.struct(delivered, F.xxhash64(*[F.col(f"`{c}`") for c in rest]))).alias("_p"))
    return got.select(*key, change_id, *[F.col("_p._d" if c == delivered else f"_p.`{c}`").alias(c) for c in rest])


def _opens(rows: DataFrame, part: list[str], at: str, change_id: str, attrs: list[str]) -> DataFrame:
    by = W.partitionBy(*part).orderBy(F.col(at).asc_nulls_first(), change_id)
    now = F.struct(*attrs)
    return rows.withColumn("_open", F.coalesce(~(F.lag(now).over(by).eqNullSafe(now)), F.lit(True)))


def build_chains(changes: DataFrame, key: list[str], at: str, change_id: str, attrs: list[str], hot: int = HOT_CHAIN) -> DataFrame:
    """``key, version_no, change_id, attrs, valid_from, valid_to`` of every entity.

    Null attributes are values of their own; null times come first; equal times follow
    by id. Changes must be unique by id (``newest_deliveries``). Chains longer than
    ``hot`` are cut into slices of time which are built apart and then stitched, so
    that no task holds a long chain. Rows with a null key form one entity per null.
    """
    rows = changes.select(*key, at, change_id, *attrs)
    long_keys = rows.groupBy(*key).count().where(F.col("count") > hot).drop("count")
    same = [rows[k].eqNullSafe(long_keys[k]) for k in key]
    short = _number(_opens(rows.join(long_keys, same, "left_anti"), key, at, change_id, attrs), key, at, change_id, attrs, F.lit(0))
    return short.unionByName(_long_chains(rows.join(long_keys, same, "left_semi"), key, at, change_id, attrs))


def _number(opened: DataFrame, part: list[str], at: str, change_id: str, attrs: list[str], before) -> DataFrame:
    by = W.partitionBy(*part).orderBy(F.col(at).asc_nulls_first(), change_id)
    v = opened.where("_open").withColumn("version_no", (F.row_number().over(by) + before).cast("bigint"))
    keep = [c for c in part if not c.startswith("_")]
    return v.select(*keep, "version_no", change_id, *attrs, F.col(at).alias("valid_from"), F.lead(at).over(by).alias("valid_to"))


def _long_chains(rows: DataFrame, key: list[str], at: str, change_id: str, attrs: list[str]) -> DataFrame:
    """The same chains by slices: the first change of a slice is compared with the last of the slice before."""
    sliced = rows.withColumn("_slice", F.coalesce(F.floor(F.col(at).cast("double") / SLICE_SECONDS).cast("bigint"), F.lit(-(2**62))))
    part = [*key, "_slice"]
    marked = _opens(sliced, part, at, change_id, attrs)
    order = F.struct(F.col(at), F.col(change_id))
    body = F.struct(*attrs)
    ends = marked.groupBy(*part).agg(F.max_by(body, order).alias("_last"), F.min_by(body, order).alias("_first"), F.min_by(change_id, order).alias("_first_id"), F.sum(F.col("_open").cast("bigint")).alias("_n"))
    over = W.partitionBy(*key).orderBy("_slice")
    ends = ends.withColumn("_prev", F.lag("_last").over(over)).withColumn("_has", F.lag(F.lit(1)).over(over).isNotNull())
    ends = ends.withColumn("_kept", F.col("_has") & F.col("_prev").eqNullSafe(F.col("_first")))
    ends = ends.withColumn("_n", F.col("_n") - F.col("_kept").cast("bigint"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    e = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_slice").alias("_s"), "_kept", "_first_id", "_before")
    on = [marked[k].eqNullSafe(e[f"_k{i}"]) for i, k in enumerate(key)] + [marked["_slice"] == e["_s"]]
    opened = marked.join(e, on).withColumn("_open", F.col("_open") & ~(F.col("_kept") & (F.col(change_id) == F.col("_first_id"))))
    by = W.partitionBy(*part).orderBy(F.col(at).asc_nulls_first(), change_id)
    v = opened.where("_open").withColumn("version_no", (F.row_number().over(by) + F.col("_before")).cast("bigint"))
    v = v.withColumn("_next", F.lead(at).over(by))
    heads = v.groupBy(*part).agg(F.min(at).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(over))
    h = heads.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(key)], F.col("_slice").alias("_hs"), "_after")
    on = [v[k].eqNullSafe(h[f"_h{i}"]) for i, k in enumerate(key)] + [v["_slice"] == h["_hs"]]
    return v.join(h, on).select(*key, "version_no", change_id, *attrs, F.col(at).alias("valid_from"), F.coalesce("_next", "_after").alias("valid_to"))


def apply_updates(history: DataFrame, raw: DataFrame, touched: DataFrame, key: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``history`` with the chains of ``touched`` rebuilt from their raw changes.

    ``raw`` holds all changes delivered so far, the updates included. Untouched chains
    pass through unread by ``build``; touched ones are dropped and built again, so a
    chain is either the old one or wholly the new one.
    """
    t = touched.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(key)]).distinct()
    on = lambda df: [df[k].eqNullSafe(t[f"_t{i}"]) for i, k in enumerate(key)]
    kept = history.join(t, on(history), "left_anti")
    return kept.unionByName(build(raw.join(t, on(raw), "left_semi")))


class ChainStore:
    """Chains in hash buckets, each bucket a folder that a manifest names.

    The first ``replace`` sets the number of buckets by the number of changes, so that a
    bucket has some ``ROWS_A_BUCKET``. ``replace`` writes new folders for the touched
    buckets only and then creates the next manifest; a manifest that exists can't be
    created again, so of two writers one fails, and readers see all old or all new chains.
    """

    ROWS_A_BUCKET = 2_000_000

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int | None = None):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest that can be read; one that can't belongs to a writer that died."""
        fs, at = self._fs(), self._path(f"{self.root}/manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        for name in reversed([n for n in names if n.endswith(".json")]):
            try:
                return json.loads(self.spark.read.text(f"{self.root}/manifest/{name}", wholetext=True).first()[0])
            except (TypeError, ValueError):
                continue
        return {"version": 0, "folders": {}, "buckets": self.buckets}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        folders = self.manifest()["folders"]
        paths = sorted({f for b, f in folders.items() if buckets is None or int(b) in buckets})
        return self.spark.read.parquet(*paths) if paths else None

    def bucket(self, df: DataFrame, buckets: int) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int"))

    def replace(self, raw: DataFrame, touched: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
        """Rebuild the chains of ``touched``; returns how many buckets were rewritten."""
        old = self.manifest()
        n = old["buckets"] or max(1, -(-raw.count() // self.ROWS_A_BUCKET))
        hit = sorted(r[0] for r in self.bucket(touched, n).select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if not hit:
            return 0
        have = self.read(hit)
        if have is None:  # nothing to keep in these buckets
            have = build(raw.where("false"))
        new = apply_updates(have, raw, touched, self.key, build)
        version = old["version"] + 1
        base = f"{self.root}/data/v{version:012d}-{uuid.uuid4().hex}"
        # A bucket is written by as many tasks as hold its rows; none of them holds it whole.
        self.bucket(new, n).write.mode("error").partitionBy("_bucket").parquet(base)
        folders = {b: f for b, f in old["folders"].items() if int(b) not in hit}
        fs = self._fs()
        folders |= {str(b): f"{base}/_bucket={b}" for b in hit if fs.exists(self._path(f"{base}/_bucket={b}"))}
        try:
            out = fs.create(self._path(f"{self.root}/manifest/{version:012d}.json"), False)
        except Exception as e:
            raise RuntimeError("another writer replaced chains at the same time") from e
        out.write(bytearray(json.dumps({"version": version, "folders": folders, "buckets": n}).encode()))
        out.close()
        return len(hit)
