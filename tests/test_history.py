import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from versoflow.operators import history as hi

T0 = datetime(2025, 1, 1)
SCHEMA = "page bigint, pair bigint, id bigint, text string, created_at timestamp, delivered_at timestamp"
KEY = ["page", "pair"]


def changes(spark, seed=1, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + timedelta(hours=rnd.randrange(200))
        key = (1, 1) if rnd.random() < 0.4 else (rnd.randrange(4), rnd.choice([None, 1, 2]))
        row = (*key, i, rnd.choice(["a", "b", None, "é"]), at)
        for _ in range(rnd.choice([1, 1, 2])):
            rows.append((*row, at + timedelta(hours=rnd.randrange(50))))
    return spark.createDataFrame(rows, SCHEMA), rows


def brute(rows):
    chains = {}
    for r in {x[:5] for x in rows}:
        chains.setdefault(r[:2], []).append(r)
    out = set()
    for k, c in chains.items():
        versions = []
        for r in sorted(c, key=lambda r: (r[4], r[2])):
            if not versions or versions[-1][3] != r[3]:
                versions.append(r)
        for n, v in enumerate(versions):
            out.add((*k, n + 1, v[2], v[3], v[4], versions[n + 1][4] if n + 1 < len(versions) else None))
    return out


def build(df, hot=hi.HOT_CHAIN):
    return hi.build_chains(hi.newest_deliveries(df, KEY, "id", "delivered_at"), KEY, "created_at", "id", ["text"], hot)


def test_chains_match_brute_force(spark):
    df, rows = changes(spark)
    assert {tuple(r) for r in build(df).collect()} == brute(rows)


def test_long_chains_are_the_same_by_slices(spark):
    df, rows = changes(spark, 2)
    assert {tuple(r) for r in build(df, hot=10).collect()} == brute(rows)
    assert {tuple(r) for r in build(df, hot=0).collect()} == brute(rows)


def test_late_updates_rebuild_only_touched_chains(spark):
    df, rows = changes(spark, 3)
    cut = T0 + timedelta(hours=120)
    late = F.col("delivered_at") >= F.lit(cut)
    seen = []

    def watched(d):
        seen.append(d)
        return build(d)

    got = hi.apply_updates(build(df.where(~late)), df, df.where(late), KEY, watched)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    keys = {(r.page, r.pair) for r in seen[0].select(*KEY).distinct().collect()}
    assert keys == {(r.page, r.pair) for r in df.where(late).select(*KEY).distinct().collect()}


def test_empty(spark):
    assert build(spark.createDataFrame([], SCHEMA)).count() == 0


def test_store_swaps_whole_chains(spark, tmp_path):
    df, rows = changes(spark, 4)
    store = hi.ChainStore(spark, str(tmp_path / "store"), KEY, buckets=4)
    cut = T0 + timedelta(hours=100)
    early = df.where(F.col("delivered_at") < F.lit(cut))
    store.replace(early, early, build)
    old = store.manifest()
    assert store.replace(df, df.where(F.col("delivered_at") >= F.lit(cut)), build) > 0
    assert store.manifest()["version"] == old["version"] + 1
    got = store.read().select("page", "pair", "version_no", "id", "text", "valid_from", "valid_to")
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert store.replace(df, df.where("false"), build) == 0
