"""Filling fixed-capacity containers with documents sized in tokens.

The plan is made over the histogram of sizes, not over documents: sizes in falling order
go to the containers they fit best, in bulk, because all containers with the same room
are alike. A plan is a few segments a size: "of the documents of this size, those ranked
from a to b go, m to a container, into the containers from c on". Documents find their
slot by their rank within their size.

A document above the capacity is cut into full containers and a rest that is placed like
a document of its own; all others stay whole. Empty and null texts take no room and go
into container 0. Documents are identified by ``doc_id``; repeated rows count once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.llm.tokenizer import DEFAULT_VOCABULARY, count_tokens
from versoflow.session import bounded_broadcast, cut_lineage, table

#: Slices in which the documents of one size are ranked; a size may hold a third of all.
RANK_SLICES = 64

Segment = tuple[int, int, int, int, int]


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[Segment], int]:
    """Segments ``(size, rank_from, rank_to, first_container, per_container)`` and the number of containers.

    Best fit, falling sizes. Among containers with room ``r`` one size fills a container
    with ``r // size`` of its documents before it takes the next, as one at a time would.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    made, plan = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        if size <= 0:
            plan.append((size, 0, left, 0, max(1, left)))
            made = max(made, 1)
            continue
        if size > capacity:
            raise ValueError(f"size {size} above the capacity {capacity}")
        while left:
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first, n = capacity, made, -(-left // (capacity // size))
                made += n
            each = room // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, rank + full * each, first, each))
                put(room - each * size, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                plan.append((size, rank, rank + left, first, left))
                put(room - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(room, first, n)
    return plan, made


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, container_no, doc_id, piece_no, n_tokens`` of every document and container kind.

    ``sizes`` has unique ``doc_id`` and ``n_tokens``; container kinds with a null or
    non-positive capacity hold nothing and are left out. ``piece_no`` is 0 for a whole
    document and counts from 1 for the pieces of one that had to be cut. The driver holds
    the kinds and one number per kind and size up to its capacity, never documents.
    """
    kinds = [(r[0], r[1]) for r in containers.select("container", "capacity_tokens").where("container is not null and capacity_tokens > 0").distinct().toLocalIterator()]
    spark = sizes.sparkSession
    each_kind = F.array(*[F.struct(F.lit(k).alias("container"), F.lit(c).cast("bigint").alias("cap")) for k, c in kinds]).cast("array<struct<container: string, cap: bigint>>")
    s = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n")).where("doc_id is not null")
    whole = F.floor(F.col("n") / F.col("_cap"))
    cut = F.when(F.col("n") <= F.col("_cap"), F.array(F.struct(F.lit(0).cast("bigint").alias("piece_no"), F.col("n").alias("n_tokens"))))
    pieces = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / F.col("_cap"))), lambda i: F.struct(i.cast("bigint").alias("piece_no"), F.when(i <= whole, F.col("_cap")).otherwise(F.col("n") - whole * F.col("_cap")).cast("bigint").alias("n_tokens")))
    of_kinds = s.withColumn("_kind", F.explode(each_kind)).select("doc_id", "n", "_kind.container", F.col("_kind.cap").alias("_cap"))
    items = of_kinds.withColumn("_p", F.explode(cut.otherwise(pieces))).select("container", "doc_id", "_p.piece_no", "_p.n_tokens")
    items = items.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_SLICES)).cast("int"))

    per_slice = items.groupBy("container", "n_tokens", "_slice").agg(F.count("*").alias("_n"))
    per_slice = cut_lineage(per_slice)
    hist: dict[str, dict[int, int]] = {k: {} for k, _ in kinds}
    for r in per_slice.groupBy("container", "n_tokens").agg(F.sum("_n").alias("n")).toLocalIterator():
        hist[r["container"]][r["n_tokens"]] = r["n"]
    segments = [(k, *x) for k, cap in kinds for x in plan_best_fit(hist[k], cap)[0]]
    plan = spark.createDataFrame(segments, "container string, n_tokens bigint, _from bigint, _to bigint, _first bigint, _each bigint")

    before = F.sum("_n").over(W.partitionBy("container", "n_tokens").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    starts = per_slice.select("container", "n_tokens", "_slice", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(W.partitionBy("container", "n_tokens", "_slice").orderBy("doc_id", "piece_no")) - 1
    ranked = items.withColumn("_k", local).join(starts, ["container", "n_tokens", "_slice"]).withColumn("_rank", F.col("_start") + F.col("_k"))
    placed = ranked.join(bounded_broadcast(plan, len(segments)), ["container", "n_tokens"]).where("_rank >= _from and _rank < _to")
    no = F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))
    return placed.select("container", no.cast("bigint").alias("container_no"), "doc_id", "piece_no", "n_tokens")


def p7_containers(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    sizes = count_tokens(table(spark, sf_dir, "documents"), vocabulary).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    return pack(cut_lineage(sizes), table(spark, sf_dir, "containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    caps = table(spark, sf_dir, "containers")
    used = p7_containers(spark, sf_dir).groupBy("container", "container_no").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k"))
    by = used.groupBy("container").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.sum("k").alias("pieces"), F.max("n").alias("fullest"))
    return by.join(caps, "container").select("container", "containers", "tokens", "pieces", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
