"""Schemas that drift between files: a catalogue of field lifespans, changes and casts.

The top-level keys of every readable record are counted per feed, file, field and type
(the footer metadata of row files). ``lag`` over a field's
files gives the islands in which it was present: an island that does not begin with the
feed's first file is a start, one that does not end with the last a stop. A start and a
stop at the same file are one field renamed if the same records hold the same values,
whatever their type. Types are compared along an island and across renames.

Unreadable payloads and payloads that are no objects belong to no record. Rows repeated
with the same feed, file and record count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.session import bounded_broadcast, cut_lineage

#: Of the records that hold both values, this share must agree for a rename.
RENAME_AGREE = 0.9


def read_records(records: DataFrame) -> DataFrame:
    """``feed_id, file_no, record_kind, row_no, digest, rec, fields`` of every readable record, parsed once.

    ``fields`` is ``array<struct<field, type, raw>>``; ``type`` is number, string, boolean,
    array or object, null for a null; the text is read by ``value_of`` where it is needed.
    """
    r = records.where("feed_id is not null and file_no is not null")
    r = r.select("feed_id", "file_no", "record_kind", "row_no", F.xxhash64("payload").alias("digest"), F.from_json("payload", "map<string,variant>").alias("_m")).where("_m is not null")

    # Of a key written twice the last counts; most payloads have none.
    m = F.when(F.size(F.array_distinct(F.map_keys("_m"))) < F.size("_m"), F.filter(F.map_entries("_m"), lambda e, i: ~F.array_contains(F.slice(F.map_keys("_m"), i + 2, F.size("_m")), e["key"]))).otherwise(F.map_entries("_m"))
    r = r.withColumn("fields", F.transform(m, lambda e: F.struct(e["key"].alias("field"), _kind(F.schema_of_variant(e["value"])).alias("type"), e["value"].alias("raw"))))
    ident = F.try_element_at(F.filter("fields", lambda f: f["field"] == "id"), F.lit(1))
    return r.select("feed_id", "file_no", "record_kind", "row_no", "digest", value_of(ident).alias("rec"), "fields")


def _kind(t):
    return (
        F.when(t == "STRING", "string").when(t.isin("VOID") | t.isNull(), None).when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("number")
    )


def value_of(f):
    """The text of a field's value; an array or object of one value is unwrapped."""
    text = F.try_variant_get(f["raw"], "$", "string")
    return F.when(f["type"].isin("array", "object"), _text(text)).when(f["type"].isNotNull(), F.trim(text))


def _text(c):
    """Arrays and objects of a single scalar are written as that scalar."""
    one = F.regexp_replace(c, r'^\s*(?:\[|\{\s*"[^"]*"\s*:)\s*("?)([^\[\]{},"]*)\1\s*[\]}]\s*$', "$2")
    return F.trim(one)


def catalogue(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files ``feed_id, file_no, n, last`` (n counts from 1) and fields ``feed_id, n, file_no, field, type, fresh, gone, isle``.

    A type is what most rows of the file have, ties to the alphabetically first. Counted
    where the rows are read, so what is shuffled is a row per file, field and type.
    """
    typed = parsed.select("feed_id", "file_no", F.explode("fields").alias("f")).groupBy("feed_id", "file_no", F.col("f.field").alias("field"), F.col("f.type").alias("type")).agg(F.count("*").alias("k"))
    typed = cut_lineage(typed)
    files = parsed.groupBy("feed_id", "file_no").agg(F.lit(1).alias("one")).drop("one")
    files = cut_lineage(files.withColumn("n", F.row_number().over(W.partitionBy("feed_id").orderBy("file_no"))).withColumn("last", F.count("*").over(W.partitionBy("feed_id"))))
    types = typed.groupBy("feed_id", "file_no", "field").agg(F.min(F.when(F.col("type").isNotNull(), F.struct((-F.col("k")).alias("k"), F.col("type").alias("type")))).alias("_t"))
    types = types.select("feed_id", "file_no", "field", F.col("_t.type").alias("type"))
    by = W.partitionBy("feed_id", "field").orderBy("n")
    cat = types.join(files, ["feed_id", "file_no"])
    cat = cat.withColumn("fresh", F.coalesce(F.col("n") - F.lag("n").over(by) > 1, F.col("n") > 1)).withColumn("gone", F.coalesce(F.lead("n").over(by) - F.col("n") > 1, F.col("n") < F.col("last")))
    # The island a row belongs to, named by its first file.
    cat = cat.withColumn("isle", F.max(F.when(F.coalesce(F.col("n") - F.lag("n").over(by) > 1, F.lit(True)), F.col("n"))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return files, cat


def lifespans(cat: DataFrame) -> DataFrame:
    """``feed_id, field, type, isle, first_n, last_n``: islands of one type within each island of a field.

    Files in which the field has only nulls have no type and go on with the one before.
    """
    by = W.partitionBy("feed_id", "field", "isle").orderBy("n")
    t = cat.where("type is not null").withColumn("_begins", (~F.lag("type").over(by).eqNullSafe(F.col("type"))).cast("int"))
    t = t.withColumn("_span", F.sum("_begins").over(by))
    return t.groupBy("feed_id", "field", "isle", "_span").agg(F.first("type").alias("type"), F.min("n").alias("first_n"), F.max("n").alias("last_n")).drop("_span")


def renames(parsed: DataFrame, files: DataFrame, cat: DataFrame) -> DataFrame:
    """``feed_id, n, old, new``: each new field at most once, each old one at most once.

    Values are read only of fields that start or stop, and only in the two files of the change.
    """
    starts = cat.where("fresh").select("feed_id", "n", F.col("field").alias("new"))
    stops = cat.where("gone").select("feed_id", (F.col("n") + 1).alias("n"), F.col("field").alias("old"))
    both = starts.join(stops, ["feed_id", "n"])
    both = cut_lineage(both)
    wanted = both.select("feed_id", F.col("n").alias("at"), "n", F.col("new").alias("field"), F.lit(True).alias("is_new")).unionByName(both.select("feed_id", (F.col("n") - 1).alias("at"), "n", F.col("old").alias("field"), F.lit(False).alias("is_new"))).distinct()
    wanted = wanted.join(files.select("feed_id", "file_no", F.col("n").alias("at")), ["feed_id", "at"])
    # The rows of a file are filtered where they are read; a file's list of fields is a row of the catalogue.
    lists = wanted.groupBy("feed_id", "file_no").agg(F.collect_set(F.struct("field", "n", "is_new")).alias("wanted"))
    values = parsed.where("rec is not null").join(bounded_broadcast(lists, lists.count()), ["feed_id", "file_no"]).select("feed_id", "record_kind", "rec", F.explode("wanted").alias("w"), "fields")
    values = values.select("feed_id", "record_kind", "rec", "w.n", "w.field", "w.is_new", F.try_element_at(F.filter("fields", lambda f: f["field"] == F.col("w.field")), F.lit(1)).alias("f")).where("f is not null")
    values = cut_lineage(values.select("feed_id", "n", "record_kind", "rec", "field", "is_new", F.col("f.type").alias("type"), value_of(F.col("f")).alias("value")).distinct())
    was = values.where("not is_new").select("feed_id", "n", "record_kind", "rec", F.col("field").alias("old"), F.col("value").alias("v0"), F.col("type").alias("t0"))
    now = values.where("is_new").select("feed_id", "n", "record_kind", "rec", F.col("field").alias("new"), F.col("value").alias("v1"), F.col("type").alias("t1"))
    held = both.join(was, ["feed_id", "n", "old"]).join(now, ["feed_id", "n", "new", "record_kind", "rec"])
    number = lambda c: F.expr(f"try_cast({c} as double)")
    truth = lambda c: F.when(F.lower(F.col(c)).isin("true", "1"), True).when(F.lower(F.col(c)).isin("false", "0", "0.0"), False).otherwise(number(c) != 0)
    same = (F.col("v0") == F.col("v1")) | (number("v0") == number("v1")) | (((F.col("t0") == "boolean") != (F.col("t1") == "boolean")) & (truth("v0") == truth("v1")))
    known = F.col("v0").isNotNull() & F.col("v1").isNotNull() & F.col("t0").isNotNull() & F.col("t1").isNotNull()
    score = held.groupBy("feed_id", "n", "old", "new").agg(F.sum(F.when(known & same, 1).otherwise(0)).alias("agree"), F.sum(known.cast("int")).alias("both"))
    proven = score.where(F.col("agree") >= F.greatest(F.lit(1), F.lit(RENAME_AGREE) * F.col("both")))
    # Where no record holds both values, the alias table of the other feeds decides.
    table_ = proven.select("old", "new").distinct().withColumn("alias", F.lit(True))
    aliases = table_.union(table_.select(F.col("new"), F.col("old"), "alias")).distinct()
    silent = both.join(score.where("both > 0").select("feed_id", "n", "old", "new"), ["feed_id", "n", "old", "new"], "left_anti")
    silent = silent.join(aliases, ["old", "new"]).select("feed_id", "n", "old", "new", F.lit(0).alias("agree"))
    pairs = proven.select("feed_id", "n", "old", "new", "agree").unionByName(silent)
    best_new = F.row_number().over(W.partitionBy("feed_id", "n", "new").orderBy(F.desc("agree"), "old"))
    best_old = F.row_number().over(W.partitionBy("feed_id", "n", "old").orderBy(F.desc("agree"), "new"))
    return pairs.withColumn("_a", best_new).withColumn("_b", best_old).where("_a = 1 and _b = 1").select("feed_id", "n", "old", "new")


def _retypes(cat: DataFrame, renamed: DataFrame) -> DataFrame:
    """``feed_id, n, field``: the type differs from the last one along the field's lineage."""
    first = W.partitionBy("feed_id", "field", "isle")
    inside = lifespans(cat).withColumn("_first", F.min("first_n").over(first)).where("first_n > _first").select("feed_id", F.col("first_n").alias("n"), "field")
    isles = cat.groupBy("feed_id", "field", "isle").agg(F.max("n").alias("end"), F.min_by("type", F.when(F.col("type").isNotNull(), F.col("n"))).alias("first_type"), F.min(F.when(F.col("type").isNotNull(), F.col("n"))).alias("at"), F.max_by("type", F.when(F.col("type").isNotNull(), F.col("n"))).alias("last_type"))
    parent = isles.select("feed_id", F.col("field").alias("old"), (F.col("end") + 1).alias("n"), F.col("isle").alias("up"), F.col("last_type").alias("up_type"))
    links = renamed.join(parent, ["feed_id", "n", "old"]).select("feed_id", F.col("new").alias("field"), F.col("n").alias("isle"), "old", "up", "up_type")
    links = cut_lineage(links)
    open_ = isles.join(links, ["feed_id", "field", "isle"]).select("feed_id", "field", "at", "first_type", F.col("old").alias("up_field"), "up", "up_type").where("first_type is not null")
    across = None
    # An ancestor without any type passes the question on; its own ancestor answers.
    while True:
        got = open_.where("up_type is not null and up_type <> first_type").select("feed_id", F.col("at").alias("n"), "field")
        across = got if across is None else across.unionByName(got)
        rest = open_.where("up_type is null").drop("up_type")
        up = links.select("feed_id", F.col("field").alias("up_field"), F.col("isle").alias("up"), F.col("old").alias("_f"), F.col("up").alias("_u"), F.col("up_type"))
        rest = rest.join(up, ["feed_id", "up_field", "up"]).select("feed_id", "field", "at", "first_type", F.col("_f").alias("up_field"), F.col("_u").alias("up"), "up_type")
        rest = cut_lineage(rest)
        if rest.isEmpty():
            return inside.unionByName(across).distinct()
        open_ = rest


def changes(records: DataFrame) -> DataFrame:
    """``feed_id, file_no, field, change``: each change of a field against the feed's preceding file."""
    parsed = read_records(records).persist()
    files, cat = catalogue(parsed)
    cat = cut_lineage(cat)
    ren = cut_lineage(renames(parsed, files, cat))
    parsed.unpersist()
    starts = cat.where("fresh").select("feed_id", "n", "field")
    stops = cat.where("gone").select("feed_id", (F.col("n") + 1).alias("n"), "field")
    added = starts.join(ren.select("feed_id", "n", F.col("new").alias("field")), ["feed_id", "n", "field"], "left_anti")
    removed = stops.join(ren.select("feed_id", "n", F.col("old").alias("field")), ["feed_id", "n", "field"], "left_anti")
    log = added.withColumn("change", F.lit("added"))
    log = log.unionByName(removed.withColumn("change", F.lit("removed")))
    log = log.unionByName(ren.select("feed_id", "n", F.col("new").alias("field"), F.lit("renamed").alias("change")))
    log = log.unionByName(_retypes(cat, ren).withColumn("change", F.lit("retyped")))
    return log.join(files.select("feed_id", "file_no", "n"), ["feed_id", "n"]).select("feed_id", "file_no", "field", "change")


def spans(records: DataFrame) -> DataFrame:
    """``feed_id, field, type, first_file, last_file``: the lifespan of each type of each field of a feed."""
    files, cat = catalogue(read_records(records))
    f = files.select("feed_id", "n", "file_no")
    at = lambda side: f.select("feed_id", F.col("n").alias(f"{side}_n"), F.col("file_no").alias(f"{side}_file"))
    return lifespans(cut_lineage(cat)).join(at("first"), ["feed_id", "first_n"]).join(at("last"), ["feed_id", "last_n"]).select("feed_id", "field", "type", "first_file", "last_file")


#: Fields of the consistent table and their types (fixed values of the data model).
PAGE_AND_DECISION_FIELDS = {
    "project_id": "bigint", "page_index": "bigint", "pair_index": "bigint", "source_image": "string", "width": "bigint", "height": "bigint",
    "page_asset_sha256": "string", "page_asset_byte_size": "bigint", "page_asset_version": "bigint", "selected_text": "string", "actor": "string",
    "risk_score": "double", "created_at": "timestamp",
}


def alias_table(pairs: list[tuple[str, str]], targets: list[str]) -> dict[str, str]:
    """The field of ``targets`` that each name leads to over renames, in both directions and in chains.

    A name never leads to two fields: the nearest keeps it, of equally near ones the alphabetically first.
    """
    next_: dict[str, set[str]] = {}
    for a, b in pairs:
        next_.setdefault(a, set()).add(b)
        next_.setdefault(b, set()).add(a)
    known = {t: t for t in targets}
    edge = sorted(targets)
    while edge:
        found: dict[str, str] = {}
        for name in edge:
            for x in next_.get(name, ()):
                if x not in known:
                    found[x] = min(found.get(x, known[name]), known[name])
        known |= found
        edge = sorted(found)
    return known


def unified(records: DataFrame, targets: dict[str, str] | None = None) -> DataFrame:
    """One typed row per feed, file and record, from one payload: the last of the file by ``row_no``.

    The casts come from the alias table: the names under which a field was found by its
    values, the field's own name first, of others the first that holds a value. A boolean
    for a number reads as 1 or 0. Values that don't fit the type become null and are named
    in ``misfits``. Fields outside the table stay in ``other``. Payloads without an id are
    records of their own, with a null ``record_id``. Feeds' names are schema, not data:
    the distinct renames are gathered, as many as there are names.
    """
    targets = targets or PAGE_AND_DECISION_FIELDS
    parsed = read_records(records).persist()
    files, cat = catalogue(parsed)
    pairs = [tuple(r) for r in renames(parsed, files, cut_lineage(cat)).select("old", "new").distinct().toLocalIterator()]
    names = alias_table(pairs, list(targets))
    of = {k: [k, *sorted(a for a, t in names.items() if t == k and a != k)] for k in targets}
    one = parsed.groupBy("feed_id", "file_no", "record_kind", F.col("rec").alias("record_id"), F.when(F.col("rec").isNull(), F.col("row_no")).alias("_row")).agg(F.max_by("fields", F.struct("row_no", "digest")).alias("fields"))
    cols, misfits = [], []
    named = lambda a: F.filter("fields", lambda f: (f["field"] == a) & f["type"].isNotNull())
    for k, t in targets.items():
        held = F.flatten(F.array(*[named(a) for a in of[k]]))
        first = F.try_element_at(held, F.lit(1))
        text = value_of(first)
        text = F.when((first["type"] == "boolean") & F.lit(t in ("bigint", "double")), F.when(text == "true", "1").otherwise("0")).otherwise(text)
        value = text.try_cast(t)
        cols.append(value.alias(k))
        misfits.append(F.when(text.isNotNull() & value.isNull(), F.lit(k)))
    taken = [*names, "id"]
    rest = F.filter("fields", lambda f: ~f["field"].isin(taken))
    other = F.map_from_entries(F.array_sort(F.transform(rest, lambda f: F.struct(f["field"].alias("key"), value_of(f).alias("value"))))).alias("other")
    return one.select("feed_id", "file_no", "record_kind", "record_id", *cols, F.array_compact(F.array(*misfits)).alias("misfits"), other)
