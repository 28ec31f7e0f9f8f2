import json

import pytest
from pyspark.sql import functions as F

from versoflow.operators import drift

SCHEMA = "feed_id bigint, record_kind string, file_no bigint, row_no bigint, payload string"


def feed(spark, files, feed_id=1):
    rows = [(feed_id, "page", n, k, p if isinstance(p, str) or p is None else json.dumps(p)) for n, recs in files.items() for k, p in enumerate(recs)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.file_no, r.field, r.change) for r in drift.changes(df).collect()}


def recs(**fields):
    return [{"id": i, **{k: (v(i) if callable(v) else v) for k, v in fields.items()}} for i in range(1, 13)]


def test_added_removed_renamed_retyped(spark):
    files = {
        1: recs(version=lambda i: i, score=lambda i: i / 10, gone="x"),
        2: recs(version=lambda i: str(i), score=lambda i: i / 10),
        4: recs(version=lambda i: str(i), riskScore=lambda i: [i / 10], note=lambda i: f"n{i}"),
        5: recs(version=None, riskScore=None, note=lambda i: f"n{i}"),
        7: recs(version=lambda i: i, risk=lambda i: {"value": i / 10}, note=lambda i: f"n{i}"),
    }
    assert found(feed(spark, files)) == {
        (2, "version", "retyped"), (2, "gone", "removed"), (4, "riskScore", "renamed"), (4, "riskScore", "retyped"), (4, "note", "added"),
        (7, "version", "retyped"), (7, "risk", "added"), (7, "riskScore", "removed"),
    }


def test_rename_is_known_though_ids_change_type(spark):
    a, b = recs(v=lambda i: i * 7), recs(w=lambda i: i * 7)
    for r in b:
        r["id"] = str(r["id"])
    assert found(feed(spark, {1: a, 2: b})) == {(2, "w", "renamed"), (2, "id", "retyped")}


def test_unlike_values_are_no_rename_and_readded_field_starts_anew(spark):
    files = {1: recs(a=lambda i: i), 2: recs(b=lambda i: f"x{i}"), 3: recs(a=lambda i: f"y{i}")}
    assert found(feed(spark, files)) == {(2, "a", "removed"), (2, "b", "added"), (3, "b", "removed"), (3, "a", "added")}


def test_boolean_does_not_pass_for_a_number(spark):
    files = {1: recs(version=1), 2: recs(checked=lambda i: i % 2 == 0)}
    assert found(feed(spark, files)) == {(2, "version", "removed"), (2, "checked", "added")}


def test_broken_null_empty_and_repeated_payloads(spark):
    files = {1: [*recs(a=1), '{"id": 3, "a', None, "", "[1]", "7"], 2: [*recs(a=1), *recs(a=1)]}
    assert found(feed(spark, files)) == set()
    assert drift.changes(feed(spark, {1: []})).count() == 0


def test_unified_reads_every_name_and_type(spark):
    df = feed(spark, {1: recs(risk_score=lambda i: i / 10, page_index=lambda i: str(i)), 2: recs(riskScore=lambda i: [i / 10], page_index=lambda i: i, colour="red")})
    u = {(r.file_no, r.record_id): r for r in drift.unified(df).collect()}
    assert u[1, "3"].risk_score == pytest.approx(0.3) and u[2, "3"].risk_score == pytest.approx(0.3)
    assert u[1, "3"].page_index == 3 and u[2, "3"].other == {"colour": "red"}


def test_unified_takes_one_payload_whole_and_names_misfits(spark):
    rows = [{"id": 1, "width": 900, "height": 10}, {"id": 1, "width": 10, "height": 900}, {"width": 5}, {"id": 2, "width": "wide", "height": True}]
    u = {(r.record_id, r.width): r for r in drift.unified(feed(spark, {1: rows})).collect()}
    assert (u["1", 10].height, len(u)) == (900, 3) and u[None, 5].height is None
    assert u["2", None].misfits == ["width"] and u["2", None].height == 1


def test_alias_table_goes_both_ways_and_in_chains():
    assert drift.alias_table([("score", "risk"), ("risk", "risk_score"), ("a", "b")], ["risk_score", "b"]) == {"risk_score": "risk_score", "b": "b", "risk": "risk_score", "a": "b", "score": "risk_score"}


def test_lifespans_of_types(spark):
    files = {1: recs(v=1), 2: recs(v="x"), 3: recs(v=None), 4: recs(v="y"), 5: recs(w=1), 6: recs(v=2)}
    got = {(r.field, r.type, r.first_file, r.last_file) for r in drift.spans(feed(spark, files)).collect() if r.field != "id"}
    assert got == {("v", "number", 1, 1), ("v", "string", 2, 4), ("w", "number", 5, 5), ("v", "number", 6, 6)}


def test_key_written_twice_counts_once_as_last(spark):
    df = feed(spark, {1: ['{"id": 1, "a": 1, "a": "x"}']})
    got = drift.read_records(df).select(F.transform("fields", lambda f: F.struct(f["field"], f["type"], drift.value_of(f))).alias("f")).first().f
    assert [tuple(f) for f in got] == [("id", "number", "1"), ("a", "string", "x")]
