import json

from versoflow.operators import events as ev
from versoflow.streaming import pages as sp


def lines(*events):
    return "\n".join(e if isinstance(e, str) else json.dumps(e) for e in events)


def event(ts, kind, page=None, **more):
    return {"ts": 1_700_000_000 + ts, "event": kind, "run": "r", **({} if page is None else {"page_index": page}), **more}


LOG = [
    event(0, "page_started", 1), event(2, "page_finished", 1, elapsed_seconds=2.0), "", '{"cut', "[1]", '{"ts": 1}', event(3, "page_started", 2), event(4, "page_failed", 2, error="x"),
    event(5, "page_started", 2), event(6, "page_started", 3), event(7, "stage_finished", 1, stage="ocr", elapsed_seconds=1.5), event(400, "stage_finished", 1, stage="ocr", elapsed_seconds=2.5),
]


def test_batch_parsing_and_flight(spark):
    e = ev.parse_events(spark.createDataFrame([(x,) for x in lines(*LOG).split("\n")] + [(None,)], "value string"))
    assert e.count() == 8
    assert {r.page_index for r in ev.in_flight(e, "page_index", ["ts"], "event", "page_started", ["page_finished", "page_failed"]).collect()} == {2, 3}
    t = ev.stage_totals(e, "stage", "elapsed_seconds").where("stage = 'ocr'").first()
    assert (t.n, t.total, t["mean"]) == (2, 4.0, 2.0)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()


def test_windows_and_states_agree_with_batch(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(lines(*LOG))
    drain(sp.stage_windows(sp.event_stream(spark, str(tmp_path))), "windows", "complete")
    assert sorted((r.stage, r.n, r.seconds) for r in spark.table("windows").collect()) == [("ocr", 1, 1.5), ("ocr", 1, 2.5)]
    drain(sp.page_states(sp.event_stream(spark, str(tmp_path))), "states", "update")
    got = {r.page_index: (r.state, r.seconds, r.error) for r in spark.table("states").collect()}
    assert got == {1: ("finished", 2.0, None), 2: ("started", None, None), 3: ("started", None, None)}


def test_replayed_batch_adds_nothing(spark, tmp_path):
    sink = sp.journal_sink(str(tmp_path / "j"), ["id"])
    b = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    sink(b, 0)
    sink(b, 0)
    sink(spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string"), 1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "j")).collect()) == [1, 2, 3]
