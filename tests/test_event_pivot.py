from datetime import datetime

from versoflow.plans import logs


def test_every_type_of_event_has_a_column(spark, monkeypatch):
    types = ["click", "view", "purchase", "signup", "error", "error"]
    t = spark.createDataFrame([(datetime(2025, 1, 1, 12), x) for x in types], "ts timestamp, event_type string")
    monkeypatch.setattr(logs, "table", lambda s, d, n: t)
    (r,) = logs.QUERIES["event_pivot_all"](spark, "").collect()
    assert (r.click, r.view, r.purchase, r.signup, r.error, r.all_events) == (1, 1, 1, 1, 2, 6)
