from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from versoflow.llm import packing as pk


@given(st.dictionaries(st.integers(0, 50), st.integers(1, 60), max_size=12), st.integers(50, 90))
@settings(max_examples=200, deadline=None)
def test_plan_is_whole_and_fits(hist, cap):
    plan, made = pk.plan_best_fit(hist, cap)
    load, seen = Counter(), defaultdict(list)
    for size, a, b, first, each in plan:
        assert a < b and each >= 1
        for r in range(a, b):
            seen[size].append(r)
            no = first + (r - a) // each
            assert no < max(made, 1)
            load[no] += size
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in hist.items()}
    assert all(v <= cap for v in load.values())
    # No worse than first fit would have to be: all but one container are more than half full.
    assert sum(1 for v in load.values() if 2 * v <= cap and v) <= 1


def test_fill_is_tight():
    hist = {k: 40 for k in range(1, 500)}
    plan, made = pk.plan_best_fit(hist, 2048)
    assert sum(k * n for k, n in hist.items()) / (made * 2048) > 0.99


SIZES = "doc_id bigint, n_tokens bigint"


def test_pack_keeps_documents_whole(spark):
    rows = [(i, (i * 37) % 90) for i in range(300)] + [(1000, 250), (1001, 100), (1002, 200), (1003, None), (1004, 0)] + [(2000 + i, 7) for i in range(500)]
    caps = spark.createDataFrame([("s", 100), ("l", 400), ("none", 0), (None, 5)], "container string, capacity_tokens bigint")
    got = pk.pack(spark.createDataFrame(rows, SIZES), caps).collect()
    for kind, cap in (("s", 100), ("l", 400)):
        mine = [r for r in got if r.container == kind]
        assert {r.doc_id: 0 for r in mine}.keys() == {d for d, _ in rows}
        load = Counter()
        for r in mine:
            load[r.container_no] += r.n_tokens
        assert max(load.values()) <= cap
        pieces = defaultdict(list)
        for r in mine:
            pieces[r.doc_id].append((r.piece_no, r.n_tokens))
        for d, n in rows:
            n = n or 0
            assert sum(x for _, x in pieces[d]) == n
            assert pieces[d] == [(0, n)] if n <= cap else sorted(k for k, _ in pieces[d]) == list(range(1, -(-n // cap) + 1))
    assert {r.container for r in got} == {"s", "l"}


def test_empty(spark):
    caps = spark.createDataFrame([("s", 100)], "container string, capacity_tokens bigint")
    assert pk.pack(spark.createDataFrame([], SIZES), caps).count() == 0
    assert pk.pack(spark.createDataFrame([(1, 5)], SIZES), caps.where("false")).count() == 0
