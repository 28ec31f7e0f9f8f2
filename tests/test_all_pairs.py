from versoflow.plans import evidence as ev

TEXTS = [("garçon über, «né»", "garcon uber, né."), ("中文，書。「人」", "中女,書。人」"), ("plain text.", "plain texf."), ("ß", ""), ("……", "…")]
MARKS = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~，。！？；：、“”‘’「」『』…—–")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
    return row[-1]


def test_all_pairs_against_brute_force(spark, monkeypatch):
    t = spark.createDataFrame([(1 + k // 3, k, a, b) for k, (a, b) in enumerate(TEXTS)] + [(9, 9, "é", None)], "page_id bigint, pair_index bigint, p_text string, s_text string")
    monkeypatch.setattr(ev, "two_sides", lambda s, d: t)
    monkeypatch.setattr(ev, "pages", lambda s, d: spark.createDataFrame([(1, 7), (2, 8)], "id bigint, project_id bigint"))
    got = {r.pair_index: (r.edits, r.chars) for r in ev.QUERIES["cer_line_all"](spark, "").collect()}
    want = {k: (distance(a, b), len(a)) for k, (a, b) in enumerate(TEXTS)}
    assert got == want
    strata = {r.project_id: (r.lines, r.edits, r.chars) for r in ev.QUERIES["cer_strata_all"](spark, "").collect()}
    assert strata == {p: (len(ks), sum(want[k][0] for k in ks), sum(want[k][1] for k in ks)) for p, ks in ((7, [0, 1, 2]), (8, [3, 4]))}
    acc = {r.pair_index: r.accuracy for r in ev.QUERIES["punctuation_accuracy_all"](spark, "").collect()}
    marks = lambda x: [c for c in x if c in MARKS]
    for k, (a, b) in enumerate(TEXTS):
        r, h = marks(a), marks(b)
        d = distance(r, h)
        assert acc[k] == round(max(0, 1 - d / len(r)) if r else float(d == 0), 6)
