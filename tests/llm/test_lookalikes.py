import unicodedata

import pytest

from versoflow.llm import lookalikes as lk

WORDS = ("garden", "ロープ", "カメラ", "時間", "été", "一", "fifty")
TRIE = lk.LookTrie(WORDS)

SAME = [("garden", "gаrden"), ("garden", "ｇａｒｄｅｎ"), ("garden", "gar­den"), ("garden", "gar​﻿den"), ("a b", "a b"), ("a b", "a b"), ("été", "été"), ("fifty", "ﬁfty"), ("ロープ", "ﾛｰﾌﾟ"), ("ロープ", "口一プ"), ("カメラ", "力メラ"), ("人", "⼈"), ("離", "離"), ("é", "е́"), ("ＡＢ１", "AB1"), ("Garden", "Gаrdеn"), ("", "​")]
OTHER = [("l", "1"), ("O", "0"), ("I", "l"), ("e", "é"), ("2", "²"), ("1", "¹"), ("-", "–"), ("-", "¬"), ("a b", "ab"), ("人", "入"), ("土", "士"), ("rn", "m"), ("ｌ", "1"), ("garden", "gardem"), ("a", "A"), ("ば", "は"), ("½", "1/2")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert lk.look(a) == lk.look(b)
    assert TRIE.canonical(a) == TRIE.canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(a, b):
    assert lk.look(a) != lk.look(b)
    assert TRIE.canonical(a) != TRIE.canonical(b)


def test_spelling_comes_from_the_vocabulary():
    assert TRIE.canonical("口一プ") == "ロープ" and TRIE.canonical("ｇаrden") == "garden"
    assert TRIE.canonical("Gаrdеns") == "Gardens" and TRIE.canonical(None) is None


def test_forms_are_stable():
    for a, b in SAME + OTHER:
        for x in (a, b):
            assert lk.look(lk.look(x)) == lk.look(x)
            assert TRIE.canonical(TRIE.canonical(x)) == TRIE.canonical(x)
            assert unicodedata.is_normalized("NFC", lk.look(x))


REC = "page_id bigint, pair_index bigint, kind string, id bigint, text string"


def test_pairs_match_brute_force(spark):
    texts = ["garden", "gаrden", "ｇarden", "garden", "gardem", "été", "été", ""]
    rows = [(p, q, kind, 10 * p + k, texts[(k * 3 + p + q) % 8]) for p in range(3) for q in (0, 1) for k in range(6) for kind in ("decision", "ocr_line", "vlm_review")]
    rows += rows[:5]
    got = {tuple(r) for r in lk.same_look_pairs(spark.createDataFrame(rows, REC), WORDS).collect()}
    want = set()
    for a in set(rows):
        for b in set(rows):
            if a[:2] == b[:2] and (a[2], a[3]) < (b[2], b[3]) and a[4] != b[4] and lk.look(a[4]) == lk.look(b[4]):
                want.add((a[2], a[3], b[2], b[3]))
    assert got == want and want


def test_records_with_nulls_and_empty_tables(spark):
    lines = spark.createDataFrame([(1, 7, 0, "ab"), (2, 7, 1, None), (None, 7, 0, "x")], "id bigint, run_id bigint, line_index bigint, text string")
    al = spark.createDataFrame([(5, 0, 7, 8, [0, 1], None)], "page_id bigint, pair_index bigint, primary_run_id bigint, secondary_run_id bigint, primary_members array<bigint>, secondary_members array<bigint>")
    rv = spark.createDataFrame([(3, 5, 0, "аb")], "id bigint, page_id bigint, pair_index bigint, text string")
    de = spark.createDataFrame([(4, 5, 0, None)], "id bigint, page_id bigint, pair_index bigint, selected_text string")
    recs = lk.line_records(lines, al, rv, de)
    assert {(r.kind, r.id) for r in recs.collect()} == {("ocr_line", 1), ("vlm_review", 3)}
    assert [tuple(r) for r in lk.same_look_pairs(recs, WORDS).collect()] == [("ocr_line", 1, "vlm_review", 3)]
    assert lk.same_look_pairs(recs.where("false"), ()).count() == 0


def test_chinese_characters_stay_and_kana_only_beside_katakana():
    t = lk.LookTrie(["三", "人"])
    for text in ("第一章", "三千人", "八", "口", "入口", "夕方"):
        assert t.canonical(text) == text
    assert t.canonical("カ一テン") == t.canonical("力ーテン") == t.canonical("カーテン") == "カーテン"
    assert t.canonical("第ー章") == "第一章" and t.canonical("三干") != t.canonical("三千")


def test_raw_runs_take_edges_for_nothing_and_others_cost():
    t = lk.LookTrie(["garden", "été", "ﬁn"])
    assert t.spell("gаr​dеn") == "garden" and t.spell("éte‍́") == "été"
    assert t.spell("gardcn") == "gardcn" and lk.LookTrie(["garden"], budget=1).spell("gаrdcn") == "garden"
    assert t.spell("​") == "" and t.spell("́") == "́"


@pytest.mark.parametrize("text", ["Ｇａｒｄｅｎ ﬁn", "ẹ́ ẹ́", "ｶﾞｷﾞ", "각 각", "a̸​̈"])
def test_form_depends_on_the_look_alone(text):
    t = lk.LookTrie(["garden", "fin"])
    assert t.canonical(text) == t.canonical(lk.look(text)) or lk.look(text).isascii()
    assert lk.look(t.canonical(text)) == lk.look(text)
