from datetime import datetime

import pytest
from pyspark.sql import functions as F

from versoflow.llm import lookalikes as lk
from versoflow.llm import ocr_noise as on

from .test_ocr_noise import AL, LINES, book
from .test_paragraphs import CLEAN, DEC

PLAIN = "the garden gorden of old merchant was not under and their carried near opened beam sea wall".split()


@pytest.fixture(scope="module")
def lexicons(spark):
    """A short list and the same among a million other words."""
    short = spark.createDataFrame([(w,) for w in [*PLAIN, "Été", "ロー"]], "word string")
    return short, short.unionByName(spark.range(1_000_001).select(F.concat(F.lit("zz"), "id").alias("word")))


def test_p1_is_the_same_by_a_list_of_any_length(spark, lexicons):
    wrong = {(2, r, 1): ("The gorden of the old rnerchant was", None) for r in range(2)} | {(3, 0, 1): ("The gorden of the old merchant was", None)}
    lines, runs, pages, al = book(wrong)
    mk = spark.createDataFrame
    parts = mk(lines, LINES), mk(runs, "id bigint, page_id bigint"), mk(pages, "id bigint, project_id bigint, page_index bigint"), mk(al, AL), mk([(1, 5, 1, "The gorden of the old merchant was", datetime(2025, 1, 1))], DEC)
    noise = [{(r.kind, r.id, r.noise) for r in on.page_noise(*parts, lex).collect()} for lex in lexicons]
    texts = [{r.page_id: r.text for r in on.page_paragraphs(*parts, lex).collect()} for lex in lexicons]
    assert noise[0] == noise[1] and texts[0] == texts[1]
    assert texts[0][3] == texts[0][5] == CLEAN.replace("The garden", "The gorden")


def test_p4_is_the_same_by_a_list_of_any_length(spark, lexicons):
    texts = ["gаrden", "Gаrdеns", "口一", "Été", "zz1000000а", "第一章", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [{r.id: r.canonical for r in lk.with_canonical(df, "text", lk.vocabulary(lex)).collect()} for lex in lexicons]
    assert got[0] == got[1] and got[0][2] == "ロー"
    assert [got[0][k] for k in (0, 1, 3, 5, 6, 7)] == ["garden", "Gardens", "Été", "第一章", None, ""]


def test_trie_of_a_file_is_that_of_a_list_also_if_it_forgets(spark, monkeypatch):
    words = ["garden", "gar", "été", "été", "ロープ", "三", "a􏿿b", "a"]
    filed = lk.vocabulary(spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string"))
    assert list(filed) == sorted({lk._composed(w) for w in words}) and "été" in filed and "" not in filed and "zz" not in filed
    monkeypatch.setattr(lk.LookTrie, "MEMO", 1)
    few = lk.LookTrie(filed, budget=1)
    for run in ("gаrdcn", "gаr", "口一プ", "étе́", "三千", "xyz"):
        assert few.spell(run) == lk.LookTrie(words, budget=1).spell(run)


def test_no_words(spark):
    none = lk.vocabulary(spark.createDataFrame([], "word string"))
    assert list(none) == [] and "a" not in none and lk.LookTrie(none).canonical("gаrden") == "garden"
