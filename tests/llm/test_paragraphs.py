from versoflow.llm import ocr_noise as on

from .test_ocr_noise import AL, LINES, book

DEC = "id bigint, page_id bigint, pair_index bigint, selected_text string, created_at timestamp"
CLEAN = "The garden of the old merchant was not under the cross-beam, and their discovery carried the cross-beam near the sea-wall. In 1713 the garden opened and the cross-beam was the discovery of the merchant."


def paragraphs(spark, parts, decisions=()):
    lines, runs, pages, al = parts
    mk = spark.createDataFrame
    lex = mk([(w, "en") for w in "the garden of old merchant was not under and their carried near opened beam sea wall".split()], "word string, lang string")
    got = on.page_paragraphs(mk(lines, LINES), mk(runs, "id bigint, page_id bigint"), mk(pages, "id bigint, project_id bigint, page_index bigint"), mk(al, AL), mk(list(decisions), DEC), lex)
    return {(r.page_id, r.paragraph): r.text for r in got.collect()}


def test_every_page_is_whole_words_without_furniture(spark):
    assert paragraphs(spark, book()) == {(p, 1): CLEAN for p in range(1, 7)}


def test_clean_reading_or_last_decision_goes_first_and_the_rest_is_put_right(spark):
    wrong = {
        (2, 0, 1): ("The gardcn of the old merchant was", 0.7), (3, 0, 1): ("The garden of the old rnerchant was", None), (3, 1, 1): ("The garden of the old rnerchant was", None), (4, 0, 2): ("not under the cross-beam, and their disco¬", 0.9),
    }
    from datetime import datetime

    decisions = [(1, 2, 1, "The garden of the merchant was", datetime(2025, 1, 1)), (2, 2, 1, "The garden of the old sea was", datetime(2025, 1, 2))]
    got = paragraphs(spark, book(wrong), decisions)
    assert got[(3, 1)] == got[(4, 1)] == got[(5, 1)] == CLEAN
    assert got[(2, 1)].startswith("The garden of the old sea was not")


def test_word_broken_over_the_page_and_pages_never_aligned(spark):
    lines, runs, pages, al = book({(0, r, 5): ("beam was the discovery of the mer-", 0.95) for r in range(2)} | {(1, r, 1): ("chant saw the garden of the old merchant", 0.95) for r in range(2)})
    got = paragraphs(spark, (lines, runs, pages, [a for a in al if a[0] != 6]))
    assert got[(1, 1)].endswith("of the merchant") and got[(2, 1)].startswith("saw the garden")
    assert got[(6, 1)] == CLEAN


def unit(k, text, start=0.1, end=0.8, at=None, hyphen=False):
    return {"pair_index": k, "k": 0, "text": text, "hyphen": hyphen, "glyph": False, "start": start, "end": end, "at": 0.2 + 0.02 * k if at is None else at}


def test_paragraphs_chains_and_cjk():
    us = [unit(0, "an inter-", hyphen=True), unit(1, "na-", hyphen=True), unit(2, "tional line."), unit(3, "Indented", start=0.15), unit(4, "far", at=0.6), unit(5, "人人"), unit(6, "門")]
    assert ["".join(t for t, _ in p) for p in on.join_page(us, False, None)] == ["an international line.", "Indented", "far人人門"]
    assert on._undone("The Gardcn, (rnerchant)", {"gardcn": "garden", "rnerchant": "merchant"}) == "The Garden, (merchant)"
