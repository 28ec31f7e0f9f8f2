import pytest

from versoflow.llm import ocr_noise as on

RIGHT = ["A GRADUAL PAMPHLET", "The garden of the old merchant was", "not under the cross-beam, and their disco-", "very carried the cross-beam near the", "sea-wall. In 1713 the garden opened and the cross-", "beam was the discovery of the merchant.", "{n}"]
Y = [0.041, 0.2, 0.3, 0.4, 0.5, 0.6, 0.951]


def book(wrong=None):
    """Six pages by two readers; ``wrong`` maps (page, reader, line) to (text, confidence)."""
    lines, runs, pages, al, k = [], [], [], [], 0
    for p in range(6):
        pages.append((p + 1, 1, p))
        members = {}
        for r in range(2):
            run = 10 * (p + 1) + r
            runs.append((run, p + 1))
            members[r] = []
            for i, t in enumerate(RIGHT):
                text, conf = (wrong or {}).get((p, r, i), (t.format(n=p + 3), 0.95))
                k += 1
                lines.append((k, run, 1, i, text, 0.1, Y[i] + 0.0003 * r, 0.7, 0.018, conf))
                members[r].append(i)
        al += [(p + 1, i, 10 * (p + 1), 10 * (p + 1) + 1, [i], [i]) for i in range(len(RIGHT))]
    return lines, runs, pages, al


LINES = "id bigint, run_id bigint, project_id bigint, line_index bigint, text string, x double, y double, width double, height double, confidence double"
AL = "page_id bigint, pair_index bigint, primary_run_id bigint, secondary_run_id bigint, primary_members array<bigint>, secondary_members array<bigint>"
DEC = "id bigint, page_id bigint, pair_index bigint, selected_text string"


def noise(spark, parts, decisions=()):
    lines, runs, pages, al = parts
    mk = spark.createDataFrame
    lex = mk([(w, "en") for w in "the garden of old merchant was not under and their carried near opened beam sea wall".split()], "word string, lang string")
    got = on.page_noise(mk(lines, LINES), mk(runs, "id bigint, page_id bigint"), mk(pages, "id bigint, project_id bigint, page_index bigint"), mk(al, AL), mk(list(decisions), DEC), lex)
    return {(r.kind, r.id, r.noise) for r in got.collect()}


def ident(p, r, i):
    return (p * 2 + r) * len(RIGHT) + i + 1


def test_clean_book_has_furniture_and_broken_words_only(spark):
    got = noise(spark, book(), [(1, 1, 2, RIGHT[2]), (2, 1, 0, RIGHT[0]), (3, 1, 1, RIGHT[1]), (4, 1, 4, RIGHT[4]), (5, 1, 1, None)])
    want = set()
    for p in range(6):
        for r in range(2):
            want |= {("ocr_line", ident(p, r, 0), "furniture"), ("ocr_line", ident(p, r, 6), "furniture"), ("ocr_line", ident(p, r, 2), "hyphen")}
    assert got == want | {("decision", 1, "hyphen"), ("decision", 2, "furniture")}


def test_misread_heads_numbers_and_words(spark):
    wrong = {
        (0, 0, 0): ("A GKADUAL PAMPHLET", 0.9), (1, 0, 6): ("A", 0.9), (2, 0, 1): ("The gardcn of the old merchant was", 0.7),
        (3, 0, 1): ("The garden of the old rnerchant was", None), (4, 0, 1): ("The garden of the old merchant was", None), (5, 0, 2): ("not under the cross-beam, and their disco¬", 0.9),
        (5, 1, 3): ("very carried the cross-bearn near the", None), (2, 1, 4): ("sea-wаll. In 1713 the garden opened and the cross-", 0.95),
    }
    got = noise(spark, book(wrong), [(1, 3, 1, "The gardcn of the old merchant was;"), (2, 3, 1, "The garden of the old merchant was"), (3, 4, 1, "The garden of the o1d merchant was")])
    glyph = {("ocr_line", ident(2, 0, 1), "glyph"), ("ocr_line", ident(3, 0, 1), "glyph"), ("ocr_line", ident(5, 1, 3), "glyph"), ("decision", 1, "glyph"), ("decision", 3, "glyph")}
    assert {x for x in got if x[2] == "glyph"} == glyph
    assert ("ocr_line", ident(0, 0, 0), "furniture") in got and ("ocr_line", ident(1, 0, 6), "furniture") in got
    assert ("ocr_line", ident(5, 0, 2), "hyphen") in got
    assert len({x for x in got if x[2] == "hyphen"}) == 12


def test_titles_headings_and_repeated_rows(spark):
    lines, runs, pages, al = book()
    extra = [(900, 10, 1, 7, "A GRADUAL PAMPHLET", 0.3, 0.052, 0.4, 0.018, 0.9), (901, 10, 1, 8, "Chapter 1. The garden", 0.3, 0.06, 0.4, 0.018, 0.9), (902, 10, 1, 9, "40", 0.3, 0.45, 0.1, 0.018, 0.9)]
    got = noise(spark, (lines + lines[:9] + extra, runs + runs[:2], pages, al + al[:3]))
    assert not {x for x in got if x[1] >= 900}
    assert len({x for x in got if x[2] == "furniture"}) == 24


def test_nulls_and_empty_tables(spark):
    lines, runs, pages, al = book()
    odd = [(800, None, None, None, None, None, None, None, None, None), (801, 999, 1, 0, "", 0.1, 0.2, 0.7, 0.018, None), (802, 10, 1, None, "x" * 100_000, 0.1, 0.3, 0.7, 0.018, 0.9), (None, 10, 1, 0, "y", 0.1, 0.3, 0.7, 0.018, 0.9)]
    got = noise(spark, (lines + odd, runs, pages, al), [(None, 1, 1, "x"), (7, None, None, "the cross-"), (8, 1, 99, "")])
    assert not {x for x in got if x[1] in (800, 801, 802)}
    mk = spark.createDataFrame
    none = on.page_noise(mk([], LINES), mk([], "id bigint, page_id bigint"), mk([], "id bigint, project_id bigint, page_index bigint"), mk([], AL), mk([], DEC), mk([], "word string, lang string"))
    assert none.count() == 0


@pytest.mark.parametrize("read,printed", [("gardcn", "garden"), ("rnerchant", "merchant"), ("garclen", "garden"), ("vvall", "wall")])
def test_variants_undo_one_confusion(read, printed):
    assert printed in on._variants(read)
