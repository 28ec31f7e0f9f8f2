"""Noise in text from scanned pages: page furniture, broken words, misread characters.

Furniture. Edge lines (the bands at the top and foot of a page) are stripped of numerals
and compared within their book: a text at one height on several pages, or one that differs
from such a text by a few characters, is a running head or foot. Numerals alone are page
numbers where their values follow the order of the pages at one height.

Broken words. A line that ends in a hyphen mark is joined with the first word of the line
printed next. If the corpus writes the two parts with a hyphen inside lines, the mark
belongs to the word; otherwise the word was broken.

Misread characters. A reader's confidence is one weight: a line read unsurely is misread,
one of the same look as a sure reading is not. All other lines, and sure ones whose second
reading differs, are judged by their words: a word that the vocabulary lacks and the other
reading does not have is misread if it mixes letters and figures, if the other reading's
word or one usual confusion makes it a word the corpus has far more often, or if the other
reading has nothing doubtful and the word stands nowhere else.

Texts are compared by their look (``lookalikes``). Rows repeated with the same id count
once; null and blank texts have no noise; lines without a run or page are judged alone.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.llm import page_block as block
from versoflow.llm.lookalikes import look
from versoflow.llm.page_block import ALONE
from versoflow.llm.word_list import word_list
from versoflow.session import cut_lineage, table

#: Bands of the page in which furniture may stand, as shares of its height.
EDGE_TOP, EDGE_FOOT = 0.1, 0.9
#: Lines of one kind of furniture differ in height by no more than this.
SAME_HEIGHT = 0.005
#: Share of the edge lines at one height, by the lower end of its 95 % interval, from which on all of them are furniture.
ALWAYS = 0.9
#: A reader is sure of a line from this confidence on.
SURE = 0.8
#: How much more frequent the right word must be than the misread one.
RATIO = 5

# Marks that readers give for the hyphen at a line's end.
HYPHENS = "-¬–=~‐‑—"
# Usual confusions, printed and read.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("l", "I"), ("l", "|"), ("i", "!"), ("s", "5"), ("g", "9"), ("t", "+"), ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("r", "i"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("s", "f"), ("y", "v"), ("v", "y"),
    ("m", "rn"), ("rn", "m"), ("w", "vv"), ("h", "li"), ("li", "h"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("k", "lc"), ("p", "jo"), ("ü", "ii"), ("ß", "B"), ("é", "e"), ("è", "e"), ("ê", "e"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ç", "c"), ("â", "a"), ("ô", "o"), ("à", "a"), ("û", "u"), ("î", "i"),
    ("O", "0"), ("I", "1"), ("S", "5"), ("E", "F"), ("F", "E"), ("R", "K"), ("H", "N"), ("C", "G"), ("B", "8"), ("5", "S"), ("8", "B"), ("1", "l"), ("4", "A"), ("7", "T"), ("0", "O"), ("3", "B"), ("¹", "1"), ("²", "2"), ("³", "3"),
    ("人", "入"), ("書", "晝"), ("石", "右"), ("台", "合"), ("白", "自"), ("門", "問"), ("問", "間"), ("天", "夫"), ("木", "本"), ("士", "土"), ("土", "士"), ("見", "貝"), ("田", "由"), ("市", "巾"), ("鳥", "烏"), ("烏", "鳥"), ("已", "己"), ("玉", "王"), ("王", "玉"), ("牛", "午"), ("午", "牛"), ("官", "宮"), ("宮", "官"), ("未", "朱"), ("日", "曰"), ("手", "毛"), ("大", "犬"), ("入", "人"), ("右", "石"), ("問", "門"), ("間", "問"), ("夫", "天"), ("本", "木"),
]
_BY_READ: dict[str, list[str]] = {}
for _printed, _read in CONFUSIONS:
    _BY_READ.setdefault(look(_read), []).append(look(_printed))

#: Marks and blanks at a line's end that do not count when texts are compared.
_CLOSING = "".join(c for c in map(chr, range(0x10000)) if c.isspace() or c in "¬=~|" or unicodedata.category(c)[0] == "P")
_WORD_EDGE = ".,;:?!\"()[]“”»«*¹²³、。，；：？！"
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: Numerals of any kind, with the marks printers put around them.
_NUMERAL = r"(?:\p{N}+|(?i:[ivxlc]{1,8})|[ーニミ○一二三四五六七八九十百〇ハ]{1,5})"
_ONLY_NUMBER = regex.compile(rf"[\[(\-–—\s]*(?:[pPsS]\.\s*)?{_NUMERAL}[\])\-–—.\s]*")
_WITH_NUMBER = regex.compile(rf"^[\[(\-–—\s]*(?:[pP]\.\s*)?{_NUMERAL}[\])\-–—\s]+(?=\S)|[\[(\-–—\s]+(?:[pP]\.\s*)?{_NUMERAL}[\])\-–—\s]*$")
_NO_LETTER = regex.compile(r"[^\p{L}\p{N}]+")
_MIXED = regex.compile(r"[\p{Latin}][0-9]|[0-9][\p{Latin}]|\p{Latin}[|!+]\p{Latin}|^[|!+]\p{Latin}|\p{Latin}[|+]$")
#: What is left of a page number when a reader mistook its figures.
_LIKE_NUMBER = regex.compile(r"[\[(\-–—\s]*(?:[pPsS]\.\s*)?[0-9A-Zl|!]{1,4}[\])\-–—\s]*")


def _seen(text: str) -> str:
    return text if text.isascii() else look(text)


def _words(text: str) -> list[str]:
    """Words of a looked-at line in lower case, without the part of a broken word at its end; runs of CJK as their character triples."""
    ws = text.lower().split()
    if ws and ws[-1][-1] in HYPHENS:
        ws.pop()
    if text.isascii():
        return [v for w in ws if (v := w.strip(_WORD_EDGE))]
    out = []
    for w in ws:
        v = w.strip(_WORD_EDGE)
        if v and not v.isascii() and _CJK.search(v):
            v = f"^{v}$"
            out += [v[i : i + 3] for i in range(len(v) - 2)]
        elif v:
            out.append(v)
    return out


def _key(seen: str) -> int:
    """Hash of the look of a text without its last marks."""
    short = seen.rstrip(_CLOSING)
    return xxhash.xxh64_intdigest(" ".join(short.split()) if "  " in short else short) - (1 << 63)


def _broken_part(seen: str) -> str | None:
    """The part of a word before a hyphen mark at the end of a line."""
    if seen[-1] not in HYPHENS:
        return None
    body = seen.rstrip(HYPHENS)
    w = body.split()[-1] if body and not body[-1].isspace() else ""
    w = w.strip(_WORD_EDGE).lower()
    return w if w and w[-1].isalpha() and not _CJK.search(w) else None


#: Words whose look a worker remembers; beyond it a word is looked at again.
MEMO_WORDS = 300_000

LINE_SCHEMA = "word string, n bigint, id bigint, run_id bigint, project_id bigint, line_index bigint, x double, y double, width double, height double, confidence double, key bigint, left string, head string, edge string, numeral boolean, value int, odd string"
#: Letters of roman numerals.
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
#: Figures of Chinese numerals by their look.
_HAN = {c: n for n, cs in enumerate(("○〇", "ー一", "ニ二", "ミ三", "四", "五", "六", "七", "ハ八", "九")) for c in cs}


def _number(seen: str) -> int | None:
    """The value of a page number, whatever stands around it; null if it has none."""
    t = regex.sub(r"^[\W_]*(?:[pPsS]\.)?[\W_]*|[\W_]+$", "", seen).lower()
    if t.isascii() and t.isdigit():
        return int(t) if len(t) < 7 else None
    if t and all(c in _ROMAN for c in t):
        v = [_ROMAN[c] for c in t]
        return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0], strict=True))
    if t and all(c in _HAN or c in "十百" for c in t):
        if all(c in _HAN for c in t):
            return int("".join(str(_HAN[c]) for c in t))
        total, digit = 0, None
        for c in t:
            if c in _HAN:
                digit = _HAN[c]
            else:
                total, digit = total + (1 if digit is None else digit) * (10 if c == "十" else 100), None
        return total + (digit or 0)
    return None


class LineReader:
    """What a line's text says, word by word; remembers words for a task's life.

    A doubted word is one that the vocabulary lacks; one that mixes letters and figures
    carries a mark in front. Runs of CJK are doubted whole and compared as triples.
    """

    def __init__(self, right: Container[str]):
        self.right = right
        self.memo: dict[str, tuple[str, list[str], list[str]]] = {}

    def word(self, w: str) -> tuple[str, list[str], list[str]]:
        s = _seen(w)
        words = _words(s + " .")
        odd = []
        for x in s.split():
            v = x.strip(_WORD_EDGE)
            if not v or len(v) > 4096:
                continue
            if not v.isascii() and _CJK.search(v):
                odd.append(f"^{v.lower()}$")
            elif _MIXED.search(v) and not (v[-1] == "!" and v[:-1].isalpha()):
                odd.append("\x01" + v.lower())
            elif v.lower() not in self.right:
                odd.append(v.lower())
        got = s, words, odd
        if len(self.memo) < MEMO_WORDS and len(w) < 32:
            self.memo[w] = got
        return got

    def line(self, text: str | None) -> tuple[str, list[str], str | None]:
        """The line's look, its words, and its doubted words in one string; a broken word at the end is none."""
        parts = [self.memo.get(v) or self.word(v) for v in text.split(" ")] if text else []
        s = " ".join([p[0] for p in parts]).strip()
        if not s:
            return "", [], None
        parts = parts[:-1] if s[-1] in HYPHENS else parts
        tokens: list[str] = []
        odd: list[str] = []
        for p in parts:
            tokens += p[1]
            if p[2]:
                odd += p[2]
        return s, tokens, " ".join(odd) if odd else None


def read_lines(lines: DataFrame, right: Container[str]) -> DataFrame:
    """One pass over the lines that gives rows of two kinds.

    With ``word`` null: a line with ``key``, ``left`` (the part before a hyphen at its
    end), ``head`` (its first word), ``edge`` (letters without numerals, of lines that may
    stand at a page's edge), ``numeral`` with its ``value``, and ``odd``, the words that
    the vocabulary lacks. With ``word``: a word or a triple of CJK characters and how often
    the task saw it. The text itself goes no further.
    """
    cols = ["id", "run_id", "project_id", "line_index", "x", "y", "width", "height", "confidence"]
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("id", pa.int64()), ("run_id", pa.int64()), ("project_id", pa.int64()), ("line_index", pa.int64()), *[(c, pa.float64()) for c in cols[4:]], ("key", pa.int64()), ("left", pa.string()), ("head", pa.string()), ("edge", pa.string()), ("numeral", pa.bool_()), ("value", pa.int32()), ("odd", pa.string())])

    def counted(c: Counter) -> pa.RecordBatch:
        n = len(c)
        known = {"word": pa.array(list(c.keys()), pa.string()), "n": pa.array(list(c.values()), pa.int64())}
        c.clear()
        return pa.RecordBatch.from_arrays([known[f.name] if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        reader = LineReader(right)
        for b in it:
            key, left, head, edge, numeral, value, odds = [], [], [], [], [], [], []
            x, y, w = (b.column(cols.index(k)).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y", "width"))
            inner = (y >= EDGE_TOP) & (y <= EDGE_FOOT) & ((w >= 0.05) | ((x >= EDGE_TOP) & (x <= 1 - EDGE_TOP)))
            tokens: list[str] = []
            for t, within in zip(b.column(len(cols)).to_pylist(), inner.tolist(), strict=True):
                s, words, odd = reader.line(t)
                odds.append(odd)
                if not s:
                    key.append(None), left.append(None), head.append(None), edge.append(None), numeral.append(False), value.append(None)
                    continue
                tokens += words
                key.append(_key(s))
                left.append(_broken_part(s) if s[-1] in HYPHENS else None)
                head.append(s.split(None, 1)[0].strip(_WORD_EDGE).lower() or None)
                num = (not within or len(s) <= 12) and _ONLY_NUMBER.fullmatch(s) is not None
                numeral.append(num or (not within and _LIKE_NUMBER.fullmatch(s) is not None))
                value.append(_number(s) if num else None)
                edge.append(None if num or within else _NO_LETTER.sub("", _WITH_NUMBER.sub("", s)).lower() or None)
            c.update(tokens)
            out = {"key": key, "left": left, "head": head, "edge": edge, "numeral": numeral, "value": value, "odd": odds}
            got = {f: b.column(k) for k, f in enumerate(cols)} | {k: pa.array(v, schema.field(k).type) for k, v in out.items()}
            yield pa.RecordBatch.from_arrays([got[f.name] if f.name in got else pa.nulls(b.num_rows, f.type) for f in schema], schema=schema)
            if len(c) > 500_000:
                yield counted(c)
        yield counted(c)

    return lines.select(*[F.col(c).cast("double" if c in cols[4:] else "bigint") for c in cols], "text").mapInArrow(batches, LINE_SCHEMA)


def read_choices(decisions: DataFrame, right: Container[str]) -> DataFrame:
    """``id, page_id, pair_index, key, left, odd`` of decisions."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader(right)
        for b in it:
            seen = [reader.line(t) for t in b.column(3).to_pylist()]
            more = [pa.array([_key(s) if s else None for s, _, _ in seen], pa.int64()), pa.array([_broken_part(s) if s else None for s, _, _ in seen], pa.string()), pa.array([o for _, _, o in seen], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], names=["id", "page_id", "pair_index", "key", "left", "odd"])

    return decisions.select("id", "page_id", "pair_index", F.col("selected_text").alias("text")).mapInArrow(batches, "id bigint, page_id bigint, pair_index bigint, key bigint, left string, odd string")


def _pieces(c: str) -> Column:
    """A text cut into one piece more than it may have edits: one piece at least is then unharmed."""
    n = F.length(c)
    k = F.greatest(F.lit(1), F.floor(n / 4)).cast("int") + 1
    at = lambda i: F.floor(i * n / k).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(F.col(c), at(i) + 1, at(i + 1) - at(i))))


def _substrings(c: str) -> Column:
    """All pieces of one to four characters, the lengths that ``_pieces`` gives."""
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(F.col(c), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    # Texts of up to five characters are cut into single ones and pairs.
    short = F.when(F.length(c) <= 6, F.concat(of(1), of(2))).otherwise(of(2))
    return F.array_distinct(F.concat(short, of(3), of(4)))


def furniture(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, id`` of the lines that are running heads, feet or page numbers.

    ``edges`` has ``id, project_id, page_id, pos, edge, numeral, value``; ``pos`` is the
    place across the direction of reading, 0 where the page begins. Page numbers are
    sequences: at their height the value less the page's place is the same on several
    pages of the book; numerals at that height that were misread go with them. Texts are
    compared once per book and zone, not once per line: candidates share an unharmed piece
    with a repeated text. Books too short to repeat anything take the heights at which the
    other books have nothing but furniture, by the lower end of the share's interval.
    """
    zone = F.when(F.col("pos") < EDGE_TOP, F.lit("top")).when(F.col("pos") > EDGE_FOOT, F.lit("foot"))
    step = F.round(F.col("pos") / SAME_HEIGHT).cast("int")
    e = edges.withColumn("zone", zone).where("zone is not null and (edge is not null or numeral)").select("id", "project_id", "page_id", "pos", "edge", "numeral", "value", "zone", step.alias("step")).distinct()
    e = cut_lineage(e)
    book = ["project_id", "zone"]
    several = lambda df, keys: df.groupBy(*keys).agg(F.min("page_id").alias("_p"), F.max("page_id").alias("_q"), F.count("*").alias("n"), F.avg("pos").alias("at")).where("_p <> _q")
    close = F.abs(F.col("pos") - F.col("at")) <= SAME_HEIGHT
    around = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))
    place = pages.where("page_index is not null").groupBy(F.col("id").alias("page_id")).agg(F.max("page_index").alias("page_index"))
    numbers = e.where("numeral")
    valued = numbers.where("value is not null").join(place, "page_id").withColumn("shift", F.col("value") - F.col("page_index"))
    heights = several(valued, [*book, "step", "shift"]).groupBy(*book, "step").agg(F.max_by("at", F.struct("n", "shift")).alias("at"))
    by_number = numbers.withColumn("step", around).join(heights, [*book, "step"]).where(close).select("page_id", "id")
    # Heads: texts found at one height on several pages.
    texts = e.where("edge is not null and length(edge) > 1")
    repeated = several(texts, [*book, "edge", "step"]).groupBy(*book, "edge").agg(F.max_by("at", "n").alias("at"))
    mine = texts.select(*book, "edge").distinct().withColumn("piece", F.explode(_substrings("edge")))
    reps = repeated.select(*book, F.col("edge").alias("rep"), "at").withColumn("piece", F.explode(_pieces("rep")))
    off = F.greatest(F.lit(1), F.floor(F.length("rep") / 4))
    near = mine.join(reps, [*book, "piece"]).where(F.abs(F.length("edge") - F.length("rep")) <= off).select(*book, "edge", "rep", "at").distinct()
    near = near.where(F.levenshtein("edge", "rep") <= off)
    by_text = texts.join(near, [*book, "edge"]).where(close).select("page_id", "id")
    known = cut_lineage(by_number.unionByName(by_text).distinct())
    flagged = e.join(known.withColumn("f", F.lit(1)), ["page_id", "id"], "left")
    share = flagged.groupBy("zone", "step").agg(F.sum(F.coalesce("f", F.lit(0))).alias("f"), F.count("*").alias("n"))
    p, n, z = F.col("f") / F.col("n"), F.col("n"), 1.96
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    sure = share.where(low >= ALWAYS).select("zone", "step")
    return known.unionByName(e.join(sure, ["zone", "step"], "left_semi").select("page_id", "id")).distinct()


def broken_words(ends: DataFrame, counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``kind, id`` of the rows of ``ends`` (``kind, id, left, head``) whose mark does not belong to the word."""
    e = ends.withColumn("joined", F.concat("left", "head")).withColumn("hyphened", F.concat_ws("-", "left", "head"))
    once = e.select("left", "head", "joined", "hyphened").distinct()
    words = counts.unionByName(lexicon.select(F.lower("word").alias("word"), F.lit(1).cast("bigint").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))
    compounds = counts.where(F.col("word").rlike(r"^\p{L}[\p{L}-]*-\p{L}+$") & (F.col("n") >= 2)).select("word", "n", F.regexp_extract("word", r"^(.*)-[^-]+$", 1).alias("first"), F.regexp_extract("word", r"-([^-]+)$", 1).alias("second"))
    once = once.join(words.select(F.col("word").alias("joined"), F.col("n").alias("n1")), "joined", "left")
    once = once.join(compounds.select(F.col("word").alias("hyphened"), F.col("n").alias("n2")), "hyphened", "left")
    once = once.withColumn("n1", F.coalesce("n1", F.lit(0))).withColumn("n2", F.coalesce("n2", F.lit(0)))
    # Neither form is known: a part may be misread, so compounds with the other part are looked at.
    open_ = once.where("n1 = 0 and n2 = 0")
    close = lambda a, b: F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.length(b) / 3))
    a = open_.join(compounds.select(F.col("second").alias("head"), "first"), "head").where(close("left", "first")).select("left", "head")
    b = open_.join(compounds.select(F.col("first").alias("left"), "second"), "left").where(close("head", "second") | F.col("head").isNull()).select("left", "head")
    alike = a.unionByName(b).distinct().select(F.col("left").alias("_a"), F.col("head").alias("_b"), F.lit(True).alias("alike"))
    firsts = compounds.select(F.col("first").alias("left")).distinct().withColumn("begins", F.lit(True))
    j = once.select("left", "head", "n1", "n2").join(alike, (F.col("left") == F.col("_a")) & F.col("head").eqNullSafe(F.col("_b")), "left").join(firsts, "left", "left")
    own = ((F.col("n2") > 0) & (F.col("n2") >= F.col("n1"))) | F.coalesce("alike", F.lit(False)) | (F.col("head").isNull() & F.coalesce("begins", F.lit(False)))
    verdict = j.select(F.col("left").alias("_l"), F.col("head").alias("_h"), own.alias("own"))
    return e.join(verdict, (F.col("left") == F.col("_l")) & F.col("head").eqNullSafe(F.col("_h"))).where(~F.col("own")).select("kind", "id")


def misread_words(doubted: DataFrame, counts: DataFrame) -> DataFrame:
    """``kind, id`` of the rows (``kind, id, a`` the word, ``b`` another reading of it or null) that hold a misread word.

    Another spelling is what a second reader saw there or what one usual confusion makes
    of the word; the word is misread if the corpus has the other spelling ``RATIO`` times
    as often, or if no other spelling was seen and the word stands nowhere else.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words, out = [], []
            for w in b.column(0).to_pylist():
                for v in _spellings(w):
                    words.append(w if w[0] != "^" else v[0])
                    out.append(v if w[0] != "^" else v[1])
            src = [w for w in b.column(0).to_pylist() for _ in _spellings(w)]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(words, pa.string()), pa.array(out, pa.string())], names=["a", "word", "variant"])

    once = doubted.select("a").distinct()
    usual = once.mapInArrow(batches, "a string, word string, variant string")
    seen = doubted.where(F.col("b").isNotNull() & (F.col("b") != ALONE)).select("a", "b").distinct()

    def rivals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(x, y, w, v) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w, v in _differences(x, y)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (cols[0], cols[2], cols[3])], names=["a", "word", "variant"])

    pairs = usual.unionByName(seen.mapInArrow(rivals, "a string, word string, variant string")).distinct()
    pairs = pairs.join(counts.select(F.col("word").alias("variant"), F.col("n").alias("n1")), "variant")
    pairs = pairs.join(counts, "word", "left").where(F.col("n1") >= RATIO * F.coalesce("n", F.lit(1)))
    alone = doubted.where(F.col("b") == ALONE).select("a").distinct().join(counts.where("n > 1").select(F.col("word").alias("a")), "a", "left_anti")
    wrong = doubted.join(pairs.select("a").distinct(), "a", "left_semi").select("kind", "id")
    return wrong.unionByName(doubted.where(F.col("b") == ALONE).join(alone.where(~F.col("a").startswith("^")), "a", "left_semi").select("kind", "id")).distinct()


def _spellings(word: str) -> list:
    """Variants of a word; of a run of CJK pairs of a triple and its variant."""
    if word[0] != "^" or len(word) < 3:
        return sorted(_variants(word))
    return [(t, v) for t in (word[i : i + 3] for i in range(len(word) - 2)) for v in sorted(_variants(t))]


def _differences(a: str, b: str) -> list[tuple[str, str]]:
    """The two spellings, or of CJK runs of one length the triples around each character that differs."""
    if a[0] != "^":
        return [(a, b)]
    if len(a) != len(b):
        return []
    return [(a[i - 1 : i + 2], b[i - 1 : i + 2]) for i in range(1, len(a) - 1) if a[i] != b[i]]


def _variants(word: str) -> set[str]:
    """What may have been printed where ``word`` was read: one confusion undone."""
    out = set()
    if _CJK.search(word):
        for p in _BY_READ.get(word[1], []) if len(word) == 3 else []:
            out.add(word[0] + p + word[2])
        return out
    for read, printed in _BY_READ.items():
        r, k = read.lower(), word.find(read.lower())
        while k >= 0:
            out.update(word[:k] + p.lower() + word[k + len(r) :] for p in printed)
            k = word.find(r, k + 1)
    return out - {word}


def page_noise(lines: DataFrame, runs: DataFrame, pages: DataFrame, alignments: DataFrame, decisions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``kind, id, noise`` of every line and decision with noise; see the module.

    Lines, pairs and decisions of a page are brought together once, without their texts,
    and read in blocks of whole pages. Only edge texts, broken words and doubted words
    leave them. The cached lines are recomputed if an executor is lost.
    """
    return _page_noise(lines, runs, pages, alignments, decisions, lexicon, word_list(lexicon, str.lower))[0]


def _page_noise(lines: DataFrame, runs: DataFrame, pages: DataFrame, alignments: DataFrame, decisions: DataFrame, lexicon: DataFrame, right: Container[str]) -> tuple[DataFrame, DataFrame]:
    read = read_lines(lines.where("id is not null"), right).persist()
    counts = cut_lineage(read.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    li = read.where("word is null")
    upright = li.groupBy("run_id").agg((F.sum("height") > F.sum("width")).alias("up"))
    of_run = runs.select(F.col("id").alias("run_id"), "page_id").distinct()
    page = F.coalesce("page_id", -1 - F.col("run_id"), -1 - F.col("id"))
    edges = li.where("edge is not null or numeral").join(of_run, "run_id", "left").join(upright, "run_id", "left")
    edges = edges.select("id", "project_id", page.alias("page_id"), F.when(F.col("up"), 1 - F.col("x")).otherwise(F.col("y")).alias("pos"), "edge", "numeral", "value")
    furn = cut_lineage(furniture(edges, pages))

    # Everything that is known of a page, in one exchange.
    fields = [c.split(" ") for c in block.IN_SCHEMA.split(", ")]
    shaped = lambda df, kind: df.select(*[F.lit(kind).alias("kind") if c == "kind" else (F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in fields])
    of_pages = alignments.where("page_id is not null").select("page_id", "pair_index", F.col("primary_run_id").alias("run_id"), F.col("secondary_run_id").alias("second_run"), F.col("primary_members").alias("members"), F.col("secondary_members").alias("second_members"))
    choices = read_choices(decisions.where("id is not null"), right).withColumn("page_id", F.coalesce("page_id", -1 - F.col("id")))
    rows = shaped(li.join(of_run, "run_id", "left").withColumn("page_id", page), block.LINE)
    rows = rows.unionByName(shaped(of_pages, block.PAIR)).unionByName(shaped(choices, block.DECISION)).unionByName(shaped(furn, block.FURNITURE))

    def compared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in block.blocks(it):
            yield from block.Block(t, SURE).rows()

    out = cut_lineage(rows.repartition("page_id").sortWithinPartitions("page_id").mapInArrow(compared, block.OUT_SCHEMA))
    read.unpersist()

    # The word over a page's end is the first of the next page.
    place = pages.where("project_id is not null").groupBy(F.col("id").alias("page_id")).agg(F.max("project_id").alias("project_id"), F.max("page_index").alias("page_index"))
    firsts = out.where(F.col("what") == block.FIRST).join(place, "page_id").groupBy("project_id", (F.col("page_index") - 1).alias("page_index")).agg(F.min("a").alias("over"))
    over = place.join(firsts, ["project_id", "page_index"]).select("page_id", "over")
    ends = out.where(F.col("what") == block.END)
    last = ends.where("last").join(over, "page_id", "left").withColumn("b", F.coalesce("over", "b")).drop("over")
    ends = cut_lineage(ends.where("not last").unionByName(last).select("kind", "id", F.col("a").alias("left"), F.col("b").alias("head")))
    hyphen = broken_words(ends, counts, lexicon)

    glyph = out.where(F.col("what") == block.GLYPH).select("kind", "id").unionByName(misread_words(out.where(F.col("what") == block.WORD), counts))
    all_f = furn.select(F.lit("ocr_line").alias("kind"), "id").unionByName(out.where(F.col("what") == block.FURNISHED).select("kind", "id")).distinct()
    marked = all_f.withColumn("noise", F.lit("furniture")).unionByName(hyphen.withColumn("noise", F.lit("hyphen"))).unionByName(glyph.withColumn("noise", F.lit("glyph")))
    # Furniture gets no other row.
    sets = marked.groupBy("kind", "id").agg(F.collect_set("noise").alias("n"))
    only = F.when(F.array_contains("n", "furniture"), F.array(F.lit("furniture"))).otherwise(F.col("n"))
    return sets.select("kind", "id", F.explode(only).alias("noise")), counts


#: A line begins a paragraph if it is indented by so much after a sentence's end or a line short by so much, or stands so many usual distances below.
INDENT, SHORT, FAR = 0.02, 0.05, 1.6
_DONE = regex.compile(r"[。！？；：…!?;:.][”’」』）】》〉〕］\"')\]]*\s*$")
_TIGHT = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\u3000-\u303f\uff01-\uff60]")
#: Marks that readers give for a hyphen and nobody prints.
_READ_AS_HYPHEN = "¬=~"

UNIT = "array<struct<pair_index: bigint, k: int, text: string, hyphen: boolean, glyph: boolean, start: double, end: double, at: double>>"
PARTS = "array<struct<text: string, suspect: boolean>>"


def _begins(units: list[dict]) -> list[bool]:
    """Which units (lines of print or their parts, in reading order) begin a paragraph."""
    placed = [u for u in units if u["at"] is not None and u["start"] is not None and u["end"] is not None]
    left, right = min((u["start"] for u in placed), default=0.0), max((u["end"] for u in placed), default=0.0)
    at = sorted({(u["at"], u["pair_index"]) for u in placed})
    steps = [b[0] - a[0] for a, b in zip(at, at[1:], strict=False) if b[0] > a[0]]
    gap = float(np.median(steps)) if steps else None
    out = []
    for k, u in enumerate(units):
        p = units[k - 1] if k else None
        if p is None:
            out.append(True)
        elif p["hyphen"] or p["pair_index"] == u["pair_index"]:
            out.append(False)
        elif None in (u["at"], u["start"], p["at"], p["end"]):
            out.append(False)
        else:
            far = gap is not None and u["at"] - p["at"] > FAR * gap
            out.append(far or (u["start"] - left > INDENT and (right - p["end"] > SHORT or _DONE.search(p["text"]) is not None)))
    return out


def join_page(units: list[dict], taken: bool, over: str | None) -> list[list[tuple[str, bool]]]:
    """Paragraphs of a page as stretches of text, each with whether it may hold misread words.

    A broken word loses its mark and takes the first word of the line printed next; over
    the page's end that is ``over``, which the next page gives up (``taken``).
    """
    begins = _begins(units)
    texts = [u["text"].strip() for u in units]
    if taken and texts:
        texts[0] = texts[0].partition(" ")[2].lstrip()
    out: list[list[tuple[str, bool]]] = []
    for k, u in enumerate(units):
        t, suspect = texts[k], bool(u["glyph"])
        if begins[k] or not out:
            out.append([])
        if not t:
            continue
        if u["hyphen"]:
            body = t.rstrip(HYPHENS)
            nxt = next((m for m in range(k + 1, len(units)) if texts[m]), None)
            if nxt is None:
                t = body + (over or "")
            elif units[nxt]["hyphen"] and " " not in texts[nxt]:  # the line holds a middle part of the word and nothing else
                texts[nxt], t = body + texts[nxt], ""
            else:
                head, _, texts[nxt] = texts[nxt].partition(" ")
                t, suspect = body + head, suspect or bool(units[nxt]["glyph"])
        elif t[-1] in _READ_AS_HYPHEN and _broken_part(t):
            t = t.rstrip(HYPHENS) + "-"
        t = t.strip()
        if not t:
            continue
        if out[-1]:
            last = out[-1][-1][0]
            tight = _TIGHT.match(last[-1]) or _TIGHT.match(t[0]) or (last[-1] in HYPHENS and _broken_part(last))
            t = t if tight else " " + t
        out[-1].append((t, suspect))
    return [p for p in out if p]


def _undone(text: str, right: dict[str, str]) -> str:
    """``text`` with each word that ``right`` knows as misread put right, its capitals kept."""
    out = []
    for x in regex.split(r"(\s+)", text):
        core = x.strip(_WORD_EDGE)
        s = _seen(core)
        if not core or core.isspace():
            out.append(x)
        elif not s.isascii() and _CJK.search(s):
            v = f"^{s.lower()}$"
            fixed = "".join(right.get(v[i : i + 3], v[i : i + 3])[1] if v[i : i + 3] in right else s[i] for i in range(len(s))) if len(v) == len(s) + 2 else s
            out.append(x.replace(core, fixed, 1) if fixed != s else x)
        elif s.lower() in right:
            w = right[s.lower()]
            w = w.upper() if len(core) > 1 and core.isupper() else w[:1].upper() + w[1:] if core[0].isupper() else w
            out.append(x.replace(core, w, 1))
        else:
            out.append(x)
    return "".join(out)


def _page_units(lines: DataFrame, runs: DataFrame, alignments: DataFrame, decisions: DataFrame, noise: DataFrame) -> DataFrame:
    """``page_id, units``: of every line of print that is no furniture the best text, in the order of print.

    A text without misread characters goes before one with them, the last decision before
    the readings, the surer reading before the other. Pages that were never aligned give
    the lines of their last whole reading.
    """
    has = lambda what: F.max((F.col("noise") == what).cast("int")).cast("boolean").alias(what)
    flags = noise.groupBy("kind", "id").agg(has("furniture"), has("hyphen"), has("glyph"))
    flag = lambda df, kind: df.join(flags.where(F.col("kind") == kind).drop("kind"), "id", "left").fillna(False, ["furniture", "hyphen", "glyph"])
    of_page = runs.select(F.col("id").alias("run_id"), "page_id", *([F.col("scope")] if "scope" in runs.columns else [F.lit(None).cast("string").alias("scope")])).distinct()
    li = flag(lines.where("id is not null and run_id is not null").dropDuplicates(["id"]), "ocr_line").join(of_page, "run_id").where("page_id is not null")
    side = lambda n, k: alignments.select("page_id", "pair_index", F.lit(k).alias("source"), F.col(f"{n}_run_id").alias("run_id"), F.posexplode(f"{n}_members").alias("part", "line_index"))
    members = side("primary", 1).unionByName(side("secondary", 2)).distinct()
    aligned = members.join(li, ["page_id", "run_id", "line_index"])
    alone = li.where("scope is null").join(alignments.select("page_id").distinct(), "page_id", "left_anti")
    last = alone.groupBy("page_id").agg(F.max("run_id").alias("run_id"))
    alone = alone.join(last, ["page_id", "run_id"]).withColumn("pair_index", F.col("line_index")).withColumn("source", F.lit(1)).withColumn("part", F.lit(0))
    r = aligned.unionByName(alone.select(aligned.columns)).where("length(trim(text)) > 0")
    on_page = W.partitionBy("page_id")
    r = r.withColumn("up", F.sum("height").over(on_page) > F.sum("width").over(on_page))
    pick = lambda a, b: F.when(F.col("up"), a).otherwise(b)
    r = r.withColumn("at", pick(1 - F.col("x"), F.col("y"))).withColumn("start", pick(F.col("y"), F.col("x"))).withColumn("end", F.col("start") + pick(F.col("height"), F.col("width")))
    part = F.struct("part", F.col("start").alias("along"), "id", "text", "hyphen", "glyph")
    keys = ["page_id", "pair_index"]
    read = r.groupBy(*keys, "source").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("furniture").alias("furniture"), F.max("glyph").alias("glyph"), F.min(F.coalesce("confidence", F.lit(-1.0))).alias("sure"),
        F.struct(F.min("start").alias("start"), F.max("end").alias("end"), F.min("at").alias("at")).alias("place"),
    )
    de = flag(decisions.where("id is not null and page_id is not null and pair_index is not null").dropDuplicates(["id"]), "decision")
    de = de.groupBy(*keys).agg(F.max_by(F.struct("id", "selected_text", "hyphen", "glyph"), F.struct("created_at", "id")).alias("d"), F.max("furniture").alias("furniture")).where("length(trim(d.selected_text)) > 0")
    chosen = F.array(F.struct(F.lit(0).alias("part"), F.lit(None).cast("double").alias("along"), F.col("d.id").alias("id"), F.col("d.selected_text").alias("text"), F.col("d.hyphen").alias("hyphen"), F.col("d.glyph").alias("glyph")))
    none = F.lit(None).cast("struct<start: double, end: double, at: double>")
    de = de.select(*keys, F.lit(0).alias("source"), chosen.alias("parts"), "furniture", F.col("d.glyph").alias("glyph"), F.lit(0.0).alias("sure"), none.alias("place"))
    best = read.unionByName(de).groupBy(*keys).agg(
        F.min_by("parts", F.struct("glyph", F.col("source") > 0, -F.col("sure"), "source")).alias("parts"), F.max("furniture").alias("furniture"),
        F.min_by("place", F.when(F.col("place").isNotNull(), F.col("source"))).alias("place"),
    ).where("not furniture")
    unit = F.transform("parts", lambda p, k: F.struct(F.col("pair_index"), k.alias("k"), p["text"].alias("text"), p["hyphen"].alias("hyphen"), p["glyph"].alias("glyph"), F.col("place.start").alias("start"), F.col("place.end").alias("end"), F.col("place.at").alias("at")))
    return best.groupBy("page_id").agg(F.sort_array(F.flatten(F.collect_list(unit))).cast(UNIT).alias("units"))


def page_paragraphs(lines: DataFrame, runs: DataFrame, pages: DataFrame, alignments: DataFrame, decisions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``page_id, paragraph, text``: the text of each page in paragraphs of whole words, without furniture.

    ``lines``, ``runs`` and so on are as for ``page_noise``, decisions with ``created_at``. Words of
    misread lines that one usual confusion turns into a far more frequent word are put right.
    """
    right = word_list(lexicon, str.lower)
    noise, counts = _page_noise(lines, runs, pages, alignments, decisions, lexicon, right)
    noise = cut_lineage(noise)
    units = cut_lineage(_page_units(lines, runs, alignments, decisions, noise))

    # Words over a page's end: the next page gives up its first word unless that is again a part of one.
    place = pages.where("project_id is not null").groupBy(F.col("id").alias("page_id")).agg(F.max("project_id").alias("project_id"), F.max("page_index").alias("page_index"))
    first, end = F.element_at("units", 1), F.element_at("units", -1)
    edges = units.join(place, "page_id").select("page_id", "project_id", "page_index", F.trim(first["text"]).alias("text"), first["hyphen"].alias("broken"), end["hyphen"].alias("open"))
    gives = edges.where("not (broken and instr(text, ' ') = 0)").groupBy("project_id", (F.col("page_index") - 1).alias("page_index")).agg(F.min(F.struct("page_id", F.split("text", " ")[0].alias("over"))).alias("n"))
    takes = edges.where("open").groupBy("project_id", "page_index").agg(F.min("page_id").alias("page_id")).join(gives, ["project_id", "page_index"]).select("page_id", F.col("n.over").alias("over"), F.col("n.page_id").alias("giver"))
    all_ = units.join(takes.select("page_id", "over"), "page_id", "left").join(takes.select(F.col("giver").alias("page_id"), F.lit(True).alias("taken")).distinct(), "page_id", "left")

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("text", pa.string()), ("suspect", pa.bool_())])), pa.list_(pa.struct([("word", pa.string()), ("variant", pa.string())]))]
        for b in it:
            ids, nos, segs, open_ = [], [], [], []
            if len(memo) > 100_000:
                memo.clear()
            for page, us, over, taken in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for no, p in enumerate(join_page(us, bool(taken), over), 1):
                    words = {w for t, suspect in p if suspect for w in _words(_seen(t.strip()) + " .")}
                    for w in words - memo.keys():
                        memo[w] = [] if w in right else sorted(_variants(w))
                    ids.append(page), nos.append(no)
                    segs.append([{"text": t, "suspect": s} for t, s in p])
                    open_.append([{"word": w, "variant": v} for w in sorted(words) for v in memo[w]])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, nos, segs, open_), types, strict=True)], names=["page_id", "paragraph", "parts", "open"])

    paras = cut_lineage(all_.select("page_id", "units", "over", "taken").mapInArrow(joined, f"page_id bigint, paragraph bigint, parts {PARTS}, open array<struct<word: string, variant: string>>"))
    open_ = paras.select("page_id", "paragraph", F.explode("open").alias("o")).select("page_id", "paragraph", "o.*")
    pairs = open_.select("word", "variant").distinct().join(counts.select(F.col("word").alias("variant"), F.col("n").alias("n1")), "variant")
    pairs = pairs.join(counts, "word", "left").where(F.col("n1") >= RATIO * F.coalesce("n", F.lit(1)))
    best = pairs.groupBy("word").agg(F.max_by("variant", F.struct("n1", "variant")).alias("right"))
    fixes = open_.select("page_id", "paragraph", "word").distinct().join(best, "word").groupBy("page_id", "paragraph").agg(F.collect_list(F.struct("word", "right")).alias("fixes"))

    def put_right(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for parts, fix in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                known = {f["word"]: f["right"] for f in fix or ()}
                out.append("".join(_undone(p["text"], known) if known and p["suspect"] else p["text"] for p in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "paragraph", "text"])

    return paras.drop("open").join(fixes, ["page_id", "paragraph"], "left").mapInArrow(put_right, "page_id bigint, paragraph bigint, text string")


def noise_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return page_noise(t("ocr_lines"), t("engine_runs"), t("book_pages"), t("alignments"), t("decisions"), t("lexicon"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_of(spark, sf_dir).select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "noise")


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return page_paragraphs(t("ocr_lines"), t("engine_runs"), t("book_pages"), t("alignments"), t("decisions"), t("lexicon"))
