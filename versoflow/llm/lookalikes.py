"""One form for texts that look the same and differ in their characters.

A text is read as runs of letters with the invisible characters among them. A raw run is
traversed through the vocabulary's trie by a weighted edit automaton in which a character
takes any edge it looks like at no cost and an invisible character stays at no cost; every
other edit costs and is beyond the budget. The longest vocabulary word on the way gives
the spelling; characters that no word covers are normalised by table, kana and Chinese
characters of one look by their neighbours. Which words match depends only on the look of
the run, so texts of one look get one form, and texts of two looks never do.

Same look: compatibility width forms, ligatures and compatibility ideographs, composed and
decomposed accents, look-alike letters of other scripts, spaces of any kind. Kept apart:
two ASCII characters, a letter with and without accent, raised and plain figures, dashes
of different length. Null gives null, empty gives empty.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from versoflow.llm.word_list import WordList, word_list
from versoflow.session import table

# Letters of other scripts and the letter they look like.
LETTERS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ι": "i", "ϲ": "c", "ϳ": "j", "υ": "u",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ք": "p", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U",
    "ɡ": "g", "ɑ": "a", "ı": "i", "ȷ": "j", "ⅼ": "l", "ꓲ": "I", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮇ": "M", "Ꮲ": "P", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z",
}
# Kana and the Chinese character of the same look; the vocabulary decides between them.
KANA = {"一": "ー", "力": "カ", "二": "ニ", "八": "ハ", "口": "ロ", "夕": "タ", "工": "エ", "卜": "ト", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "り": "リ", "千": "チ", "三": "ミ", "〇": "○"}
# Further marks of one look.
MARKS = {"‐": "-", "‑": "-", "−": "-", "’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"', "‚": ",", "․": ".", "∶": ":", "꞉": ":", "׃": ":", "ǃ": "!", "⁄": "/", "∕": "/", "ᐟ": "'"}
#: Compatibility forms that do not look like what they stand for.
RAISED = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>")
IGNORABLE = frozenset([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)])


def _fold_char(c: str) -> str:
    """What a single character looks like, as decomposed characters of the table's forms."""
    if ord(c) in IGNORABLE:
        return ""
    if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c == "\t":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith(RAISED):
        return c
    if d:
        parts = d.split()
        parts = parts[1:] if parts[0].startswith("<") else parts
        base = "".join(_fold_char(chr(int(x, 16))) for x in parts)
        if d.startswith("<") and (base.strip() != base or not base):
            return c if not base.strip() else base.strip()
        return base
    if c in LETTERS:
        return unicodedata.normalize("NFD", LETTERS[c])
    return KANA.get(c, MARKS.get(c, c))


class _Table(dict):
    def __missing__(self, o: int):
        got = _fold_char(chr(o))
        self[o] = got
        return got


_TABLE = _Table()


def look(text: str) -> str:
    """Normalisation by table alone: equal exactly for texts of one look."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_TABLE)).translate(_TABLE))


#: Letters, marks and the invisible characters among them.
_RUN = regex.compile(r"[\p{L}\p{M}\p{N}ー○\p{Cf}\p{Default_Ignorable_Code_Point}]+")
#: What each kana of ``KANA`` may be instead.
_TWINS: dict[str, str] = {v: k for k, v in KANA.items()}
_KATAKANA = frozenset(chr(c) for c in range(0x30A1, 0x30FB)) - frozenset(_TWINS)


def _joins(folded: str) -> bool:
    """Whether a character belongs to the one before: an accent, a voicing mark, a part of a Hangul syllable."""
    return unicodedata.combining(folded[0]) > 0 or 0x1160 <= ord(folded[0]) <= 0x11FF


def unmatched(seen: str) -> str:
    """The table's form of looked-at text: kana only beside katakana, else the Chinese or hiragana character of that look."""
    if not any(c in _TWINS for c in seen):
        return seen
    out = list(seen)
    n = len(seen)
    for i, c in enumerate(seen):
        if c in _TWINS:
            # The nearest characters that can be but one.
            a, b = i - 1, i + 1
            while a >= 0 and seen[a] in _TWINS:
                a -= 1
            while b < n and seen[b] in _TWINS:
                b += 1
            if not ((a >= 0 and seen[a] in _KATAKANA) or (b < n and seen[b] in _KATAKANA)):
                out[i] = _TWINS[c]
    return "".join(out)


def _composed(word: str) -> str:
    return unicodedata.normalize("NFC", word)


class _Node(dict):
    """A node of the trie: the words of a sorted list from ``lo`` to ``hi``, which begin alike. An edge is looked up in the list when it is first asked for, and null if no word goes on so."""

    __slots__ = ("trie", "begin", "lo", "hi")

    def __init__(self, trie: LookTrie, begin: str, lo: int, hi: int):
        self.trie, self.begin, self.lo, self.hi = trie, begin, lo, hi
        if lo < hi and trie.words[lo] == begin:
            self[""] = begin

    def __missing__(self, c: str) -> _Node | None:
        words, begin = self.trie.words, self.begin + c
        lo = bisect_left(words, begin, self.lo, self.hi)
        hi = bisect_right(words, begin, lo, self.hi, key=lambda w: w[: len(begin)])
        self.trie.size += 1
        to = self[c] = _Node(self.trie, begin, lo, hi) if lo < hi else None
        return to

    def edges(self) -> Iterator[tuple[str, _Node]]:
        """All edges with where they lead."""
        at = self.lo + ("" in self)
        while at < self.hi:
            c = self.trie.words[at][len(self.begin)]
            yield c, self[c]
            at = self[c].hi


class LookTrie:
    """Vocabulary words in a trie, with the weighted edit automaton that reads raw texts through it.

    The trie is read from a sorted list of composed words; the nodes that texts come by
    are remembered. A character takes at no cost the edges it looks like, those of its
    lower case and of its kana or Chinese twin; an invisible character stays where it is
    at no cost. Taking any other edge costs 1; with ``budget`` 0, which the queries use,
    nothing may cost.
    """

    #: Runs and edges remembered in a worker; more are read anew.
    MEMO = 200_000

    def __init__(self, words: Iterable[str], budget: int = 0):
        self.words = words if isinstance(words, WordList) else sorted({_composed(w) for w in words})
        self.budget = budget
        self._forget()
        self.edges: dict[str, tuple[str, tuple[str, ...]]] = {}
        self.memo: dict[str, str] = {}

    def _forget(self) -> None:
        self.size = 0
        self.root = _Node(self, "", 0, len(self.words))

    def _characters(self, run: str) -> list[str]:
        """The raw run cut into characters with their accents; invisible ones belong to the character before."""
        out: list[str] = []
        for c in run:
            f = _TABLE[ord(c)]
            if out and (not f or _joins(f)):
                out[-1] += c
            else:
                out.append(c)
        return out

    def _accepts(self, c: str) -> tuple[str, tuple[str, ...]]:
        """What a raw character is by the table and the edges it takes for nothing: its look, that in lower case, its twins."""
        got = self.edges.get(c)
        if got is None:
            seen = look(c)
            twins = [seen, *([_TWINS[seen]] if seen in _TWINS else [])]
            got = seen, tuple(dict.fromkeys(x for t in twins for x in (t, t.lower())))
            if len(self.edges) < self.MEMO:
                self.edges[c] = got
        return got

    def _walk(self, node: _Node, letters: str) -> _Node | None:
        for x in letters:
            node = node[x]
            if node is None:
                return None
        return node

    def spell(self, run: str) -> str:
        """The canonical spelling of a run of letters: the longest word from each place on, the table's form elsewhere."""
        got = self.memo.get(run)
        if got is not None:
            return got
        if self.size > self.MEMO:
            self._forget()
        tape = [self._accepts(c) for c in self._characters(run)]
        out, rest, at, n = [], [], 0, len(tape)
        while at < n:
            # The trie nodes that the characters so far may have led to, with spelling and cost.
            states, best, end, k = [(self.root, "", 0)], "", at, at
            while states and k < n:
                seen, edges = tape[k]
                k += 1
                if not seen:  # invisible
                    continue
                after = []
                for node, path, cost in states:
                    for x in edges:
                        to = self._walk(node, x)
                        if to is not None:
                            after.append((to, path + (seen if x == seen.lower() else x), cost))  # the text's case stays
                    if cost < self.budget:
                        after += [(to, path + x, cost + 1) for x, to in node.edges() if x not in edges]
                states = after
                done = [(cost, path) for node, path, cost in states if "" in node]
                if done:
                    best, end = min(done)[1], k
            if len(best) > 1:
                out.append(unmatched("".join(rest)))
                out.append(best)
                rest.clear()
                at = end
            else:
                rest.append(tape[at][0])
                at += 1
        got = "".join([*out, unmatched("".join(rest))])
        if len(self.memo) < self.MEMO and len(run) < 64:
            self.memo[run] = got
        return got

    def canonical(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        parts, end = [], 0
        for m in _RUN.finditer(text):
            if m.start() > end:
                parts.append(look(text[end : m.start()]))
            run = m[0]
            parts.append(run if run.isascii() else self.spell(run))
            end = m.end()
        if end < len(text):
            parts.append(look(text[end:]))
        return "".join(parts)


_TRIES: dict[WordList | tuple[str, ...], LookTrie] = {}


def vocabulary(lexicon: DataFrame) -> WordList:
    """The words of a list of any length as the trie reads them."""
    return word_list(lexicon, _composed)


def with_canonical(df: DataFrame, text: str, words: WordList | tuple[str, ...], to: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of a column; ASCII texts are their own and never leave the JVM's value."""

    @F.pandas_udf("string")
    def canon(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if words not in _TRIES:
            _TRIES[words] = LookTrie(words)
        f = _TRIES[words].canonical
        for s in it:
            yield s.map(f, na_action="ignore")

    odd = canon(F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.col(text)))
    return df.withColumn(to, F.coalesce(odd, F.col(text)))


def line_records(lines: DataFrame, alignments: DataFrame, reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """``page_id, pair_index, kind, id, text`` of every record of a printed line, once each."""
    side = lambda s: alignments.select("page_id", "pair_index", F.col(f"{s}_run_id").alias("run_id"), F.explode(f"{s}_members").alias("line_index"))
    members = side("primary").unionByName(side("secondary"))
    out = members.join(lines.select("run_id", "line_index", "id", "text"), ["run_id", "line_index"]).select("page_id", "pair_index", F.lit("ocr_line").alias("kind"), "id", "text")
    out = out.unionByName(reviews.select("page_id", "pair_index", F.lit("vlm_review").alias("kind"), "id", "text"))
    return out.unionByName(decisions.select("page_id", "pair_index", F.lit("decision").alias("kind"), "id", F.col("selected_text").alias("text"))).where("id is not null and text is not null")


def same_look_pairs(records: DataFrame, words: WordList | tuple[str, ...]) -> DataFrame:
    """Pairs of records of one (page_id, pair_index) with one look and different characters, smaller (kind, id) first.

    Groups of one look in which all texts are the same are dropped before the join; what
    is joined then is output.
    """
    group = ["page_id", "pair_index", "_look"]
    r = with_canonical(records, "text", words)
    # Texts are compared by two hashes, so that no text is shuffled; one exchange serves all that follows.
    chars = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    r = r.select("page_id", "pair_index", F.xxhash64("canonical").alias("_look"), "kind", "id", chars.alias("_chars")).repartition(*group).distinct()
    by = W.partitionBy(*group)
    r = r.withColumn("_a", F.min("_chars").over(by)).withColumn("_b", F.max("_chars").over(by)).where("_a <> _b").select(*group, "kind", "id", "_chars")
    left = r.select(*group, F.col("kind").alias("left_kind"), F.col("id").alias("left_id"), F.col("_chars").alias("_l"))
    right = r.select(*group, F.col("kind").alias("right_kind"), F.col("id").alias("right_id"), F.col("_chars").alias("_r"))
    first: Column = (F.col("left_kind") < F.col("right_kind")) | ((F.col("left_kind") == F.col("right_kind")) & (F.col("left_id") < F.col("right_id")))
    return left.join(right, group).where(first & (F.col("_l") != F.col("_r"))).select("left_kind", "left_id", "right_kind", "right_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return same_look_pairs(line_records(t("ocr_lines"), t("alignments"), t("vlm_reviews"), t("decisions")), vocabulary(t("lexicon")))


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every OCR line."""
    lines = table(spark, sf_dir, "ocr_lines").where("id is not null").select("id", "text").distinct()
    return with_canonical(lines, "text", vocabulary(table(spark, sf_dir, "lexicon"))).select("id", "canonical")
