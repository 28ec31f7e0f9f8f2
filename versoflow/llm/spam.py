"""Keyword-stuffed pages, link lists and tag lists.

Each page becomes a sequence of words, with a link, a tag or a number as one word each
and, where no spaces part them, two Chinese characters or kana counting as a word.
Phrases (stretches between marks of punctuation and line ends) give a shingle of five
words from every word on, phrases of two to four words one of the whole, and the distinct
hosts of every shingle that may count are counted over the whole corpus. Words of
sentences (five words and more, many of them function words) give none. A page is flagged
when most of its characters are stitched together from

* list items: links with their labels, tags, and two-word phrases that the page repeats
  so often that they make up a good part of it, with the few words between them, and
* phrases found on at least ``MIN_HOSTS`` hosts that are no sentence parts: at most one of
  the five words is a function word, none of a shorter phrase; three phrases at least, as
  a page of one sentence that others have too is a copy and not stitched.

Sentences are full of function words and repeat little, registers and indexes have one
word between their numbers, tables of contents are known by their rising page numbers.

Null, empty and blank texts are no spam. Repeated rows of a ``doc_id`` count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.llm.lookalikes import look
from versoflow.session import cut_lineage, table

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words in a shingle.
SHINGLE = 5
#: Hosts on which a phrase must be found to count as replicated.
MIN_HOSTS = 3
#: A phrase of two words, or of three with a function word between, is a list item if it occurs so often and covers this share of the page.
REPEATS, COVER = 3, 0.03
#: The same for a list item of one word.
WORD_REPEATS, WORD_COVER = 5, 0.08
#: A stretch between full stops with so many words and this share of function words is a sentence, and no list item.
SENTENCE_WORDS, SENTENCE_SHARE = 5, 0.25
#: Words between two list items that belong to the list.
GAP = 4
#: Share of the page's characters from which on it is spam: the most part.
SPAM_SHARE = 0.5
#: Replicated phrases that a stitched page has at least; a page of one sentence that others have too is a copy.
PHRASES = 3
#: A page whose items mostly end in rising numbers is a table of contents.
CONTENTS_ITEMS, CONTENTS_RISING = 4, 0.9

INVISIBLE = re.compile("[\u00ad\u034f\u180e\ufeff\u200b-\u200f\u202a-\u202e\u2060-\u2064]+")
#: Blocks from which letters are borrowed to disguise words.
DISGUISE = regex.compile(r"[\u0370-\u058f\u13a0-\u13ff\uff01-\uff5e\u0261]")
LINK = regex.compile(r"""<a\s[^>]*>|\]\([^)\s]*\)|(?:http\p{L}*://|www\.)[^\s<>"|)\]]+|[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+/[^\s<>"|)\]]*""", regex.IGNORECASE)
TAG = regex.compile(r"#[\p{L}\p{N}_]+")
WORD = regex.compile(r"[\x01\x02]\d*\x03|(?<!\p{Han})\p{Han}{1,6}(?!\p{Han})|\p{Han}{1,2}|\p{Hiragana}{1,2}|[\p{Katakana}ー]+|[\p{L}\p{M}'’-]+(?:[0-9]+[\p{Latin}0-9]*)?|\p{N}+|[.,;:!?。、，；：！？…|/»\n\r\x85  ]")
ITEM = regex.compile(r"[^;；|\n\r\x85\u2028\u2029]+")
PAGE_AT_END = regex.compile(r"(?<!\d)([0-9]{1,6})[^\S\n\r]*(?=$|[;；|\n\r\x85\u2028\u2029])")
BREAKS = frozenset(".,;:!?。、，；：！？…|/»\n\r\x85  ")

STOPS = frozenset(".!?;。！？；\n\r\x85\u2028\u2029")

# Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset(
    """the of and was were is are not in a an to that which how had has been most there by with at for from but when who his her their our its it he she they or as on this
    il elle le la les l un une et des de du dans sur sous avec contre devant après avant derrière sans mais était est ne que qui pourquoi puis en au aux par pour se sa son ses
    der die das den dem des ein eine einen einem einer und war ist nicht im in aus nach vor zwischen neben unter über hinter dass auch während bei wusste zu von mit auf für als
    は を の た に が で と も て だ る い し れ 了 的 在 是 着""".split()
)


class _Words(dict):
    """Number of each word met; ``code``, ``kind`` and ``size`` hold what is known of it.

    Kinds: 0 word, 1 function word, 2 link or tag, 3 break, 4 number, 5 Chinese or katakana phrase.
    """

    def __init__(self) -> None:
        super().__init__()
        self.code, self.kind, self.size = np.zeros(1024, np.uint64), np.zeros(1024, np.int8), np.zeros(1024, np.int64)

    def __missing__(self, w: str) -> int:
        n = len(self)
        if n == len(self.code):
            self.code, self.kind, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.code, self.kind, self.size))
        self.code[n], self.kind[n] = self._read(w)
        self.size[n] = int(w[1:-1]) if w[0] in "\x01\x02" else len(w)
        self[w] = n
        return n

    @staticmethod
    def _read(w: str) -> tuple[int, int]:
        if w[0] in "\x01\x02":
            return (1 if w[0] == "\x01" else 2), 2
        if w in BREAKS:
            return (3 if w in STOPS else 0), 3
        x = w.lower().replace("’", "'")
        if x.isnumeric():
            return 4, 4
        function = x in FUNCTION_WORDS or (len(x) == 2 and not x.isascii() and (x[0] in FUNCTION_WORDS or x[1] in FUNCTION_WORDS) and ord(x[0]) > 0x2FFF)
        return xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) | 4, 1 if function else 5 if len(x) > 2 and x[0] > "\u3000" else 0


class PageReader:
    """Words of a page as numbers; keeps what it learned of each word for a worker's life."""

    #: Words remembered; beyond it the reader begins anew.
    MEMO = 1_000_000

    def __init__(self) -> None:
        self.known = _Words()

    def read(self, text: str | None):
        """``(n, listed, hashes, begins, ends, phrases)``: characters in words, characters in list items, and each shingle that is no part of a sentence with its place among the characters that phrases could add and its phrase, -1 for a word alone."""
        none = (0, 0, np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(3)))
        if not text or text.isspace():
            return none
        t = text if text.isascii() else INVISIBLE.sub("", text)
        if not t.isascii() and DISGUISE.search(t):
            t = look(t)
        if "/" in t or "<a" in t or "www." in t:
            t = LINK.sub(lambda m: f" \x01{len(m[0])}\x03 ", t)
        if "#" in t:
            t = TAG.sub(lambda m: f" \x02{len(m[0])}\x03 ", t)
        words = WORD.findall(t)
        if not words:
            return none
        if len(self.known) > self.MEMO:
            self.known = _Words()
        known = self.known
        at = np.array(list(map(known.__getitem__, words)))
        code, kind, size = known.code[at], known.kind[at], known.size[at]
        run = kind == 5
        kind[run] = 0
        phrase = np.cumsum(kind == 3)
        sentence = np.cumsum((kind == 3) & (code == 3))
        keep = kind != 3
        code, kind, size, phrase, sentence, run = code[keep], kind[keep], size[keep], phrase[keep], sentence[keep], run[keep]
        m = len(code)
        if not m:
            return none
        # Numbers are neither list nor text: prices, counts and page numbers stand in both.
        words_at = np.flatnonzero(kind != 4)
        c, f, m1 = code[words_at], kind[words_at] == 1, len(words_at)
        hit = kind[words_at] == 2
        if m1 > 1:
            two = c[:-1] * MIX + c[1:]
            heavy = self._often(two, 2, m1) & ~f[:-1] & ~f[1:]
            hit[:-1] |= heavy
            hit[1:] |= heavy
        if m1 > 2:
            three = (c[:-2] * MIX + c[1:-1]) * MIX + c[2:]
            heavy = self._often(three, 3, m1) & ~f[:-2] & f[1:-1] & ~f[2:]
            for k in range(3):
                hit[k : m1 - 2 + k] |= heavy
        _, back, count = np.unique(c, return_inverse=True, return_counts=True)
        hit |= (count[back] >= WORD_REPEATS) & (count[back] >= WORD_COVER * m1) & ~f
        # A run of three and more Chinese characters or katakana is a phrase by itself.
        hit |= (count[back] >= REPEATS) & (2 * count[back] >= COVER * m1) & run[words_at]
        length = np.bincount(sentence)
        real = (length >= SENTENCE_WORDS) & (np.bincount(sentence, kind == 1) >= SENTENCE_SHARE * length)
        hit = self._filled((hit & ~real[sentence[words_at]]) | (kind[words_at] == 2), f)
        listed = np.zeros(m, bool)
        listed[words_at] = hit
        total, inside = int(size[words_at].sum()), 0 if self._contents(t) else int(size[listed].sum())
        # Shingles: five words from every word of a phrase on, shorter phrases whole.
        first = np.r_[True, phrase[1:] != phrase[:-1]]
        adds = np.r_[0, np.cumsum(np.where(listed | (kind == 4), 0, size))]
        starts = np.flatnonzero(phrase[: 1 - SHINGLE] == phrase[SHINGLE - 1 :]) if m >= SHINGLE else np.zeros(0, np.int64)
        starts = starts[~real[sentence[starts]]]
        h, functions = self._hashed(code, kind, starts, np.full(len(starts), SHINGLE))
        keep = functions <= 1
        head = np.flatnonzero(first)
        short = np.diff(np.r_[head, m])
        head, short = head[short < SHINGLE], short[short < SHINGLE]
        head, short = head[~real[sentence[head]]], short[~real[sentence[head]]]
        g, functions = self._hashed(code, kind, head, short)
        whole = functions == 0
        # A word alone among marks and numbers is an entry of an index and not a phrase.
        numbers = np.r_[0, np.cumsum(kind == 4)]
        several = np.r_[np.ones(int(keep.sum()), bool), (short - numbers[head + short] + numbers[head] >= 2)[whole]]
        begin = np.r_[starts[keep], head[whole]]
        end = np.r_[starts[keep] + SHINGLE, head[whole] + short[whole]]
        return total, inside, np.r_[h[keep], g[whole]], adds[begin].astype(np.int32), adds[end].astype(np.int32), np.where(several, phrase[begin], -1).astype(np.int32)

    @staticmethod
    def _hashed(code: np.ndarray, kind: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and function words of the stretches of up to five words."""
        h, functions = lengths.astype(np.uint64), np.zeros(len(starts), np.int32)
        for k in range(SHINGLE):
            on = lengths > k
            at = np.where(on, starts + k, starts)
            x = (h ^ code[at]) * MIX
            h = np.where(on, x ^ (x >> np.uint64(29)), h)
            functions += on & (kind[at] == 1)
        return h, functions

    @staticmethod
    def _contents(text: str) -> bool:
        """Items that end in numbers which rise from item to item."""
        pages = [int(x) for x in PAGE_AT_END.findall(text)]
        if len(pages) < CONTENTS_ITEMS:
            return False
        items = sum(1 for x in ITEM.findall(text) if not x.isspace())
        rising = sum(a <= b for a, b in zip(pages, pages[1:], strict=False))
        return len(pages) >= 0.7 * items and rising >= CONTENTS_RISING * (len(pages) - 1)

    @staticmethod
    def _often(grams: np.ndarray, n: int, words: int) -> np.ndarray:
        """Places of n-grams that the page repeats and that cover a good part of it."""
        _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
        return (count[back] >= REPEATS) & (n * count[back] >= COVER * words)

    @staticmethod
    def _filled(listed: np.ndarray, function: np.ndarray) -> np.ndarray:
        """Short stretches between list items belong to the list unless function words are in them."""
        idx = np.flatnonzero(listed)
        if len(idx) < 2:
            return listed
        gaps = np.diff(idx)
        plain = np.r_[0, np.cumsum(function)]
        near = (gaps > 1) & (gaps <= GAP + 1) & (plain[idx[1:]] == plain[idx[:-1] + 1])
        change = np.zeros(len(listed) + 1, np.int64)
        np.add.at(change, idx[:-1][near], 1)
        np.add.at(change, idx[1:][near], -1)
        return listed | (np.cumsum(change[:-1]) > 0)


_READER: list[PageReader] = []


def read_pages(docs: DataFrame) -> DataFrame:
    """``doc_id, host, n, listed, tiles`` with tiles as ``array<struct<h, a, b, p>>``; one row per row of ``docs``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _READER:
            _READER.append(PageReader())
        read = _READER[0].read
        for b in it:
            n, listed, hs, froms, tos, phrases, ends = [], [], [], [], [], [], [0]
            for text in b.column(2).to_pylist():
                a, c, h, begin, end, of = read(text)
                n.append(a)
                listed.append(c)
                hs.append(h)
                froms.append(begin)
                tos.append(end)
                phrases.append(of)
                ends.append(ends[-1] + len(h))
            h = np.concatenate(hs).view(np.int64) if hs else np.zeros(0, np.int64)
            begin, end, of = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (froms, tos, phrases))
            tiles = pa.StructArray.from_arrays([pa.array(h), pa.array(begin), pa.array(end), pa.array(of)], ["h", "a", "b", "p"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(listed, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tiles)],
                names=["doc_id", "host", "n", "listed", "tiles"],
            )

    schema = "doc_id bigint, host string, n bigint, listed bigint, tiles array<struct<h: bigint, a: int, b: int, p: int>>"
    return docs.select("doc_id", F.col("source").alias("host"), "text").mapInArrow(batches, schema)


def spam_evidence(docs: DataFrame, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """``doc_id, n, listed, replicated, stitched, phrases``, of every document with a non-null id.

    In characters; ``replicated`` is what shingles found on several hosts cover beyond the
    list items, ``stitched`` the part of it in phrases of two words and more, ``phrases``
    the number of these.

    Hosts are counted with map-side combining on (shingle, host), so a shingle on a third
    of all pages reaches the reducers once a host and map task. Only shingles that can
    still add evidence are joined back, and AQE splits the hot ones.
    """
    pages = cut_lineage(read_pages(docs.where("doc_id is not null")))
    seen = pages.select(F.xxhash64(F.coalesce("host", F.lit(""))).alias("host"), F.explode("tiles.h").alias("h"))
    hosts = seen.groupBy("h", "host").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("hosts"))
    often = hosts.where(F.col("hosts") >= min_hosts).select("h")
    open_ = pages.where("n > 0 and listed < n").select("doc_id", F.explode(F.filter("tiles", lambda x: x["b"] > x["a"])).alias("t")).select("doc_id", "t.*")
    # The union of overlapping shingles, also of repeated rows: what each adds beyond the end of those before.
    spans = open_.join(often, "h").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("a", "b", "p"))).alias("s"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("sum"))
    union = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")), step, lambda acc: acc["sum"]).cast("double")
    several = F.filter("s", lambda x: x["p"] >= 0)
    added = spans.select("doc_id", union(F.col("s")).alias("replicated"), union(several).alias("stitched"), F.size(F.array_distinct(F.transform(several, lambda x: x["p"]))).alias("phrases"))
    one = pages.groupBy("doc_id").agg(F.max("n").alias("n"), F.max("listed").alias("listed"))
    both = one.join(added, "doc_id", "left")
    return both.select("doc_id", "n", "listed", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("replicated", "stitched")], F.coalesce("phrases", F.lit(0)).alias("phrases"))


def spam_pages(docs: DataFrame) -> DataFrame:
    """The flagged documents with their evidence."""
    stitched = F.when(F.col("phrases") >= PHRASES, F.col("stitched")).otherwise(F.lit(0.0))
    e = spam_evidence(docs).withColumn("share", (F.col("listed") + stitched) / F.greatest(F.col("n"), F.lit(1)))
    return e.where((F.col("n") > 0) & (F.col("share") >= SPAM_SHARE))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_evidence(table(spark, sf_dir, "documents")).where("n > 0")
