"""Encoding of a corpus by a public byte-level BPE vocabulary.

The encoder does not run merges. A vocabulary token is found by an Aho-Corasick automaton
over the bytes (mapped to Latin-1, one character a byte). Encoding walks a piece from left
to right taking the longest token at each position; a token may follow another only if
the merges would keep the two apart, which is decided once per pair of adjacent tokens and
remembered. If the longest token may not follow or leads nowhere, the walk takes the next
shorter one or steps back. A sequence of tokens whose neighbours are all compatible is the
one that the merges give, so the tokens before a position are always the same ones:
positions proven hopeless are marked and tried no more, and the walk is linear.

Empty text and null text both have no ids (an empty list).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versoflow.session import table

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers split text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces remembered per worker; a piece that finds no room is encoded again when met.
MEMO_PIECES = 400_000
#: Longest piece worth remembering, in characters.
MEMO_CHARS = 64


class BacktrackEncoder:
    """Exact BPE by longest match, backtracking and pair compatibility."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        auto = ahocorasick.Automaton()
        for t, i in ranks.items():
            auto.add_word(t.decode("latin-1"), (i, len(t)))
        auto.make_automaton()
        self.auto = auto
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PATTERN).findall
        #: Neighbouring bytes inside any token. Where two bytes are not among them no token
        #: spans, so a piece may be cut there without changing its merges.
        self.spans = frozenset(t[k : k + 2] for t in ranks for k in range(len(t) - 1))
        self.cuts: dict[str, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> BacktrackEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first; used on pairs of tokens only, once each."""
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            scored = [(self.ranks[j], k) for k in range(len(parts) - 1) if (j := parts[k] + parts[k + 1]) in self.ranks]
            if not scored:
                break
            k = min(scored)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two adjacent tokens gives these two again."""
        ok = self.pairs.get((left, right))
        if ok is None:
            ok = self.pairs[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return ok

    def _walk(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        n = len(raw)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, size) in self.auto.iter(raw.decode("latin-1")):
            starts[end - size + 1].append((end + 1, i))  # longest last
        hopeless = bytearray(n + 1)
        out: list[int] = []
        at: list[int] = []
        pos = 0
        while pos < n:
            options = starts[pos]
            while options:
                to, i = options.pop()
                if not hopeless[to] and (not out or self.apart(out[-1], i)):
                    out.append(i)
                    at.append(pos)
                    pos = to
                    break
            else:
                if not out:
                    raise ValueError("a byte has no token of its own")
                hopeless[pos] = 1
                out.pop()
                pos = at.pop()
        return tuple(out)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """A piece cut where no token spans; parts are remembered like pieces."""
        if piece.isascii():
            return self._walk(piece.encode())
        out: list[int] = []
        begin, memo, cuts = 0, self.memo, self.cuts
        for k in range(1, len(piece) + 1):
            if k < len(piece):
                pair = piece[k - 1 : k + 1]
                cut = cuts.get(pair)
                if cut is None:
                    cut = pair[0].encode()[-1:] + pair[1].encode()[:1] not in self.spans
                    if len(cuts) < MEMO_PIECES:
                        cuts[pair] = cut
                if not cut:
                    continue
            part = piece[begin:k]
            ids = memo.get(part)
            if ids is None:
                ids = self._walk(part.encode())
                if len(part) <= MEMO_CHARS and len(memo) < MEMO_PIECES:
                    memo[part] = ids
            out += ids
            begin = k
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; of null and empty text none. Lone surrogates become U+FFFD."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                try:
                    ids = self._piece(piece)
                except UnicodeEncodeError:
                    ids = self._piece(piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
                if len(piece) <= MEMO_CHARS and len(memo) < MEMO_PIECES:
                    memo[piece] = ids
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


_LOADED: dict[str, BacktrackEncoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> BacktrackEncoder:
    """The encoder of a vocabulary file, loaded once a worker process."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackEncoder.from_file(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs``, repeated rows included."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in it:
            flat: list[int] = []
            ends = [0]
            for text in b.column(1).to_pylist():
                flat += enc.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``; null and empty texts have 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in it:
            sizes = [enc.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id bigint, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
