"""All readings and decisions of whole pages compared at once, in arrays.

Rows of four kinds come sorted by page: lines, pairs of an alignment, decisions, and the
lines known as furniture. A block is some tens of thousands of rows cut between pages, so
a worker holds a block and never a partition; within it everything is sorting and
searching in arrays. What leaves are only the rows that need the corpus: broken words,
doubted words, and verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LINE, PAIR, DECISION, FURNITURE = 0, 1, 2, 3
#: What a row of the output is: a broken word, a doubted word, a misread record, a decision on furniture, a page's first word.
END, WORD, GLYPH, FURNISHED, FIRST = 0, 1, 2, 3, 4
#: Rows in a block; a block ends with a page, so it may hold a page more.
BLOCK = 60_000
NONE = -(2**62)
#: In place of another spelling: the other readings of that print have no doubted word of their own.
ALONE = "\x02"

IN_SCHEMA = "kind int, page_id bigint, id bigint, run_id bigint, line_index bigint, pair_index bigint, x double, y double, confidence double, key bigint, left string, head string, numeral boolean, odd string, second_run bigint, members array<bigint>, second_members array<bigint>"
OUT = pa.schema([("what", pa.int32()), ("kind", pa.string()), ("id", pa.int64()), ("page_id", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("last", pa.bool_())])
OUT_SCHEMA = "what int, kind string, id bigint, page_id bigint, a string, b string, last boolean"


def blocks(it: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Table]:
    """Whole pages from batches sorted by page."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= size:
            t = pa.Table.from_batches(held)
            page = t.column("page_id").to_numpy()
            cut = int(np.searchsorted(page, page[-1]))
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
                n -= cut
    if held:
        yield pa.Table.from_batches(held)


def codes(*cols: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct rows of the columns, in their order."""
    n = len(cols[0])
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort(cols[::-1])
    change = np.zeros(n, bool)
    for c in cols:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(change)
    return out


def matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of equal codes."""
    order = np.argsort(right, kind="stable")
    r = right[order]
    lo, hi = np.searchsorted(r, left, "left"), np.searchsorted(r, left, "right")
    k = hi - lo
    a = np.repeat(np.arange(len(left)), k)
    within = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
    return a, order[np.repeat(lo, k) + within]


def _ints(c: pa.ChunkedArray) -> np.ndarray:
    return c.fill_null(NONE).to_numpy().astype(np.int64, copy=False)


def _floats(c: pa.ChunkedArray, null: float) -> np.ndarray:
    return c.fill_null(null).to_numpy()


def _flags(c: pa.ChunkedArray) -> np.ndarray:
    return c.fill_null(False).to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.fill_null(False).to_numpy().astype(bool)


def _objects(c: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(c), object)
    out[:] = c.to_pylist()
    return out


def _members(t: pa.Table, run: str, members: str) -> tuple[np.ndarray, ...]:
    """``row, run, line_index, part, parts`` of one side of the pairs."""
    m = t.column(members).combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
    m = m.chunk(0) if isinstance(m, pa.ChunkedArray) else m
    sizes = np.array(m.value_lengths().fill_null(0)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    part = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    index = m.flatten().fill_null(NONE).to_numpy().astype(np.int64, copy=False)
    return row, _ints(t.column(run))[row], index, part, sizes[row]


class Block:
    """One block; ``sure`` is the confidence from which on a reader is sure of a line."""

    def __init__(self, t: pa.Table, sure: float):
        kind = t.column("kind").to_numpy()
        of = lambda k: t.take(np.flatnonzero(kind == k))
        self._lines(of(LINE), of(FURNITURE), sure)
        self._pairs(of(PAIR))
        self._decisions(of(DECISION))
        self._print()

    def _lines(self, t: pa.Table, known: pa.Table, sure: float) -> None:
        page, ident, run, index = (_ints(t.column(c)) for c in ("page_id", "id", "run_id", "line_index"))
        # Rows repeated with the same id count once.
        order = np.lexsort((index, run, ident, page))
        p, i = page[order], ident[order]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
        keep = np.sort(order[first])
        t = t.take(keep)
        self.page, self.id, self.run, self.index = page[keep], ident[keep], run[keep], index[keep]
        conf = _floats(t.column("confidence"), np.nan)
        self.conf = np.where(np.isnan(conf), 0.0, conf)
        self.sure, self.unsure, self.unknown = conf >= sure, conf < sure, np.isnan(conf)
        self.key, self.has_key = _ints(t.column("key")), ~t.column("key").is_null().to_numpy()
        self.left, self.head, self.odd = (_objects(t.column(c)) for c in ("left", "head", "odd"))
        self.numeral = _flags(t.column("numeral"))
        spot = codes(self.page, self.run, _floats(t.column("x"), -1.0), _floats(t.column("y"), -1.0))
        self.halves = np.bincount(spot)[spot] if len(spot) else spot
        both = codes(np.r_[self.page, _ints(known.column("page_id"))], np.r_[self.id, _ints(known.column("id"))])
        n = len(self.page)
        self.furniture = np.isin(both[:n], both[n:])

    def _pairs(self, t: pa.Table) -> None:
        """Where each line is printed: ``at`` (line), ``pair`` (code) and whether it is the last part of its side."""
        page, pair = _ints(t.column("page_id")), _ints(t.column("pair_index"))
        sides = [_members(t, "run_id", "members"), _members(t, "second_run", "second_members")]
        row, run, index, part, parts = (np.concatenate(x) for x in zip(*sides, strict=True))
        n = len(self.page)
        c = codes(np.r_[self.page, page[row]], np.r_[self.run, run], np.r_[self.index, index])
        m, self.at = matches(c[n:], c[:n])
        self._pair_page, self._pair_index, self.part, parts = page[row][m], pair[row][m], part[m], parts[m]
        same = codes(self._pair_page, self._pair_index, self.at, self.part, parts)
        _, once = np.unique(same, return_index=True)
        self.at, self.part, self.ends = self.at[once], self.part[once], (self.part == parts - 1)[once]
        self._pair_page, self._pair_index = self._pair_page[once], self._pair_index[once]

    def _decisions(self, t: pa.Table) -> None:
        page, ident, pair = (_ints(t.column(c)) for c in ("page_id", "id", "pair_index"))
        order = np.lexsort((pair, ident, page))
        p, i = page[order], ident[order]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:] != p[:-1]) | (i[1:] != i[:-1])
        keep = np.sort(order[first])
        t = t.take(keep)
        self.d_page, self.d_id = page[keep], ident[keep]
        self.d_key, self.d_has_key = _ints(t.column("key")), ~t.column("key").is_null().to_numpy()
        self.d_left, self.d_odd = _objects(t.column("left")), _objects(t.column("odd"))
        c = codes(np.r_[self._pair_page, self.d_page], np.r_[self._pair_index, pair[keep]])
        n = len(self._pair_page)
        self.pair, self.d_pair = c[:n], c[n:]
        self.pairs = int(c.max()) + 1 if len(c) else 0

    def _print(self) -> None:
        """Per printed line: furniture or not, its first word, and the line printed next."""
        self.pair_furniture, self.pair_there, numeral = np.zeros(self.pairs, bool), np.zeros(self.pairs, bool), np.ones(self.pairs, bool)
        self.pair_furniture[self.pair[self.furniture[self.at]]] = True
        self.pair_there[self.pair] = True
        numeral[self.pair[~self.numeral[self.at]]] = False
        page = np.full(self.pairs, NONE)
        page[self.pair] = self._pair_page
        order = np.lexsort((self.id[self.at], self.conf[self.at], -self.part, self.pair))
        first = np.full(self.pairs, -1)
        first[self.pair[order]] = self.at[order]
        text = np.flatnonzero(self.pair_there & ~self.pair_furniture & ~numeral)
        self.next, self.last = np.full(self.pairs, -1), np.zeros(self.pairs, bool)
        on = page[text[1:]] == page[text[:-1]]
        self.next[text[:-1][on]] = first[text[1:][on]]
        self.last[text[np.r_[~on, True]] if len(text) else text] = True
        opens = text[np.r_[True, ~on]] if len(text) else text
        self.first_page, self.first_line = page[opens], first[opens]

    def rows(self) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in OUT]

        def put(what, kind, ident, page, a=None, b=None, last=None) -> None:
            n = len(ident)
            col = lambda v, of: [of] * n if v is None else v
            whats, kinds = (what, kind) if isinstance(kind, tuple) else ([what] * n, [kind] * n)
            for c, v in zip(out, (whats, kinds, ident, page, col(a, None), col(b, None), col(last, False)), strict=True):
                c.extend(v)

        put(FIRST, "page", self.first_line.tolist(), self.first_page.tolist(), self.head[self.first_line].tolist())
        self._broken(put)
        d = self.pair_furniture[self.d_pair] if len(self.d_pair) else np.zeros(0, bool)
        put(FURNISHED, "decision", self.d_id[d].tolist(), self.d_page[d].tolist())
        self._misread(put)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, OUT, strict=True)], schema=OUT)

    def _broken(self, put) -> None:
        n = len(self.page)
        nxt, over = np.full(n, -1), np.zeros(n, bool)
        e = np.flatnonzero(self.ends)
        e = e[np.argsort(self.pair[e], kind="stable")]
        nxt[self.at[e]], over[self.at[e]] = self.next[self.pair[e]], self.last[self.pair[e]]
        plain = np.flatnonzero(~self.furniture & ~self.numeral)
        order = plain[np.lexsort((self.id[plain], self.index[plain], self.run[plain], self.page[plain]))]
        follow = np.full(n, -1)
        same = (self.run[order[1:]] == self.run[order[:-1]]) & (self.page[order[1:]] == self.page[order[:-1]])
        follow[order[:-1][same]] = order[1:][same]
        has = np.array([x is not None for x in self.left], bool)
        w = np.flatnonzero(has & ~self.furniture & ~self.numeral)
        head = lambda at: None if at < 0 else self.head[at]
        b = [head(x) or (head(f)) for x, f in zip(nxt[w].tolist(), follow[w].tolist(), strict=True)]
        put(END, "ocr_line", self.id[w].tolist(), self.page[w].tolist(), self.left[w].tolist(), b, (over[w] & (nxt[w] < 0)).tolist())
        d = np.flatnonzero(np.array([x is not None for x in self.d_left], bool))
        at = self.next[self.d_pair[d]]
        put(END, "decision", self.d_id[d].tolist(), self.d_page[d].tolist(), self.d_left[d].tolist(), [head(x) for x in at.tolist()], (self.last[self.d_pair[d]] & (at < 0)).tolist())

    def _misread(self, put) -> None:
        n, m, k = len(self.page), len(self.d_id), len(self.at)
        keyed = self.has_key[self.at]
        looks = codes(np.r_[self.pair, self.d_pair], np.r_[self.key[self.at], self.d_key])
        size = int(looks.max()) + 1 if len(looks) else 0
        clean, noisy = np.zeros(size, bool), np.zeros(size, bool)
        clean[looks[:k][keyed & self.sure[self.at]]] = True
        noisy[looks[:k][keyed & self.unsure[self.at]]] = True
        l_clean, l_noisy = np.zeros(n, bool), np.zeros(n, bool)
        l_clean[self.at[keyed & clean[looks[:k]]]] = True
        l_noisy[self.at[keyed & noisy[looks[:k]]]] = True
        # Readings of one printed line that differ: their words are held against each other.
        low, high = np.full(self.pairs, 2**62), np.full(self.pairs, -(2**62))
        np.minimum.at(low, self.pair[keyed], self.key[self.at[keyed]])
        np.maximum.at(high, self.pair[keyed], self.key[self.at[keyed]])
        doubt = np.zeros(self.pairs, bool)
        doubt[self.pair[self.unsure[self.at]]] = True
        # Where one reader was unsure, that explains the difference.
        differ = np.zeros(n, bool)
        differ[self.at[((low < high) & ~doubt)[self.pair]]] = True
        glyph = self.has_key & ((self.unsure & (self.halves < 2)) | (self.unknown & ~l_clean & l_noisy))
        odd = np.array([x is not None for x in self.odd], bool)
        open_ = self.has_key & ~glyph & odd & ((self.unsure) | (self.unknown & ~l_clean) | (self.sure & differ))
        put(GLYPH, "ocr_line", self.id[glyph].tolist(), self.page[glyph].tolist())
        d_look = looks[k:]
        d_glyph = self.d_has_key & ~clean[d_look] & noisy[d_look]
        d_odd = np.array([x is not None for x in self.d_odd], bool)
        d_open = self.d_has_key & ~clean[d_look] & ~noisy[d_look] & d_odd
        put(GLYPH, "decision", self.d_id[d_glyph].tolist(), self.d_page[d_glyph].tolist())
        # Doubted words of the readings beside what the other readings of that print have.
        want = np.zeros(self.pairs, bool)
        want[self.pair[open_[self.at]]] = True
        want[self.d_pair[d_open]] = True
        sides: dict[int, dict[int, set[str]]] = {}
        sel = np.flatnonzero(want[self.pair]) if k else np.zeros(0, np.int64)
        for p, line, run in zip(self.pair[sel].tolist(), self.at[sel].tolist(), self.run[self.at[sel]].tolist(), strict=True):
            words = sides.setdefault(p, {}).setdefault(run, set())
            if self.odd[line]:
                words.update(self.odd[line].split(" "))
        done: set[tuple[int, str]] = set()
        rows: list[tuple] = []
        sel = np.flatnonzero(open_[self.at]) if k else sel
        placed = np.zeros(n, bool)
        placed[self.at[sel]] = True
        for p, line in zip(self.pair[sel].tolist(), self.at[sel].tolist(), strict=True):
            own = sides[p].get(int(self.run[line]), set())
            rest = [s for r, s in sides[p].items() if r != self.run[line]]
            other = set().union(*rest)
            rivals = other - own
            for w in self.odd[line].split(" "):
                if (line, w) in done:
                    continue
                done.add((line, w))
                if w in other or (self.sure[line] and not rest):
                    if not self.sure[line] and w[0] != "\x01":
                        rows.append(_alone("ocr_line", int(self.id[line]), int(self.page[line]), w))  # two readers may misread alike
                    continue
                if w[0] == "\x01":
                    if not self.sure[line] or not rivals:
                        rows.append((GLYPH, "ocr_line", int(self.id[line]), int(self.page[line]), None, None))
                    continue
                rows.append((WORD, "ocr_line", int(self.id[line]), int(self.page[line]), w, ALONE if rest and not rivals and not self.sure[line] else None))
                rows += [(WORD, "ocr_line", int(self.id[line]), int(self.page[line]), w, v) for v in rivals if v[0] != "\x01" and near(w, v)]
        for line in np.flatnonzero(open_ & ~placed & ~self.sure).tolist():
            rows += [_alone("ocr_line", int(self.id[line]), int(self.page[line]), w) for w in set(self.odd[line].split(" "))]
        for x in np.flatnonzero(d_open).tolist():
            p, ident, page = int(self.d_pair[x]), int(self.d_id[x]), int(self.d_page[x])
            words = set(self.d_odd[x].split(" "))
            rivals = set().union(*sides.get(p, {}).values()) - words
            for w in words:
                rows.append(_alone("decision", ident, page, w))
                rows += [(WORD, "decision", ident, page, w, v) for v in rivals if w[0] != "\x01" and v[0] != "\x01" and near(w, v)]
        if rows:
            put(*zip(*rows, strict=True))


def _alone(kind: str, ident: int, page: int, w: str) -> tuple:
    return (GLYPH, kind, ident, page, None, None) if w[0] == "\x01" else (WORD, kind, ident, page, w, None)


def near(a: str, b: str) -> bool:
    """Whether two spellings may be one printed word: of nearly one length, alike at both or at one end."""
    if abs(len(a) - len(b)) > 2:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    j = 0
    while j < min(len(a), len(b)) - k and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - k - j <= 3
