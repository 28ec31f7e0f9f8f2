"""Alignment of two readings of a page, line by line.

Lines are laid in reading order and matched by dynamic programming over groups of up to
three lines a side. A group is admitted if its boxes lie close across the reading
direction; its score is four times the similarity of the joined texts, half the overlap,
less a quarter for each further line but with a bonus of 2.25 similarities for it. Lines
left alone cost 1.5. Pages are the unit of work: a page has some tens of lines, so a
cogrouped map holds two small frames, and no page meets another.
"""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONELY, MAX_GROUP, NEAR = -1.5, 3, 0.08
#: A second path within this score makes pairs ambiguous; boxes of more than this share of the text's width stand over columns.
CLOSE, WIDE = 0.20, 0.6
SCHEMA = "page_id bigint, pair_no int, primary_members array<bigint>, secondary_members array<bigint>, similarity double, ambiguous boolean"


@functools.lru_cache(maxsize=20_000)
def similarity(a: str, b: str) -> float:
    """Matching-blocks ratio; both empty 1, one empty 0."""
    if a == b or not a or not b:
        return float(a == b)
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity((x or "").lower(), (y or "").lower()) for x, y in zip(a, b, strict=True)])


def similar(a: Column, b: Column) -> Column:
    """Equal texts never reach Python."""
    la, lb = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.when(la == lb, F.lit(1.0)).otherwise(similarity_udf(F.when(la != lb, a), F.when(la != lb, b)))


def _joined(texts: list[str]) -> str:
    """Lines as one: a blank only between two letters or figures that are not CJK."""
    out = ""
    for t in texts:
        latin = bool(out) and bool(t) and out[-1].isalnum() and t[0].isalnum() and ord(out[-1]) < 0x2E80 and ord(t[0]) < 0x2E80
        out += (" " if latin else "") + t
    return out


def _columns(boxes: list[tuple[float, float, float, float]]) -> list[int]:
    """The column, from the left, of each box ``x, y, w, h``: stretches of the width that no box crosses.

    Boxes wider than ``WIDE`` of the page's text stand over the columns and go to the first
    if they stand above all others, else to the last.
    """
    if not boxes:
        return []
    left, right = min(b[0] for b in boxes), max(b[0] + b[2] for b in boxes)
    wide = [b[2] > WIDE * (right - left) for b in boxes]
    ends: list[list[float]] = []
    for x0, x1 in sorted((b[0], b[0] + b[2]) for b, w in zip(boxes, wide, strict=True) if not w):
        if ends and x0 <= ends[-1][1]:
            ends[-1][1] = max(ends[-1][1], x1)
        else:
            ends.append([x0, x1])
    if len(ends) < 2:
        return [0] * len(boxes)
    top = min((b[1] for b, w in zip(boxes, wide, strict=True) if not w), default=0.0)
    of = lambda b: next(k for k, e in enumerate(ends) if e[0] <= b[0] < e[1] or b[0] == e[0])
    return [(0 if b[1] <= top else len(ends) - 1) if w else of(b) for b, w in zip(boxes, wide, strict=True)]


class _Side:
    """Lines of one reading in reading order, with the joined text and box of short groups.

    Columns follow each other from the left, on upright pages from the right unless they
    are declared to run from the left; within a column lines follow from the top.
    """

    def __init__(self, pdf: pd.DataFrame, upright: bool, from_left: bool):
        num = lambda c: pdf[c].fillna(0.0).tolist() if c in pdf else [0.0] * len(pdf)
        boxes = list(zip(num("x"), num("y"), num("width"), num("height"), strict=True))
        columns = _columns(boxes)
        last = max(columns, default=0)
        rows = sorted(
            ((c if from_left or not upright else last - c), b[1], b[0], int(i), b, t)
            for c, b, i, t in zip(columns, boxes, pdf.line_index.tolist(), pdf.text.fillna("").tolist(), strict=True)
        )
        self.index = [r[3] for r in rows]
        self.column = [r[0] for r in rows]
        self.box = [r[4] for r in rows]
        self.text = [r[5] for r in rows]
        self.upright = upright

    def group(self, end: int, size: int) -> tuple | None:
        """Text, box, centre across the lines and shape of a group; none across columns."""
        k = slice(end - size, end)
        if len(set(self.column[k])) > 1:
            return None
        bs = self.box[k]
        x0, y0 = min(b[0] for b in bs), min(b[1] for b in bs)
        x1, y1 = max(b[0] + b[2] for b in bs), max(b[1] + b[3] for b in bs)
        centre = sum(b[0] + b[2] / 2 if self.upright else b[1] + b[3] / 2 for b in bs) / size
        tall = sum(b[3] for b in bs) > sum(b[2] for b in bs)
        return _joined(self.text[k]), (x0, x1), (y0, y1), centre, tall, len(max(self.text[k], key=len)) > 1 and x1 > x0


def _shared(a: tuple[float, float], b: tuple[float, float]) -> float:
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / max(1e-9, min(a[1] - a[0], b[1] - b[0]))


def _score(one: tuple, two: tuple, extra: int, flat: bool) -> tuple[float, float] | None:
    """Score and similarity of two groups, none if they can't be one print."""
    (ta, ax, ay, ac, a_tall, a_real), (tb, bx, by, bc, b_tall, b_real) = one, two
    if abs(ac - bc) > NEAR or (a_real and b_real and a_tall != b_tall):
        return None
    if flat and _shared(ax, bx) == 0.0:  # lines of one height in two columns
        return None
    if extra and 2 * min(len(ta), len(tb)) < 0.7 * (len(ta) + len(tb)):
        return None  # too unlike in length to be similar enough
    sim = similarity(ta.lower(), tb.lower())
    if extra and sim < 0.7:
        return None
    return 4 * sim + 0.5 * min(1.0, _shared(ay, by)) - 0.25 * extra + 2.25 * sim * extra, sim


def align_page(p: pd.DataFrame, s: pd.DataFrame, direction: str | None = None) -> list[tuple[list[int], list[int], float]]:
    """The pairs of ``align_page_with_doubt`` without the doubt."""
    return [x[:3] for x in align_page_with_doubt(p, s, direction)]


def align_page_with_doubt(p: pd.DataFrame, s: pd.DataFrame, direction: str | None = None) -> list[tuple[list[int], list[int], float, bool]]:
    """Best path; ties prefer smaller groups on the primary, then on the secondary side.

    With each pair whether it is ambiguous: the second best path is as good within
    ``CLOSE`` and pairs these lines in another way.
    """
    rows = [x for x in (p, s) if len(x) and "width" in x]
    upright = direction.startswith("vertical") if direction else sum(x.height.sum() for x in rows) > sum(x.width.sum() for x in rows) > 0
    one, two = (_Side(x, upright, direction == "vertical-lr") for x in (p, s))
    n, m = len(one.index), len(two.index)
    flat = not upright and max([*one.column, *two.column], default=0) > 0
    left = {(i, a): g for i in range(1, n + 1) for a in range(1, min(MAX_GROUP, i) + 1) if (g := one.group(i, a))}
    right = {(j, b): g for j in range(1, m + 1) for b in range(1, min(MAX_GROUP, j) + 1) if (g := two.group(j, b))}
    shapes = [(1, 1), *((1, b) for b in range(2, MAX_GROUP + 1)), *((a, 1) for a in range(2, MAX_GROUP + 1))]
    # The two best ways into every cell: score, step back, and which way of the cell before.
    ways: list[list[list[tuple[float, int, int, int]]]] = [[[] for _ in range(m + 1)] for _ in range(n + 1)]
    ways[0][0] = [(0.0, 0, 0, 0)]
    sims: dict[tuple[int, int, int, int], float] = {}
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            options = []
            if i:
                options += [(w[0] + LONELY, -1, 0, -r) for r, w in enumerate(ways[i - 1][j])]
            if j:
                options += [(w[0] + LONELY, 0, -1, -r) for r, w in enumerate(ways[i][j - 1])]
            for a, b in shapes:
                if (i, a) not in left or (j, b) not in right:
                    continue
                got = _score(left[i, a], right[j, b], a + b - 2, flat)
                if got:
                    sims[i, j, a, b] = got[1]
                    options += [(w[0] + got[0], -a, -b, -r) for r, w in enumerate(ways[i - a][j - b])]
            ways[i][j] = sorted(options, reverse=True)[:2]

    def path(rank: int) -> list[tuple[int, int, int, int]]:
        out, i, j = [], n, m
        while i or j:
            _, a, b, r = ways[i][j][rank]
            out.append((i, j, -a, -b))
            i, j, rank = i + a, j + b, -r
        return out[::-1]

    best = path(0)
    doubtful: set[tuple[int, int, int, int]] = set()
    last = ways[n][m]
    if len(last) > 1 and last[0][0] - last[1][0] <= CLOSE:
        other = path(1)
        changed = [x for x in set(best) ^ set(other) if x[2] and x[3]]
        if len(changed) > 1:
            doubtful = set(best) - set(other)
    return [(one.index[i - a : i], two.index[j - b : j], round(sims.get((i, j, a, b), 0.0) if a and b else 0.0, 6), (i, j, a, b) in doubtful) for i, j, a, b in best]


def align_pages(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Pairs of line groups of every page that one of the readings has; ``direction``, where a reading declares it, sets the order of columns."""
    cols = ["page_id", "line_index", "text", "x", "y", "width", "height", "direction"]
    shaped = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string" if c == "direction" else "double").alias(c) for c in cols])

    def one(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        page = int(p.page_id.iloc[0] if len(p) else s.other_page.iloc[0])
        said = sorted({d for x in (p, s) for d in x.direction.dropna().unique()})
        rows = [(page, k, a, b, sim, unclear) for k, (a, b, sim, unclear) in enumerate(align_page_with_doubt(p, s, said[0] if len(said) == 1 else None))]
        return pd.DataFrame(rows, columns=["page_id", "pair_no", "primary_members", "secondary_members", "similarity", "ambiguous"])

    # Few bytes and much work: partitions are set by number, or they would be merged by size.
    sc = primary.sparkSession.sparkContext
    n = max(sc.defaultParallelism, int(primary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    other = shaped(secondary).withColumnRenamed("page_id", "other_page")
    return shaped(primary).repartition(n, "page_id").groupBy("page_id").cogroup(other.repartition(n, "other_page").groupBy("other_page")).applyInPandas(one, SCHEMA)
