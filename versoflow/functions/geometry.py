"""Boxes of lines as column expressions; coordinates are shares of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length over the shorter of two intervals; 0 for an empty one."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter).otherwise(F.lit(0.0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), a0 - b1, b0 - a1)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = aw * ah + bw * bh - w * h
    return F.when(both > 0, F.least(F.lit(1.0), w * h / both)).otherwise(F.lit(0.0))


def pixels(low: Column, size: Column, extent: Column, padding: float = 0.01) -> tuple[Column, Column]:
    """First and last pixel of a padded side, within the page; a hair is allowed for rounding."""
    a = F.greatest(F.lit(0), F.floor((low - padding) * extent + 1e-9))
    b = F.least(extent, F.ceil((low + size + padding) * extent - 1e-9))
    return a.cast("bigint"), b.cast("bigint")


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """Bounding box of an ``array<array<double>>`` of pixels as clamped shares ``x, y, w, h``."""
    share = lambda i, e: F.transform(points, lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p[i] / e)))
    xs, ys = share(0, width), share(1, height)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
