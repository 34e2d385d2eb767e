"""Boxes as structs (x0, y0, x1, y1) of shares of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LEAST_EXTENT = 1e-6


def box_from_array(a: Column) -> Column:
    """Four numbers, clamped to the page and sorted along each axis; null if not four or without extent."""
    c = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(a, i).cast("double"))) for i in range(4)]
    x0, x1, y0, y1 = F.least(c[0], c[2]), F.greatest(c[0], c[2]), F.least(c[1], c[3]), F.greatest(c[1], c[3])
    whole = (F.size(a) == 4) & ~F.exists(a, lambda v: v.isNull())
    ok = whole & (x1 - x0 > LEAST_EXTENT) & (y1 - y0 > LEAST_EXTENT)
    return F.when(ok, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def is_box(b: Column) -> Column:
    """Within the page and of positive extent."""
    inside = F.least(b.x0, b.y0, b.x1, b.y1) >= 0
    return F.coalesce(inside & (F.greatest(b.x0, b.y0, b.x1, b.y1) <= 1) & (b.x1 > b.x0) & (b.y1 > b.y0), F.lit(False))


def area(b: Column) -> Column:
    return (b.x1 - b.x0) * (b.y1 - b.y0)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    px = lambda v, n: F.rint(v * n).cast("int")
    return F.struct(px(b.x0, width).alias("x0"), px(b.y0, height).alias("y0"), px(b.x1, width).alias("x1"), px(b.y1, height).alias("y1"))


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 if disjoint."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    both = w * h
    return F.when((w > 0) & (h > 0), both / (area(a) + area(b) - both)).otherwise(0.0)


def union_box(box: Column) -> Column:
    """Aggregate: the least box around all non-null boxes."""
    out = F.struct(F.min(box.x0).alias("x0"), F.min(box.y0).alias("y0"), F.max(box.x1).alias("x1"), F.max(box.y1).alias("y1"))
    return F.when(F.count(box) > 0, out)
