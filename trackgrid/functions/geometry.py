"""Box geometry as Column builders. A box is four columns ``x1 y1 x2 y2``."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2


def box(prefix: str = "") -> Box:
    """The box held in columns ``<prefix>x1 .. <prefix>y2``."""
    return Box(*[F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")])


def _inter(a: Box, b: Box, pixel: float) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + pixel)
    h = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + pixel)
    return w * h


def _union(a: Box, b: Box) -> Column:
    return a.area + b.area - _inter(a, b, 0.0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, exact edges."""
    return F.try_divide(_inter(a, b, 0.0), _union(a, b))


def iou_plus1(a: Box, b: Box) -> Column:
    """Intersection over union in which a box covers its last pixel too."""
    inter = _inter(a, b, 1.0)
    size_a = (a.width + 1) * (a.height + 1)
    size_b = (b.width + 1) * (b.height + 1)
    return F.try_divide(inter, size_a + size_b - inter)


def _hull(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def giou(a: Box, b: Box) -> Column:
    """Generalised IoU mapped from (-1, 1) to (0, 1)."""
    hull = _hull(a, b).area
    return (iou(a, b) - (hull - _union(a, b)) / hull + 1) / 2


def _diou_raw(a: Box, b: Box) -> Column:
    hull = _hull(a, b)
    gap = (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)
    return iou(a, b) - gap / (hull.width * hull.width + hull.height * hull.height)


def diou(a: Box, b: Box) -> Column:
    """Distance IoU mapped to (0, 1)."""
    return (_diou_raw(a, b) + 1) / 2


def ciou(a: Box, b: Box) -> Column:
    """Complete IoU mapped to (0, 1); heights grow by one pixel inside ``atan``."""
    turn = F.atan(b.width / (b.height + 1)) - F.atan(a.width / (a.height + 1))
    v = F.lit(4 / math.pi**2) * turn * turn
    alpha = F.coalesce(F.try_divide(v, 1 - iou(a, b) + v), F.lit(0.0))
    return (_diou_raw(a, b) - alpha * v + 1) / 2


def center_distance(a: Box, b: Box) -> Column:
    return F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Unit vector (dy, dx), guarded against zero length."""
    norm = F.sqrt(dx * dx + dy * dy) + F.lit(1e-6)
    return dy / norm, dx / norm


def direction(from_box: Box, to_box: Box) -> tuple[Column, Column]:
    """Unit vector (dy, dx) between box centres."""
    return unit(to_box.cx - from_box.cx, to_box.cy - from_box.cy)


def direction_cost(inertia: tuple[Column, Column], step: tuple[Column, Column], score: Column,
                   weight: float, has_previous: Column) -> Column:
    """Angle agreement of a candidate step with the track's inertia; 0 without history."""
    cos = inertia[0] * step[0] + inertia[1] * step[1]
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))
    term = (F.lit(math.pi / 2) - F.abs(angle)) / F.lit(math.pi)
    return F.when(has_previous, term * F.lit(weight) * score).otherwise(F.lit(0.0))


def to_center_area(b: Box) -> list[Column]:
    """(centre x, centre y, area, width / height)."""
    return [b.cx.alias("cx"), b.cy.alias("cy"), b.area.alias("area"),
            F.try_divide(b.width, b.height).alias("ratio")]


def from_center_area(cx: Column, cy: Column, area: Column, ratio: Column) -> list[Column]:
    width = F.sqrt(area * ratio)
    height = area / width
    return [(cx - width / 2).alias("x1"), (cy - height / 2).alias("y1"),
            (cx + width / 2).alias("x2"), (cy + height / 2).alias("y2")]


def to_tlwh(b: Box) -> list[Column]:
    return [b.x1.alias("left"), b.y1.alias("top"), b.width.alias("width"), b.height.alias("height")]


def from_tlwh(left: Column, top: Column, width: Column, height: Column) -> list[Column]:
    return [left.alias("x1"), top.alias("y1"), (left + width).alias("x2"), (top + height).alias("y2")]


def to_xyah(b: Box) -> list[Column]:
    """(centre x, centre y, width / height, height)."""
    return [b.cx.alias("cx"), b.cy.alias("cy"), F.try_divide(b.width, b.height).alias("ratio"),
            b.height.alias("height")]


def fuse_score(cost: Column, score: Column) -> Column:
    """Similarity weighted by detection score, back as a cost."""
    return 1 - (1 - cost) * score


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two feature vectors, never below zero."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def fuse_iou(appearance_cost: Column, overlap: Column) -> Column:
    """Appearance and overlap fused: similarity x (1 + IoU) / 2, as a cost."""
    return 1 - (1 - appearance_cost) * (1 + overlap) / 2


def overlap1d(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Closed intervals share a point."""
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def overlap2d(a: Box, b: Box) -> Column:
    return overlap1d(a.x1, a.x2, b.x1, b.x2) & overlap1d(a.y1, a.y2, b.y1, b.y2)


def tile_of(x: Column, tilesize: int) -> Column:
    return F.floor(x / tilesize)


def tile_in_grid(row: Column, col: Column, rows: int, cols: int) -> Column:
    return row.between(0, rows - 1) & col.between(0, cols - 1)


def canvas_dims(width: Column, height: Column, tilesize: int, scale: float) -> list[Column]:
    """Grid of a source frame and of its scaled canvas (ties round to even)."""
    rows, cols = F.floor(height / tilesize), F.floor(width / tilesize)

    def scaled(v: Column) -> Column:
        return F.greatest(F.lit(1), F.bround(v * F.lit(scale), 0).cast("bigint"))

    return [rows.alias("src_rows"), cols.alias("src_cols"),
            scaled(rows).alias("dst_rows"), scaled(cols).alias("dst_cols")]


def clip(b: Box, x_min: float, y_min: float, x_max: float, y_max: float) -> Box:
    def inside(v: Column, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))

    return Box(inside(b.x1, x_min, x_max), inside(b.y1, y_min, y_max),
               inside(b.x2, x_min, x_max), inside(b.y2, y_min, y_max))


def point_in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a literal polygon (a handful of vertices)."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay == by:
            continue
        spans = (F.lit(float(ay)) > y) != (F.lit(float(by)) > y)
        at = F.lit(float(bx - ax)) * (y - F.lit(float(ay))) / F.lit(float(by - ay)) + F.lit(float(ax))
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def box_hits_polygon(b: Box, polygon: list[tuple[float, float]]) -> Column:
    """A box corner lies in the polygon or a polygon vertex lies in the box."""
    hit = F.lit(False)
    for x in (b.x1, b.x2):
        for y in (b.y1, b.y2):
            hit = hit | point_in_polygon(x, y, polygon)
    for px, py in polygon:
        hit = hit | (F.lit(float(px)).between(b.x1, b.x2) & F.lit(float(py)).between(b.y1, b.y2))
    return hit
