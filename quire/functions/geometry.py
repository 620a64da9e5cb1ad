"""Geometry of page boxes as Column expressions. A box is named by a prefix: side("a") stands for a_x0, a_y0, a_x1, a_y1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR, ALIGNED, SPATIAL = 50.0, 10.0, 0.8


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2


def side(prefix: str) -> Box:
    return Box(*(F.col(f"{prefix}_{c}") for c in ("x0", "y0", "x1", "y1")))


def horizontal_gap(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x0 - a.x1, a.x0 - b.x1)


def vertical_gap(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y0 - a.y1, a.y0 - b.y1)


def overlap(a: Box, b: Box) -> tuple[Column, Column]:
    """Extents shared in x and in y; negative where there is a gap."""
    return F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)


def overlaps(a: Box, b: Box) -> Column:
    x, y = overlap(a, b)
    return (x > 0) & (y > 0)


def iou(a: Box, b: Box) -> Column:
    """Shared area over joint area; boxes that only touch share none."""
    x, y = overlap(a, b)
    shared = F.when((x > 0) & (y > 0), x * y).otherwise(0.0)
    return shared / F.greatest(a.width * a.height + b.width * b.height - shared, F.lit(1e-6))


def aspect_score(a: Box, b: Box) -> Column:
    """1 less the relative difference of the aspect ratios."""
    p, q = a.width / F.greatest(F.lit(1.0), a.height), b.width / F.greatest(F.lit(1.0), b.height)
    return F.greatest(F.lit(0.0), 1 - F.abs(p - q) / F.greatest(p, q, F.lit(1.0)))


def image_score(a: Box, b: Box) -> Column:
    return 0.7 * iou(a, b) + 0.3 * aspect_score(a, b)


def centre_distance(a: Box, b: Box) -> Column:
    return F.sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))


def gap_distance(a: Box, b: Box) -> Column:
    x, y = horizontal_gap(a, b), vertical_gap(a, b)
    return F.sqrt(x * x + y * y)


def spatial_confidence(along: Column, across: Column) -> Column:
    """Confidence of a relation: across is the gap that should be small for alignment, along the gap in its direction."""
    distance = F.greatest(F.lit(0.0), 1 - (along + across) / (2 * NEAR))
    aligned = F.greatest(F.lit(0.0), 1 - across / ALIGNED)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), SPATIAL * distance * (0.7 + 0.3 * aligned)))


def alignment_score(image: Box, caption: Box) -> Column:
    x, y = overlap(image, caption)
    part = lambda o, size: F.when(size > 0, F.greatest(F.lit(0.0), o / size)).otherwise(0.0)
    return 0.7 * part(x, F.greatest(image.width, caption.width)) + 0.3 * part(y, F.greatest(image.height, caption.height))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def position_score(image: Box, caption: Box, preferred: float = 50.0) -> Column:
    """Captions below their image, and near it, score higher."""
    gap = F.abs(caption.cy - image.cy)
    near = F.when(gap <= preferred, 0.2 * (1 - gap / preferred)).otherwise(0.0)
    return _clamped(0.5 + F.when(caption.cy > image.cy, 0.3).otherwise(-0.1) + near)


def containment_score(image: Box, caption: Box) -> Column:
    x, y = overlap(image, caption)
    area = caption.width * caption.height
    return F.when((x > 0) & (y > 0) & (area > 0), 0.8 * x * y / area).otherwise(0.0)


def reading_order_score(image: Box, caption: Box) -> Column:
    below, right = caption.cy >= image.cy, caption.cx >= image.cx
    return _clamped(0.5 + F.when(below, 0.2).otherwise(0.0) + F.when(right, 0.1).otherwise(0.0) - F.when(~below & ~right, 0.2).otherwise(0.0))


def proximity_score(image: Box, caption: Box) -> Column:
    """Weighted composite; column awareness counts a constant half."""
    distance = F.greatest(F.lit(0.0), 1 - centre_distance(image, caption) / 1000)
    return 0.3 * distance + 0.2 * alignment_score(image, caption) + 0.2 * position_score(image, caption) + 0.15 * reading_order_score(image, caption) + 0.05 + 0.05 * containment_score(image, caption)


def match_type(image: Box, caption: Box, preferred: float = 50.0) -> Column:
    """How a caption lies to its image."""
    x, y = overlap(image, caption)
    step_y, step_x = 0.5 * F.least(image.height, caption.height), 0.5 * F.least(image.width, caption.width)
    level, upright = x >= 0.3 * F.least(image.width, caption.width), y >= 0.3 * F.least(image.height, caption.height)
    below = caption.y0.between(image.y1 - step_y, image.y1 + 2 * step_y) & level
    above = caption.y1.between(image.y0 - 2 * step_y, image.y0 + step_y) & level
    beside = (caption.x0.between(image.x1 - step_x, image.x1 + 2 * step_x) | caption.x1.between(image.x0 - 2 * step_x, image.x0 + step_x)) & upright
    kinds = [(overlaps(image, caption), "embedded"), (below, "direct_below"), (above, "direct_above"), (beside, "side_by_side"), (gap_distance(image, caption) <= 2 * preferred, "grouped")]
    out = F.lit("distant")
    for test, kind in reversed(kinds):
        out = F.when(test, kind).otherwise(out)
    return out


def layout_confidence(kind: Column) -> Column:
    scores = {"direct_below": 0.9, "direct_above": 0.8, "side_by_side": 0.7, "grouped": 0.6, "embedded": 0.5, "distant": 0.3}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in scores.items() for x in pair)), kind), F.lit(0.5))


def normalised(box: Box, width: float, height: float) -> Column:
    """The box in thousandths of the page."""
    return F.array((box.x0 * 1000 / width).cast("int"), (box.y0 * 1000 / height).cast("int"), (box.x1 * 1000 / width).cast("int"), (box.y1 * 1000 / height).cast("int"))
