"""Geometry of boxes (x0, y0, x1, y1): Column -> Column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")])

    @classmethod
    def item(cls, struct: Column) -> "Box":
        return cls(*[struct[c] for c in ("x0", "y0", "x1", "y1")])


def area(b: Box) -> Column:
    return F.greatest(b.x1 - b.x0, F.lit(0.0)) * F.greatest(b.y1 - b.y0, F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Of boxes on one page; 0 if disjoint or without area."""
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when((i > 0) & (union > 0), i / union).otherwise(0.0)


def to_unit(b: Box, width: Column, height: Column) -> Box:
    """Pixels become shares of the page if any coordinate exceeds 1 and the page's size is known."""
    pixels = (F.greatest(b.x0, b.y0, b.x1, b.y1) > 1.0) & (width > 0) & (height > 0)
    return Box(*[F.when(pixels, v / s).otherwise(v) for v, s in ((b.x0, width), (b.y0, height), (b.x1, width), (b.y1, height))])


def pad(b: Box, by: float) -> Box:
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return Box(clamp(b.x0 - by), clamp(b.y0 - by), clamp(b.x1 + by), clamp(b.y1 + by))


def overlaps(a: Box, b: Box) -> Column:
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def same(a: Box, b: Box, tolerance: float = 1e-6) -> Column:
    close = [F.abs(x - y) <= tolerance for x, y in ((a.x0, b.x0), (a.y0, b.y0), (a.x1, b.x1), (a.y1, b.y1))]
    return close[0] & close[1] & close[2] & close[3]


def contains(outer: Box, inner: Box, tolerance: float = 0.0) -> Column:
    return (outer.x0 - tolerance <= inner.x0) & (outer.y0 - tolerance <= inner.y0) & (outer.x1 + tolerance >= inner.x1) & (outer.y1 + tolerance >= inner.y1)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def _shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals as a share of the shorter."""
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / short).otherwise(0.0)


def in_direction(candidate: Box, primary: Box, direction: Column, reach: float = 0.25, overlap: float = 0.20) -> Column:
    """Whether candidate lies above, below, left or right of primary, or nearby."""
    cx, cy = centre(candidate)
    px, py = centre(primary)
    across = _shared(candidate.x0, candidate.x1, primary.x0, primary.x1) >= overlap
    along = _shared(candidate.y0, candidate.y1, primary.y0, primary.y1) >= overlap
    return (
        F.when(direction == "above", (cy < py) & (py - cy <= reach) & across)
        .when(direction == "below", (cy > py) & (cy - py <= reach) & across)
        .when(direction == "left", (cx < px) & (px - cx <= reach) & along)
        .when(direction == "right", (cx > px) & (cx - px <= reach) & along)
        .when(direction == "nearby", (F.abs(cx - px) <= 1.5 * reach) & (F.abs(cy - py) <= 1.5 * reach))
        .otherwise(False)
    )


def page_recall(predicted: Column, gold: Column) -> Column:
    """Share of distinct gold pages that were predicted; 1 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_distinct(predicted), g)) / F.size(g))


def from_list(values: Column) -> Column:
    """A struct from a list of four numbers; null for other lengths."""
    return F.when(F.size(values) == 4, F.struct(*[F.get(values, i).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


#: Issue codes in the order in which a box is judged.
BOX_ISSUES = ("malformed", "off_page", "degenerate", "out_of_bounds", "too_large", "too_small")


def box_issues(b: Box, page: Column, pages: Column, largest: float = 0.8, smallest: float = 1e-5) -> Column:
    """Codes of what is wrong with a unit box on a page."""
    share = area(b)
    tests = (
        ("malformed", b.x0.isNull() | b.y0.isNull() | b.x1.isNull() | b.y1.isNull()),
        ("off_page", ~F.array_contains(pages, page)),
        ("degenerate", (b.x1 <= b.x0) | (b.y1 <= b.y0)),
        ("out_of_bounds", (F.least(b.x0, b.y0) < 0) | (F.greatest(b.x1, b.y1) > 1)),
        ("too_large", share > largest),
        ("too_small", (share > 0) & (share < smallest)),
    )
    return F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())


def crop_expansion(mode: Column) -> Column:
    """Share of a crop's size added on each side."""
    return F.when(mode == "none", 0.0).when(mode == "aggressive", 0.05).otherwise(0.02)
