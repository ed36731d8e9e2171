"""Pairs of boxes that overlap, by a grid of several levels: a page with very many boxes is not compared box with box.

A box belongs to the level whose cells are at least as large as it is, so it lies in at most four of them. It also looks into the (at most four)
cells of every coarser level that it touches. Two boxes meet in the cells of the coarser one's level; of these the pair is taken in one only,
that of the lesser corner of their common part. So each pair appears once, and is tested where both are near.

Defined results: boxes with a null coordinate, or without area, meet nothing; boxes that only touch do not overlap; equal boxes are
pairs like others; coordinates are page shares, and others (below 0, above 1) are placed in cells of the same width outside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The finest level: cells of a 1024th of the page. Smaller boxes belong to it too.
LEVELS = 10
SIDES = ("x0", "y0", "x1", "y1")


def level_of(b: Column) -> Column:
    """The finest level whose cells are as large as the box."""
    side = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(-F.log2(side)).cast("int")))


def cell(x: Column, level: Column) -> Column:
    return F.floor(x * F.pow(F.lit(2.0), level)).cast("int")


def _cells(df: DataFrame, box: str, levels: Column) -> DataFrame:
    """A row for each cell of the given levels that the box touches: _l, _cx, _cy."""
    b = F.col(box)
    rows = df.withColumn("_l", F.explode(levels))
    reach = lambda a, z: F.explode(F.sequence(cell(b[a], F.col("_l")), cell(b[z], F.col("_l"))))
    return rows.withColumn("_cx", reach("x0", "x1")).withColumn("_cy", reach("y0", "y1"))


def _meet(own: DataFrame, other: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pairs in the cells of one level, each in the cell of the lesser corner of its common part."""
    j = own.join(other, [*keys, "_l", "_cx", "_cy"])
    p, q, level = F.col(a), F.col(b), F.col("_l")
    x, y = F.greatest(p["x0"], q["x0"]), F.greatest(p["y0"], q["y0"])
    overlap = (x < F.least(p["x1"], q["x1"])) & (y < F.least(p["y1"], q["y1"]))
    return j.where(overlap & (cell(x, level) == F.col("_cx")) & (cell(y, level) == F.col("_cy"))).drop("_l", "_cx", "_cy")


def prepared(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and one struct of all columns, of boxes that have an area."""
    area = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in SIDES]) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return df.where(area).select(*keys, F.struct(*df.columns).alias(name))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b: every two boxes (structs of all columns of left and right) of equal keys that have a common part."""
    a, b = prepared(left, keys, "a").withColumn("_la", level_of(F.col("a"))), prepared(right, keys, "b").withColumn("_lb", level_of(F.col("b")))
    to = lambda c, below: F.sequence(F.lit(0), F.col(c) - below) if not below else F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    coarse_a = _meet(_cells(a, "a", F.array("_la")), _cells(b, "b", to("_lb", 0)), keys, "a", "b")
    coarse_b = _meet(_cells(b, "b", F.array("_lb")), _cells(a, "a", to("_la", 1)), keys, "b", "a")
    return coarse_a.select(*keys, "a", "b").unionByName(coarse_b.select(*keys, "a", "b"))


def tiles(boxes: DataFrame, keys: list[str], columns: int, rows: int, overlap: float = 0.0) -> DataFrame:
    """keys, tile (row by row from 0), box: every tile of a columns x rows sheet, widened by overlap, that a box shares a part with."""
    b = prepared(boxes, keys, "box")
    n = lambda x, k, add: F.greatest(F.lit(0), F.least(F.lit(k - 1), F.floor((x + add) * k).cast("int")))
    span = lambda lo, hi, k: F.sequence(n(F.col(f"box.{lo}"), k, -overlap), n(F.col(f"box.{hi}"), k, overlap))
    each = b.withColumn("_c", F.explode(span("x0", "x1", columns))).withColumn("_r", F.explode(span("y0", "y1", rows)))
    shares = lambda lo, hi, i, k: (F.col(f"box.{lo}") < (F.col(i) + 1) / k + overlap) & (F.col(f"box.{hi}") > F.col(i) / k - overlap)
    return each.where(shares("x0", "x1", "_c", columns) & shares("y0", "y1", "_r", rows)).select(*keys, (F.col("_r") * columns + F.col("_c")).alias("tile"), "box")
