"""Queries of boxes that overlap, sheet tiles and axis calibration, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog as cat
from .operators import calibration as ca
from .operators import grid
from .sources import views as vw

query, r6 = cat.query, cat.r6

_ID = "doc, page, line, part, supp, x0, y0, x1, y1"
_MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_AREA = "x0 < x1 AND y0 < y1"


@query(f"WITH v AS (SELECT {_ID}, region_type FROM {cat.BOX} WHERE {_AREA}) SELECT a.doc, a.page, a.line AS line_a, a.part AS part_a, b.line AS line_b, b.part AS part_b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS common FROM v a JOIN v b ON a.doc = b.doc AND a.page = b.page AND a.region_type = 'table' AND b.region_type <> 'table' AND {_MEET}")
def overlapping_boxes(spark, sf_dir):
    v = vw.boxes(spark, sf_dir).select(*_ID.split(", "), "region_type")
    p = grid.overlapping(v.where("region_type = 'table'"), v.where("region_type <> 'table'"), ["doc", "page"])
    common = (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")) * (F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
    return r6(p.select("doc", "page", F.col("a.line").alias("line_a"), F.col("a.part").alias("part_a"), F.col("b.line").alias("line_b"), F.col("b.part").alias("part_b"), common.alias("common")))


@query(f"SELECT doc, page, (r * 3 + c)::BIGINT AS tile, count(*) AS n FROM (SELECT * FROM {cat.BOX} WHERE {_AREA}), range(3) t(c), range(2) u(r) WHERE x0 < (c + 1) / 3::DOUBLE + 0.05::DOUBLE AND x1 > c / 3::DOUBLE - 0.05::DOUBLE AND y0 < (r + 1) / 2::DOUBLE + 0.05::DOUBLE AND y1 > r / 2::DOUBLE - 0.05::DOUBLE GROUP BY ALL")
def boxes_on_tiles(spark, sf_dir):
    return r6(grid.tiles(vw.boxes(spark, sf_dir), ["doc", "page"], 3, 2, 0.05).groupBy("doc", "page", "tile").agg(F.count(F.lit(1)).alias("n")))


def ticks(spark, sf_dir):
    """Ticks of one axis an order: positions by line, values along a line, every seventh label misread."""
    li = vw.table(spark, sf_dir, "lineitem")
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    true = F.col("l_linenumber") * 10.0 + k % 13
    return li.select(k.alias("axis"), (F.col("l_linenumber") * 0.125).alias("position"), F.when(s % 7 == 0, true * 10).when(s % 11 == 0, F.lit(None)).otherwise(true).alias("value"))


_FIT = """WITH t AS (SELECT l_orderkey AS axis, l_linenumber * 0.125::DOUBLE AS p, CASE WHEN l_suppkey % 7 = 0 THEN (l_linenumber * 10.0::DOUBLE + l_orderkey % 13) * 10 WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_linenumber * 10.0::DOUBLE + l_orderkey % 13 END AS v FROM lineitem),
a AS (SELECT row_number() OVER () AS i, * FROM t WHERE v IS NOT NULL),
m1 AS (SELECT x.axis, median((y.v - x.v) / (y.p - x.p)) AS m FROM a x JOIN a y ON x.axis = y.axis AND x.i < y.i AND x.p <> y.p GROUP BY x.axis),
o1 AS (SELECT axis, any_value(m) AS m, median(v - m * p) AS o FROM a LEFT JOIN m1 USING (axis) GROUP BY axis),
g AS (SELECT axis, coalesce(median(d), 0) AS gap FROM (SELECT axis, v - lag(v) OVER (PARTITION BY axis ORDER BY v) AS d FROM a) GROUP BY axis),
k AS (SELECT a.*, m, m IS NULL OR abs(v - m * p - o) <= gap * 0.25::DOUBLE + 1e-9::DOUBLE AS fit FROM a JOIN o1 USING (axis) JOIN g USING (axis)),
m2 AS (SELECT x.axis, median((y.v - x.v) / (y.p - x.p)) AS m FROM k x JOIN k y ON x.axis = y.axis AND x.i < y.i AND x.p <> y.p WHERE x.fit AND y.fit GROUP BY x.axis),
o2 AS (SELECT k.axis, m2.m, median(v - m2.m * p) AS o FROM k JOIN m2 ON m2.axis = k.axis WHERE fit GROUP BY k.axis, m2.m),
n AS (SELECT axis, count(*) AS n_ticks, count(*) FILTER (NOT fit) AS n_dropped FROM k GROUP BY axis)
"""


@query(f"{_FIT} SELECT axis, round(coalesce(o2.m, o1.m), 6) AS slope, round(CASE WHEN o2.m IS NOT NULL THEN o2.o WHEN o1.m IS NOT NULL THEN o1.o END, 6) AS offset, n_ticks, n_dropped FROM n JOIN o1 USING (axis) LEFT JOIN o2 USING (axis)")
def axis_lines(spark, sf_dir):
    return r6(ca.axes(ticks(spark, sf_dir), ["axis"]).drop("is_log"))
