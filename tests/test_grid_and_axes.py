"""Overlapping boxes against all pairs, a dense page, and axis lines against a plain robust fit."""

import itertools
import random
from statistics import median

from pyspark.sql import functions as F

from evidora.operators import calibration, grid

BOX = "page int, i int, x0 double, y0 double, x1 double, y1 double"


def boxes(n, seed, side):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w, h = (r.choice([0.001, 0.03, side, 1.0]) * r.random() + 1e-4 for _ in range(2))
        x, y = r.uniform(-0.1, 1), r.uniform(-0.1, 1)
        out.append((i % 3, i, x, y, x + w, y + h))
    return out


def meets(a, b):
    return a[0] == b[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]


def test_every_overlapping_pair_once(spark):
    a = boxes(120, 1, 0.3) + [(0, 900, 0.25, 0.25, 0.5, 0.5), (0, 901, 0.5, 0.25, 0.75, 0.5), (0, 902, None, 0.0, 1.0, 1.0), (0, 903, 0.5, 0.5, 0.5, 0.9), (1, 904, 0.0, 0.0, 1.0, 1.0)]
    b = boxes(130, 2, 0.2) + [(0, 900, 0.25, 0.25, 0.5, 0.5), (0, 900, 0.25, 0.25, 0.5, 0.5), (0, 905, 0.0, 0.5, 0.25, 1.0)]
    got = sorted((r.page, r.a.i, r.b.i) for r in grid.overlapping(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), ["page"]).collect())
    real = lambda x: None not in x and x[2] < x[4] and x[3] < x[5]
    want = sorted((x[0], x[1], y[1]) for x, y in itertools.product(filter(real, a), filter(real, b)) if meets(x, y))
    assert got == want and len(got) > 200
    empty = spark.createDataFrame([], BOX)
    assert grid.overlapping(empty, spark.createDataFrame(b, BOX), ["page"]).collect() == []


def test_a_dense_page_is_not_compared_box_with_box(spark):
    """100,000 small boxes on one page: a lattice, each box overlapping its right neighbour only."""
    n = 100_000
    i = F.col("id")
    lattice = spark.range(n).select(F.lit(0).alias("page"), i.cast("int").alias("i"), (i % 1000 / 1000).alias("x0"), (F.floor(i / 1000) / 100).alias("y0"))
    left = lattice.withColumns({"x1": F.col("x0") + 0.0012, "y1": F.col("y0") + 0.004})
    p = grid.overlapping(left, left.withColumn("i", F.col("i") + 0), ["page"]).select(F.col("a.i").alias("a"), F.col("b.i").alias("b"))
    r = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("own"), F.max(F.abs(F.col("a") - F.col("b"))).alias("far")).first()
    assert (r.n, r.own, r.far) == (n + 2 * (n - 100), n, 1)


def test_tiles(spark):
    rows = [(0, 1, 0.0, 0.0, 0.4, 0.4), (0, 2, 0.5, 0.5, 0.6, 0.6), (0, 3, 0.2, 0.2, 0.9, 0.9), (0, 4, 0.55, 0.0, 0.6, 0.1)]
    df = spark.createDataFrame(rows, BOX)
    at = lambda overlap: sorted((r.box.i, r.tile) for r in grid.tiles(df, ["page"], 2, 2, overlap).collect())
    assert at(0.0) == [(1, 0), (2, 3), (3, 0), (3, 1), (3, 2), (3, 3), (4, 1)]
    assert at(0.06) == sorted([(1, 0), (2, 0), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (3, 3), (4, 0), (4, 1)])


def plain_line(ticks, tolerance=0.25):
    def line(ts):
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(ts, 2) if a[0] != b[0]]
        if not slopes:
            return None
        m = median(slopes)
        return m, median(v - m * p for p, v in ts)

    first = line(ticks)
    if first is None:
        return None, 0
    values = sorted(v for _, v in ticks)
    gap = median(b - a for a, b in zip(values, values[1:])) if len(values) > 1 else 0.0
    kept = [t for t in ticks if abs(t[1] - first[0] * t[0] - first[1]) <= gap * tolerance + 1e-9]
    return line(kept) or first, len(ticks) - len(kept)


def test_lines_withstand_wrong_labels(spark):
    r = random.Random(4)
    rows, want = [], {}
    for axis in range(40):
        m, o = r.uniform(-50, 50), r.uniform(-9, 9)
        ts = [(p / 10, m * p / 10 + o) for p in range(r.randint(1, 12))]
        for i in range(len(ts)):
            if r.random() < 0.15:
                ts[i] = (ts[i][0], ts[i][1] * 10 + 3)
        rows += [(axis, p, v, False) for p, v in ts]
        want[axis] = plain_line(sorted(ts))
    rows += [(90, 0.1, 5.0, False), (90, 0.1, 6.0, False), (91, None, 1.0, False), (92, 0.0, 1.0, True), (92, 0.5, 10.0, True), (92, 1.0, 100.0, True), (92, 0.7, -1.0, True), (93, 0.3, float("nan"), False)]
    ticks = spark.createDataFrame(rows, "axis int, position double, value double, is_log boolean")
    fitted = calibration.axes(ticks, ["axis"], log="is_log")
    got = {x.axis: x for x in fitted.collect()}
    for axis, (line, dropped) in want.items():
        x = got[axis]
        assert x.n_dropped == dropped
        if line is None:
            assert x.slope is None
        else:
            assert abs(x.slope - line[0]) < 1e-6 and abs(x.offset - line[1]) < 1e-6
    assert got[90].slope is None and 91 not in got and 93 not in got and got[92].n_ticks == 3
    points = spark.createDataFrame([(92, 0.25), (90, 0.1), (77, 0.1)], "axis int, position double")
    read = {p.axis: p.value for p in calibration.read_points(points, fitted, ["axis"]).collect()}
    assert abs(read[92] - 10**0.5) < 1e-9 and read[90] is None and read[77] is None
