"""Values of chart points from axis ticks: a line through ticks that withstands wrong labels, and points mapped by it.

The slope is the median of the slopes between every two ticks of an axis (Theil and Sen), the offset the median of what is left. Ticks
further off than `tolerance` times the median distance between neighbouring values are dropped once, and the line is fitted again. An axis
has tens of ticks, so its ticks are one row's array; all axes are fitted at once by column functions.

Defined results: labels that are no numbers and null positions are no ticks; of equal positions each is a tick, and pairs of equal
positions give no slope; an axis with fewer than two different positions has no line, and its points no value; a line whose ticks all fit has
no outliers; logarithmic axes (`log`) are fitted on the logarithms of positive ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median(xs: Column) -> Column:
    """The middle of a sorted array, or the mean of its two middle numbers; null for none."""
    s = F.array_sort(xs)
    n = F.size(s)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def _pairs(ticks: Column) -> Column:
    """Slopes between every two ticks {p, v} of an axis."""
    later = lambda i: F.slice(ticks, i + 2, F.greatest(F.size(ticks) - i - 1, F.lit(0)))
    slopes = F.flatten(F.transform(ticks, lambda t, i: F.transform(later(i), lambda u: F.when(u["p"] != t["p"], (u["v"] - t["v"]) / (u["p"] - t["p"])))))
    return F.filter(slopes, lambda s: s.isNotNull())


def _line(df: DataFrame, ticks: str, name: str) -> DataFrame:
    df = df.withColumn("_m", median(_pairs(F.col(ticks))))
    offset = median(F.transform(ticks, lambda t: t["v"] - F.col("_m") * t["p"]))
    return df.withColumn(name, F.when(F.col("_m").isNotNull(), F.struct(F.col("_m").alias("slope"), offset.alias("offset")))).drop("_m")


def axes(ticks: DataFrame, by: list[str], position: str = "position", value: str = "value", tolerance: float = 0.25, log: str | None = None) -> DataFrame:
    """by, slope, offset, n_ticks, n_dropped, is_log: one row an axis. log: a boolean column that marks logarithmic axes."""
    is_log = F.coalesce(F.col(log), F.lit(False)) if log else F.lit(False)
    v = F.when(is_log, F.when(F.col(value) > 0, F.log10(value))).otherwise(F.col(value).cast("double"))
    rows = ticks.select(*by, is_log.alias("is_log"), F.col(position).cast("double").alias("p"), v.alias("v")).where("p is not null and v is not null and not isnan(v)")
    of = rows.groupBy(*by, "is_log").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("t"))  # the ticks of one axis
    first = _line(of, "t", "_first")
    sorted_values = F.array_sort(F.transform("t", lambda t: t["v"]))
    first = first.withColumn("_s", sorted_values)
    gaps = F.zip_with(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))), lambda a, b: a - b)
    near = F.col("_gap") * tolerance + 1e-9
    fit = lambda t: F.abs(t["v"] - F.col("_first.slope") * t["p"] - F.col("_first.offset")) <= near
    first = first.withColumn("_gap", F.coalesce(median(gaps), F.lit(0.0)))
    kept = first.withColumn("_k", F.when(F.col("_first").isNull(), F.col("t")).otherwise(F.filter("t", fit)))
    again = _line(kept, "_k", "_line")
    line = F.coalesce("_line", "_first")
    return again.select(*by, line["slope"].alias("slope"), line["offset"].alias("offset"), F.size("t").alias("n_ticks"), (F.size("t") - F.size("_k")).alias("n_dropped"), "is_log")


def read_points(points: DataFrame, fitted: DataFrame, by: list[str], position: str = "position") -> DataFrame:
    """points with the value that their axis gives their position."""
    at = F.col("slope") * F.col(position) + F.col("offset")
    lines = fitted.select(*by, "slope", "offset", "is_log")
    return points.join(lines, by, "left").withColumn("value", F.when(F.col("is_log"), F.pow(F.lit(10.0), at)).otherwise(at)).drop("slope", "offset", "is_log")
