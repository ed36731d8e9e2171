"""Localisation metrics of predicted against gold boxes. Boxes meet by document and page only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx

_BOX = ("x0", "y0", "x1", "y1")


def _pairs(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    g = gold.select(*keys, F.col("box_id").alias("gold_id"), *[F.col(c).alias(f"g_{c}") for c in _BOX])
    return g.join(pred.select(*keys, F.col("box_id").alias("pred_id"), *_BOX), keys)


def iou_pairs(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    return _pairs(gold, pred, keys).withColumn("iou", bx.iou(bx.Box.of("g_"), bx.Box.of())).select(*keys, "gold_id", "pred_id", "iou")


def best_iou(gold: DataFrame, pred: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """doc, iou: the best of any pair on one page."""
    return _pairs(gold, pred, keys).groupBy(doc).agg(F.max(bx.iou(bx.Box.of("g_"), bx.Box.of())).alias("iou"))


def region_recall(gold: DataFrame, pred: DataFrame, keys: list[str], doc: str, cover: float = 0.5) -> DataFrame:
    """doc, recall: the share of gold boxes of which one prediction covers at least half; boxes without area count below only."""
    i = bx.intersection(bx.Box.of("g_"), bx.Box.of())
    a = bx.area(bx.Box.of("g_"))
    hit = _pairs(gold, pred, keys).where((a > 0) & (i >= cover * a)).select(doc, "gold_id").distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("hit"))
    return gold.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).join(hit, doc, "left").select(doc, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def region_precision(gold: DataFrame, pred: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """doc, precision: the share of predictions that touch any gold box."""
    touch = _pairs(gold, pred, keys).where(bx.intersection(bx.Box.of("g_"), bx.Box.of()) > 0).select(doc, "pred_id").distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("hit"))
    return pred.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).join(touch, doc, "left").select(doc, (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("precision"))


def full_page_rate(pred: DataFrame, doc: str, threshold: float = 0.6) -> DataFrame:
    return pred.groupBy(doc).agg(F.avg((bx.area(bx.Box.of()) > threshold).cast("int")).alias("rate"))


def duplicate_rate(pred: DataFrame, keys: list[str], doc: str, threshold: float = 0.7) -> DataFrame:
    """doc, rate: the share of boxes with another box of their page above the threshold."""
    p = pred.select(*keys, "box_id", *_BOX)
    twin = _pairs(p, p, keys).where((F.col("gold_id") != F.col("pred_id")) & (bx.iou(bx.Box.of("g_"), bx.Box.of()) > threshold)).select(doc, "gold_id").distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("dup"))
    return pred.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).join(twin, doc, "left").select(doc, (F.coalesce("dup", F.lit(0)) / F.col("n")).alias("rate"))


def page_recall(gold: DataFrame, pred: DataFrame, doc: str, page: str) -> DataFrame:
    """doc, recall over distinct pages."""
    g, p = gold.select(doc, page).distinct(), pred.select(doc, page).distinct().withColumn("_hit", F.lit(1))
    return g.join(p, [doc, page], "left").groupBy(doc).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One box around all of a page."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def remap_positional(pages, n_pages, source_pages):
    """A predicted page p in 1..n that is no source page is taken as the p-th source page."""
    return F.transform(pages, lambda p: F.when((p >= 1) & (p <= n_pages) & ~F.array_contains(source_pages, p), F.coalesce(F.get(source_pages, (p - 1).cast("int")), p)).otherwise(p))
