"""Regions and their context: type vocabularies, matching packets to regions, unions of target packets, proposals and detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as bx

# What a planner's word means in a detector's types, and which neighbours it permits.
DETECTOR_TYPES = {
    "axis": "axis-label axis_label tick-label tick_label", "axis_label": "axis-label axis_label tick-label tick_label",
    "figure": "picture image chart figure diagram plot curve", "chart": "bar_chart candlestick chart curve figure line_chart picture plot",
    "diagram": "picture figure image diagram", "picture": "picture image figure", "image": "picture image figure", "table": "table",
    "text": "checkbox-selected checkbox_selected code document_index form key_value_region list-item list_item section_header section-header text title",
    "caption": "caption", "footnote": "footnote", "formula": "formula", "header": "page-header section_header section-header title", "legend": "legend", "footer": "page-footer",
}
NEIGHBOUR_TYPES = {
    "axis": "axis-label axis_label", "axis_label": "axis-label axis_label", "axis-label": "axis-label axis_label", "caption": "caption",
    "column_header": "page-header section_header section-header title", "continuation": "page-header page-footer section_header section-header title", "footnote": "footnote",
    "header": "page-header section_header section-header title", "footer": "page-footer", "chart": "axis-label axis_label caption legend title", "legend": "legend",
    "row_header": "page-header section_header section-header title", "table": "caption footnote page-header section_header section-header title",
    "title": "title section_header section-header", "section_header": "section_header section-header title", "unit": "axis-label axis_label caption legend", "x_axis": "axis-label axis_label", "y_axis": "axis-label axis_label",
}
SPOKEN_TYPES = (
    (("axis label", "tick label"), "axis-label axis_label"), (("caption",), "caption"), (("note",), "footnote"), (("header", "row label", "column label"), "page-header section_header section-header title"),
    (("cell", "column", "row", "table", "value"), "code key_value_region list-item list_item table text"), (("legend",), "legend"), (("title",), "title section_header section-header"),
    (("continuation", "continued", "previous page", "next page"), "page-header page-footer section_header section-header title"),
)
UNION_PAD, STUB_SCORE = 0.14, 0.0


def _types(words: str) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])


def _mapped(raw: Column, table: dict[str, str]) -> Column:
    key = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    names = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _types(v))])
    return F.array_distinct(F.flatten(F.transform(raw, lambda x: F.coalesce(F.element_at(names, key(x)), F.array().cast("array<string>")))))


def detector_types(evidence_types: Column) -> Column:
    """Region types that a plan's evidence types ask for; unknown words ask for none."""
    return _mapped(F.coalesce(evidence_types, F.array().cast("array<string>")), DETECTOR_TYPES)


def permitted_types(evidence_types: Column, reason: Column) -> Column:
    """Neighbour types that a plan or a verifier's reason allows; empty if neither names any."""
    low = F.regexp_replace(F.lower(F.coalesce(reason, F.lit(""))), "[^a-z0-9_ -]+", " ")
    none = F.array().cast("array<string>")
    spoken = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), _types(types)).otherwise(none) for words, types in SPOKEN_TYPES]
    return F.array_distinct(F.concat(_mapped(F.coalesce(evidence_types, none), NEIGHBOUR_TYPES), *spoken))


def match_primary(packets: DataFrame, regions: DataFrame, keys: list[str], order: str = "region_id") -> DataFrame:
    """Packets (keys, packet_id, x0..y1, region_type, confidence) with the region they were cut from: the first of equal box on the page, else a made-up one.

    Equal boxes meet by their corners rounded to a grid of twice the tolerance, offset both ways, so the join is by equality.
    """
    grid = lambda df, shift: [F.floor(F.col(c) / 4e-6 + shift).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    r = regions.select(*keys, order, *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")], F.col("region_type").alias("r_type"), F.col("score").alias("r_score"), *grid(regions, 0.5))
    # a corner within the tolerance falls into the same cell or the next one: the packet asks for both of each corner
    around = F.array(*[F.struct(*[F.floor(F.col(c) / 4e-6 + 0.5 + d).alias(f"_{c}") for c, d in zip(("x0", "y0", "x1", "y1"), ds)]) for ds in [(a, b, c, d) for a in (-0.25, 0.25) for b in (-0.25, 0.25) for c in (-0.25, 0.25) for d in (-0.25, 0.25)]])
    p = packets.withColumn("_cell", F.explode(F.array_distinct(around))).select("*", "_cell.*").drop("_cell")
    met = p.join(r, [*keys, "_x0", "_y0", "_x1", "_y1"]).where(bx.same(bx.Box.of(), bx.Box.of("r_")))
    first = met.groupBy(*keys, "packet_id").agg(F.min_by(F.struct(F.col(order).alias("region_id"), F.col("r_type").alias("type"), F.col("r_score").alias("score")), order).alias("_r"))
    out = packets.join(first, [*keys, "packet_id"], "left")
    made = F.struct(F.concat(F.lit("synth_"), F.col("packet_id")).alias("region_id"), F.col("region_type").alias("type"), F.col("confidence").cast("double").alias("score"))
    return out.select(*packets.columns, F.coalesce(F.col("_r.region_id").cast("string"), made["region_id"]).alias("primary_id"), F.when(F.col("_r").isNull(), made["score"]).otherwise(F.col("_r.score")).alias("primary_score"), F.col("_r").isNotNull().alias("matched"))


def target_unions(packets: DataFrame, keys: list[str], least: int = 2, pad: float = UNION_PAD) -> DataFrame:
    """keys (with the page), n, x0..y1: the padded box around the target packets of each page that has enough of them."""
    own = packets.where("target").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where(F.col("n") >= least)
    b = bx.pad(bx.Box.of(), pad)
    return own.select(*keys, "n", *[getattr(b, c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def detections(boxes: DataFrame, keys: list[str], page: str, threshold: float = 0.0) -> DataFrame:
    """Detector boxes in pixels (keys, page, idx, x0..y1, width, height, label, score) as regions: ids r{idx}_p{page}, unit boxes clamped to the page."""
    clamp = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(v) / F.col(size)))
    out = boxes.where((F.col("score") >= threshold) & (F.col("width") > 0) & (F.col("height") > 0))
    return out.select(*keys, page, F.format_string("r%d_p%d", F.col("idx").cast("int"), F.col(page).cast("int")).alias("region_id"), clamp("x0", "width").alias("x0"), clamp("y0", "height").alias("y0"), clamp("x1", "width").alias("x1"), clamp("y1", "height").alias("y1"), F.lower("label").alias("region_type"), "score")


def propose_regions(pages: DataFrame, found: DataFrame, keys: list[str], page: str) -> DataFrame:
    """The detected regions of each routed page, and one region over the whole page where none was found, with the reason."""
    j = pages.select(*keys, page).join(found, [*keys, page], "left")
    none = F.col("region_id").isNull()
    whole = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    return j.select(*keys, page, F.when(none, F.format_string("page_%d", F.col(page).cast("int"))).otherwise(F.col("region_id")).alias("region_id"), *[F.when(none, v).otherwise(F.col(c)).alias(c) for c, v in whole.items()], F.when(none, STUB_SCORE).otherwise(F.col("score")).alias("score"), F.when(none, "no_detections").otherwise("detected").alias("signal"))


def spans_in_crops(spans: DataFrame, crops: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, span_id, x0..y1) whose centre lies in a crop (keys, crop_id, x0..y1) of their page."""
    c = crops.select(*keys, "crop_id", *[F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")])
    x, y = bx.centre(bx.Box.of())
    j = spans.join(c, keys)
    return j.where(x.between(F.col("c_x0"), F.col("c_x1")) & y.between(F.col("c_y0"), F.col("c_y1"))).select(*keys, "crop_id", "span_id")


def siblings(packets: DataFrame, keys: list[str], n: int = 2) -> DataFrame:
    """For each target packet of a page the n others that stand nearest: contained ones, overlapping ones (a quarter of the smaller), the rest; then by distance, area and id."""
    t = packets.where("target").select(*keys, F.col("packet_id").alias("target_id"), *[F.col(k).alias(f"t_{k}") for k in ("x0", "y0", "x1", "y1")])
    own, goal = bx.Box.of(), bx.Box.of("t_")
    j = packets.where(~F.col("target")).join(t, keys)
    share = F.try_divide(bx.intersection(own, goal), F.least(bx.area(own), bx.area(goal)))
    (x, y), (u, v) = bx.centre(own), bx.centre(goal)
    j = j.withColumns({"bucket": F.when(bx.contains(goal, own) | bx.contains(own, goal), 0).when(share >= 0.25, 1).otherwise(2), "_d": F.round(F.sqrt((x - u) ** 2 + (y - v) ** 2), 9), "_a": F.round(bx.area(own), 9)})
    w = Window.partitionBy(*keys, "target_id").orderBy("bucket", "_d", "_a", "packet_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "target_id", "packet_id", "bucket", "rank")


def citations(packet_ids: Column, packets: Column) -> Column:
    """[{page, bbox}] of the ids, in their order, from packets [{packet_id, page, bbox}]; unknown ids fall out."""
    by_id = F.map_from_entries(F.transform(packets, lambda p: F.struct(p["packet_id"].alias("key"), F.struct(p["page"].alias("page"), p["bbox"].alias("bbox")).alias("value"))))
    return F.filter(F.transform(packet_ids, lambda i: F.element_at(by_id, i)), lambda x: x.isNotNull())
