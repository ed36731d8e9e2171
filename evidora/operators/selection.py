"""Ranking and selection of regions: scores, page diversity, spatial neighbours, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as bx

# Neighbour rules by (region type, figure class or any): (target, direction, role) in order.
_TITLES = (("title", "above", "title"), ("section_header", "above", "title"), ("section-header", "above", "title"))
_BELOW = (("caption", "below", "caption"), ("footnote", "below", "footnote"))
_HEADERS = (("section_header", "above", "title"), ("section-header", "above", "title"))
RULES: dict[tuple[str, str | None], tuple[tuple[str, str, str], ...]] = {
    ("picture", "bar_chart"): _BELOW + _TITLES,
    ("picture", "line_chart"): _BELOW + _TITLES,
    ("picture", "pie_chart"): _BELOW + _TITLES,
    ("picture", "scatter_plot"): (*_BELOW, ("section_header", "above", "title")),
    ("picture", None): _BELOW + _HEADERS,
    ("table", None): (*_HEADERS, ("title", "above", "title"), ("footnote", "below", "footnote"), ("caption", "below", "caption")),
    ("text", None): _HEADERS,
    ("list-item", None): _HEADERS,
    ("list_item", None): _HEADERS,
    ("formula", None): (("section_header", "above", "title"), ("caption", "below", "caption")),
}
HINT_BOOST = 1.5
# Types that annotate others, context roles, and the relevance and weight of each role.
NEIGHBOUR_TYPES = ("caption", "footnote", "title", "section_header", "section-header", "page-header", "page-footer", "legend", "axis_label", "axis-label")
CONTEXT_ROLES = ("legend_binding", "axis_reading", "caption_context", "footnote_adjustment", "table_cell_lookup", "header_disambiguation")
ROLE_THRESHOLD = {
    "caption": 0.30, "caption_context": 0.30, "legend": 0.30, "legend_binding": 0.30, "footnote": 0.40, "footnote_adjustment": 0.40,
    "title": 0.45, "section_header": 0.45, "section-header": 0.45, "page-header": 0.45, "page-footer": 0.45,
    "axis_label": 0.50, "axis-label": 0.50, "axis_reading": 0.50, "table_cell_lookup": 0.55, "header_disambiguation": 0.55,
}
ROLE_WEIGHT = {
    "caption": 1.20, "caption_context": 1.20, "legend": 1.15, "legend_binding": 1.15, "footnote": 1.10, "footnote_adjustment": 1.10,
    "axis_label": 0.95, "axis-label": 0.95, "axis_reading": 0.95, "table_cell_lookup": 0.90, "header_disambiguation": 0.90,
}
CHART_CLASSES = ("bar_chart", "line_chart", "pie_chart", "scatter_plot")
VISUAL_TYPES = ("picture", "figure", "chart")


def _lookup(values: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def rules_for(region_type: Column, figure: Column) -> Column:
    """The rule list of the most specific entry; empty for unknown types."""
    row = lambda rs: F.array(*[F.struct(F.lit(t).alias("target"), F.lit(d).alias("direction"), F.lit(r).alias("role")) for t, d, r in rs])
    kind, cls = F.lower(region_type), F.lower(figure)
    out = None
    for (t, c), rs in sorted(RULES.items(), key=lambda x: x[0][1] is None):
        cond = (kind == t) & (cls == c if c else F.lit(True))
        out = F.when(cond, row(rs)) if out is None else out.when(cond, row(rs))
    return F.coalesce(out, F.array().cast("array<struct<target:string,direction:string,role:string>>"))


def rank_score(score: Column, region_type: Column, boosted: Column, wants_chart: Column, figure: Column, relevance: Column, needed_for: Column) -> Column:
    """Detector score times what was asked for: type, chart class, relevance and being the answer's carrier."""
    kind = F.lower(F.coalesce(region_type, F.lit("")))
    asked = F.when(F.array_contains(boosted, kind), 1.5).otherwise(1.0)
    chart = F.when(wants_chart & kind.isin(*VISUAL_TYPES), F.when(figure.isin(*CHART_CLASSES), 1.5).when(figure == "logo", 0.25).when(figure == "other", 0.45).otherwise(1.0)).otherwise(1.0)
    rel = F.when(relevance.isNotNull(), F.greatest(F.lit(0.1), 2.0 * relevance)).otherwise(1.0)
    return score * asked * chart * rel * F.when(needed_for == "primary", 1.3).otherwise(1.0)


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; planned as a group limit before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def page_diverse(df: DataFrame, by: list[str], page: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each group: the best of each page in rank order first, then the rest by rank."""
    g = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(g.orderBy(*order))).withColumn("_p", F.row_number().over(Window.partitionBy(*by, page).orderBy(*order)))
    return ranked.withColumn("rank", F.row_number().over(g.orderBy(F.col("_p") != 1, "_r"))).where(F.col("rank") <= n).drop("_r", "_p")


def merge_rerank(regions: DataFrame, reranked: DataFrame, by: list[str], region_id: str = "region_id") -> DataFrame:
    """Regions with relevance, role and united hints; order by relevance * score, ties in the reranker's and then the given order.

    regions: by, region_id, score, ordinal, hints. reranked: by, region_id, relevance, needed_for, hints, entry. Unknown ids fall out.
    """
    r = reranked.select(*by, region_id, "relevance", "needed_for", F.col("hints").alias("_hints"), "entry")
    j = regions.join(r, [*by, region_id], "left").withColumn("hints", F.array_union("hints", F.coalesce("_hints", F.array().cast("array<string>")))).drop("_hints")
    order = [F.desc(F.coalesce(F.col("relevance") * F.col("score"), F.lit(0.0))), F.coalesce("entry", F.lit(1 << 30)), F.col("ordinal")]
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def pick_neighbours(primaries: DataFrame, candidates: DataFrame, keys: list[str], n: int = 2, padding: float = 0.08, planner_hint: bool = False, threshold: float = 0.5, permitted: tuple[str, ...] = ()) -> DataFrame:
    """Context regions of each primary on its page: typed, near, relevant; ordered by bucket, weighted relevance, distance, score.

    primaries: keys, primary_id, x0..y1. candidates: keys, region_id, x0..y1, region_type, needed_for, relevance, score. The join is
    by keys (document and page); nothing but boxes of one page meet.
    """
    p = primaries.select(*keys, "primary_id", *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    j = candidates.join(p, keys)
    a, b = bx.Box.of("p_"), bx.Box.of()
    kind = F.lower(F.coalesce("region_type", F.lit("")))
    in_role = F.coalesce(F.col("needed_for").isin(*CONTEXT_ROLES), F.lit(False))
    ok_type = kind.isin(*permitted) if permitted else F.lit(False)
    role = F.lower(F.coalesce("needed_for", "region_type", F.lit("")))
    limit = F.least(F.lit(threshold), _lookup(ROLE_THRESHOLD, role, 0.5))
    weight = _lookup(ROLE_WEIGHT, role, 1.0)
    rel = F.col("relevance").cast("double")
    bucket = F.when(in_role, 1).when(rel.isNotNull(), F.when(rel >= limit, 0)).when(ok_type, 2).when(F.lit(not planner_hint), 3)
    primary = F.when(in_role, -F.when(F.coalesce(rel, F.lit(0.0)) == 0, 0.5).otherwise(rel) * weight).when(rel.isNotNull(), -rel * weight).otherwise(0.0)
    near = j.where((kind.isin(*NEIGHBOUR_TYPES) | ok_type | in_role) & ~bx.same(b, a) & bx.overlaps(bx.pad(a, padding), b))
    near = near.withColumn("bucket", bucket).where("bucket is not null").withColumn("_primary", primary).withColumn("_gap", F.abs(bx.centre(b)[1] - bx.centre(a)[1]))
    order = [F.col("bucket"), F.round("_primary", 9), F.round("_gap", 9), F.desc("score"), F.col("region_id")]
    out = top_n(near, [*keys, "primary_id"], order, n)
    return out.select(*keys, "primary_id", "region_id", "region_type", "bucket", "rank")


def rule_neighbours(primaries: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate of each rule by itself: keys, primary_id, rule, role, region_id. (A region may serve several rules.)"""
    p = primaries.select(*keys, "primary_id", F.col("region_type").alias("p_type"), *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")], F.posexplode(rules_for(F.col("region_type"), F.lit(None).cast("string"))).alias("rule", "r"))
    c = candidates.withColumn("_target", F.lower("region_type"))
    j = p.join(c, [*[p[k] == c[k] for k in keys], p["r.target"] == c["_target"], p["primary_id"] != c["region_id"]])
    j = j.where(bx.in_direction(bx.Box.of(), bx.Box.of("p_"), F.col("r.direction")))
    best = j.groupBy(*[p[k] for k in keys], "primary_id", "rule", F.col("r.role").alias("role")).agg(F.min_by("region_id", F.struct(-F.col("score"), "region_id")).alias("region_id"))
    return best


def greedy_neighbours(primaries: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Rules in order, each taking its best unseen candidate; one list a primary, best score first.

    The choice is sequential within a page, so a page's regions (a few dozen) are folded in one expression.
    primaries may carry hints: an array of types or roles whose candidates count half as much again.
    """
    fields = ("region_id", "region_type", "score", "x0", "y0", "x1", "y1")
    have_hints = "hints" in primaries.columns
    pages = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_c"))
    j = primaries.join(pages, keys).withColumn("_rules", rules_for(F.col("region_type"), F.col("figure_class") if "figure_class" in primaries.columns else F.lit(None).cast("string")))
    hints = F.transform("hints", F.lower) if have_hints else F.array().cast("array<string>")
    kind = "array<struct<region_id:bigint,role:string,score:double>>"
    prim = bx.Box.of()

    def step(acc: Column, rule: Column) -> Column:
        boost = F.when(F.array_contains(hints, F.lower(rule["role"])) | F.array_contains(hints, rule["target"]), HINT_BOOST).otherwise(1.0)
        fit = F.filter("_c", lambda c: (c["region_id"] != F.col("primary_id")) & ~F.exists(acc, lambda s: s["region_id"] == c["region_id"]) & (F.lower(c["region_type"]) == rule["target"]) & bx.in_direction(bx.Box.item(c), prim, rule["direction"]))
        best = F.array_min(F.transform(fit, lambda c: F.struct((-c["score"] * boost).alias("s"), c["region_id"].alias("region_id"))))
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(best["region_id"].alias("region_id"), rule["role"].alias("role"), (-best["s"]).alias("score")))))

    found = F.aggregate("_rules", F.array().cast(kind), step)
    return j.select(*keys, "primary_id", F.explode(found).alias("n")).select(*keys, "primary_id", "n.region_id", "n.role", "n.score")


def within_budget(ranked: DataFrame, by: list[str], packet: str, rank: str, per_packet: int = 2, total: int = 6) -> DataFrame:
    """The first per_packet links of each packet and, over packets in order, at most total of a group."""
    w = Window.partitionBy(*by).orderBy(packet, rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.where(F.col(rank) <= per_packet).withColumn("used", F.count(F.lit(1)).over(w)).where(F.col("used") <= total)


def majority(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """by, n, winner: the value that more than half of at least three samples have (its first spelling), else null."""
    key = F.lower(F.regexp_replace(F.trim(F.coalesce(F.col(value), F.lit(""))), r"\s+", " "))
    votes = df.withColumn("_k", key).groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("v"), F.min_by(value, F.struct(*order)).alias("w"))
    return votes.groupBy(*by).agg(F.sum("v").alias("n"), F.max_by("w", "v").alias("w"), F.max("v").alias("top")).select(*by, "n", F.when((F.col("n") >= 3) & (F.col("top") * 2 > F.col("n")), F.col("w")).alias("winner"))


def best_answer(df: DataFrame, by: list[str], answer: str, citations: str, confidence: str, index: str) -> DataFrame:
    """The sample that is answerable, most cited, shortest, most confident, first."""
    gone = F.lower(F.trim(F.coalesce(F.col(answer), F.lit("")))).isin("", "unanswerable", "unknown")
    key = F.struct(gone, -F.col(citations), F.length(F.coalesce(answer, F.lit(""))), -F.col(confidence), index)
    return df.groupBy(*by).agg(F.min_by(F.struct(answer, index), key).alias("b")).select(*by, f"b.{answer}", f"b.{index}")


def line_overlap(texts: DataFrame, queries: DataFrame, keys: list[str], text: str, question: str, k: int = 6) -> DataFrame:
    """The k lines of each text that share most words with the question it is paired with: keys, line, overlap, rank."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]{3,})"), F.lit(1)))
    j = texts.join(queries, keys).withColumn("_q", words(F.col(question)))
    lines = j.select(*keys, "_q", F.posexplode(F.split(text, "\n")).alias("line", "_l")).withColumn("overlap", F.size(F.array_intersect(words(F.col("_l")), "_q"))).where("overlap > 0")
    return top_n(lines, keys, [F.desc("overlap"), F.col("line")], k).select(*keys, "line", "overlap", "rank")
