"""Tolerant parsing of recorded model responses: JSON in fences or prose -> typed columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a rerank entry may ask for.
NEEDED_FOR = ("primary", "legend_binding", "axis_reading", "caption_context", "footnote_adjustment", "table_cell_lookup", "header_disambiguation")
HINTS = ("legend", "caption", "x_axis", "y_axis", "title", "footnote", "unit", "row_header", "column_header", "continuation")
BUDGETS = ("easy_local", "multi_region", "highres_tiny", "cross_page")
ROUTES = ("text_first", "visual_first", "hybrid", "all_pages")


def json_part(text: Column) -> Column:
    """The fenced block, else the outermost braces or brackets; null if there are none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(fenced != "", F.trim(fenced)).when(braces != "", braces)


def rerank_entries(text: Column) -> Column:
    """[{region_id, relevance, needed_for, hints}] with relevance clamped to [0, 1], unknown roles and hints dropped."""
    body = json_part(text)
    body = F.when(body.startswith("["), body).otherwise(F.coalesce(F.get_json_object(body, "$.regions"), F.get_json_object(body, "$.entries"), F.concat(F.lit("["), body, F.lit("]"))))
    rows = F.from_json(body, "array<struct<region_id:string,relevance:double,needed_for:string,missing_context:array<string>>>")
    one = lambda r: F.struct(
        r["region_id"].alias("region_id"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["relevance"])).alias("relevance"),
        F.when(r["needed_for"].isin(*NEEDED_FOR), r["needed_for"]).alias("needed_for"),
        F.array_distinct(F.filter(F.coalesce(r["missing_context"], F.array().cast("array<string>")), lambda h: h.isin(*HINTS))).alias("hints"),
    )
    return F.transform(F.filter(rows, lambda r: r["region_id"].isNotNull() & r["relevance"].isNotNull()), one)


def plan(text: Column) -> Column:
    """A plan; invalid fields fall back to unknown, [text, image], easy_local and hybrid."""
    p = F.from_json(json_part(text), "struct<question_family:string,evidence_types:array<string>,budget_class:string,routing_policy:string>")
    types = p["evidence_types"]
    return F.struct(
        F.coalesce(p["question_family"], F.lit("unknown")).alias("question_family"),
        F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("text"), F.lit("image"))).alias("evidence_types"),
        F.when(p["budget_class"].isin(*BUDGETS), p["budget_class"]).otherwise("easy_local").alias("budget_class"),
        F.when(p["routing_policy"].isin(*ROUTES), p["routing_policy"]).otherwise("hybrid").alias("routing_policy"),
    )


def simple_answer(text: Column) -> Column:
    """{answer, citations} of a single-shot response; text that is no JSON object is the answer itself, and citations without a page and four numbers fall out."""
    body = json_part(text)
    a = F.from_json(body, "struct<answer:string,citations:array<struct<page:string,bbox:string>>>")
    cited = F.transform(F.coalesce(a["citations"], F.array().cast("array<struct<page:string,bbox:string>>")), lambda c: F.struct(c["page"].try_cast("int").alias("page"), F.from_json(c["bbox"], "array<double>").alias("bbox")))
    good = F.filter(cited, lambda c: c["page"].isNotNull() & (F.size(c["bbox"]) == 4) & ~F.exists(c["bbox"], lambda x: x.isNull()))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False))
    return F.struct(F.when(is_object, F.coalesce(a["answer"], F.lit(""))).otherwise(F.trim(F.coalesce(text, F.lit("")))).alias("answer"), F.when(is_object, good).otherwise(F.array().cast("array<struct<page:int,bbox:array<double>>>")).alias("citations"))


def structured_region(text: Column) -> Column:
    """{region_kind, headers, units, candidate_rows, key_values, checkboxes, notes, confidence}: lists cleaned, each text once, confidence in [0, 1]."""
    lists = ("headers", "units", "candidate_rows", "key_values", "checkboxes", "notes")
    r = F.from_json(json_part(text), "struct<region_kind:string,confidence:string," + ",".join(f"{c}:string" for c in lists) + ">")
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    items = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.from_json(r[c], "array<string>"), F.array().cast("array<string>")), clean), lambda x: x != ""))
    kind = clean(r["region_kind"])
    return F.struct(F.when(kind != "", kind).otherwise("unknown").alias("region_kind"), *[items(c).alias(c) for c in lists], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence"))


def answer(text: Column, packet_ids: Column) -> Column:
    """{answer, citations, confidence}: plain text is the answer itself; citations of unknown packets are dropped."""
    a = F.from_json(json_part(text), "struct<answer:string,citations:array<string>,confidence:double>")
    return F.struct(
        F.coalesce(a["answer"], F.trim(text)).alias("answer"),
        F.array_intersect(F.coalesce(a["citations"], F.array().cast("array<string>")), packet_ids).alias("citations"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["confidence"], F.lit(0.5)))).alias("confidence"),
    )


def turn(text: Column) -> Column:
    """A tool-loop turn: {tool, input, final}; a turn that is no tool call is final."""
    t = F.from_json(json_part(text), "struct<action:string,action_input:string,final_answer:string>")
    is_tool = t["action"].isNotNull() & (t["action"] != "final_answer")
    return F.struct(F.when(is_tool, t["action"]).alias("tool"), F.when(is_tool, t["action_input"]).alias("input"), F.when(~F.coalesce(is_tool, F.lit(False)), F.coalesce(t["final_answer"], t["action_input"], F.trim(text))).alias("final"))


def crop_plan(text: Column, n_candidates: Column, scores: Column | None = None, n: int = 3) -> Column:
    """[{region_idx, mode}] with indices in range; without any the n regions of the best scores, whole, if scores are given."""
    rows = F.from_json(json_part(text), "array<struct<region_idx:int,mode:string>>")
    good = F.filter(F.coalesce(rows, F.array().cast("array<struct<region_idx:int,mode:string>>")), lambda r: (r["region_idx"] >= 0) & (r["region_idx"] < n_candidates))
    if scores is None:
        return good
    ranked = F.slice(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))), 1, n)
    return F.when(F.size(good) > 0, good).otherwise(F.transform(ranked, lambda r: F.struct(r["i"].alias("region_idx"), F.lit("full").alias("mode"))))


def json_list_issue(text: Column) -> Column:
    """'invalid_json' or 'not_a_list' for a non-empty text that is no JSON list, else null."""
    body = F.trim(text)
    value = F.try_parse_json(body)
    return F.when(body.isNull() | (body == ""), None).when(value.isNull(), "invalid_json").when(~F.schema_of_variant(value).startswith("ARRAY"), "not_a_list")


def shape(text: Column) -> Column:
    """The sorted keys of a JSON object with their types, as one text."""
    return F.schema_of_variant(F.try_parse_json(text))


def metric_paths(df, json_column: str, *keep: str, depth: int = 4):
    """Long form of nested JSON: keep..., path, value for every numeric leaf down to depth levels."""
    level = df.select(*keep, F.lit("").alias("path"), F.try_parse_json(json_column).alias("v")).where("v is not null")
    out = None
    for _ in range(depth):
        kids = _explode(level, keep)
        leaf = kids.where(F.schema_of_variant("v").isin("BIGINT", "DOUBLE") | F.schema_of_variant("v").startswith("DECIMAL")).select(*keep, "path", F.expr("variant_get(v, '$', 'double')").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        level = kids.where(F.schema_of_variant("v").startswith("OBJECT"))
    return out


def _explode(level, keep):
    view = f"level_{uuid.uuid4().hex}"  # a name of its own: callers may run at the same time
    level.createOrReplaceTempView(view)
    names = "".join(f"l.{k}, " for k in keep)
    out = level.sparkSession.sql(f"SELECT {names} CASE WHEN l.path = '' THEN e.key ELSE concat(l.path, '.', e.key) END AS path, e.value AS v FROM {view} l, LATERAL variant_explode(l.v) e WHERE e.key IS NOT NULL")
    level.sparkSession.catalog.dropTempView(view)
    return out
