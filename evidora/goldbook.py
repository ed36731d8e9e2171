"""Queries of gold data and request keys, with their DuckDB SQL: rows are made of table columns, and the SQL states every rule again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as cat
from .operators import diagnosis as dg
from .sources import calls
from .sources import views as vw

query, r6, _pick, _sql_pick = cat.query, cat.r6, vw.pick, vw.sql_pick

QUESTIONS = ("What is the voltage in volts?", "Estimate the value, ± 0.5 allowed", "How many rows are there?", " ", "What ratio of A to B holds?", "Provide the gain, the offset and delay", "Approximately what value is read? +/- 2", "Which entry is named?")
ANSWERS = ("12,345.5", "0x1F", "VDD - 3", "3 to -5", "x = 2 and y = 4", "a ratio of 3 and 4", "It moved from 3 by about 1,250 V", "Unanswerable", "", "No. 7, then 9", "41", "It cannot be determined.")
KINDS = ("AnswerType.NUMERIC", "numeric", "exact_match", "multiple_choice", "boolean", "AnswerType.UNANSWERABLE", "odd")
UNITS, SPLITS, STRESS, TOLERANCES = ("V", "mV", "hex", "a, b", "%", ""), ("train", "test"), ("none", "crop", ""), ("0", "0.5", "-1", "2", "0.25")
PAGES, IMAGES = ([], [1], [1, 2], [0], [3, 3]), ([], [(100, 200)], [(100, 200), (0, 50)], [(100, 200), None])


def gold_rows(spark, sf_dir) -> DataFrame:
    """One row of gold an order."""
    o = vw.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pages = F.array(*[F.array(*[F.lit(p) for p in x]).cast("array<int>") for x in PAGES])
    image = lambda x: F.lit(None).cast("struct<width:int,height:int>") if x is None else F.struct(F.lit(x[0]).alias("width"), F.lit(x[1]).alias("height"))
    images = F.array(*[F.array(*[image(i) for i in x]).cast("array<struct<width:int,height:int>>") for x in IMAGES])
    at = lambda xs, n, size: F.element_at(xs, (n % size + 1).cast("int"))
    return o.select(
        F.when(k % 97 == 0, "").otherwise(F.concat(F.lit("g"), k.cast("string"))).alias("id"), k.alias("row"), _pick(SPLITS, k).alias("split"), _pick((*SPLITS, ""), c).alias("expected_split"), _pick(QUESTIONS, c).alias("question"), _pick(ANSWERS, k).alias("answer"), _pick(KINDS, k + c).alias("answer_type"),
        _pick(UNITS, c).alias("answer_unit"), F.when(k % 6 > 0, _pick(TOLERANCES, k).cast("double")).alias("tolerance"), at(pages, c, len(PAGES)).alias("supporting_pages"), at(images, c, len(IMAGES)).alias("page_images"), (c % 3).cast("int").alias("n_bboxes"), (k % 4 == 0).alias("multi_region_required"),
        (k % 3).cast("int").alias("evidence_relations"), (k % 2).cast("int").alias("evidence_page_spread"), _pick(STRESS, c).alias("stress_type"),
    )


_IMAGE = lambda x: "NULL" if x is None else f"{{'w': {x[0]}, 'h': {x[1]}}}"
_ROWS = f"""(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE 'g' || o_orderkey END AS id, {_sql_pick(SPLITS, 'o_orderkey')} AS split, {_sql_pick((*SPLITS, ''), 'o_custkey')} AS expected, trim({_sql_pick(QUESTIONS, 'o_custkey')}) AS q, {_sql_pick(ANSWERS, 'o_orderkey')} AS a, {_sql_pick(KINDS, '(o_orderkey + o_custkey)')} AS typ,
  {_sql_pick(UNITS, 'o_custkey')} AS unit, CASE WHEN o_orderkey % 6 > 0 THEN {_sql_pick(TOLERANCES, 'o_orderkey')}::DOUBLE END AS tol, {repr(list(PAGES))}[(o_custkey % {len(PAGES)} + 1)::INT] AS pages, [{', '.join('[' + ', '.join(_IMAGE(i) for i in x) + ']' for x in IMAGES)}][(o_custkey % {len(IMAGES)} + 1)::INT] AS images, o_custkey % 3 AS boxes, o_orderkey % 4 = 0 AS multi,
  o_orderkey % 3 AS relations, o_orderkey % 2 AS spread, {_sql_pick(STRESS, 'o_custkey')} AS stress FROM orders)"""
_NUMBER = r"(-?\d+(?:,\d{3})*(?:\.\d+)?)"
_ABSTAINS = "(" + " OR ".join(f"contains(lower(a), '{w}')" for w in dg.ABSTAIN_WORDS) + ")"
_ESTIMATE = f"regexp_matches(q, '{dg.ESTIMATE_WORDS}')"
_FORMS = rf"""CASE WHEN regexp_matches(a, '0x[0-9A-Fa-f]+') OR contains(lower(unit), 'hex') THEN 'numeric_hex_answer' WHEN regexp_matches(a, '^[A-Za-z_]\w*\s*[-+*/]\s*\d') THEN 'numeric_symbolic_expression_answer' WHEN regexp_matches(a, '(?i)\d\s+to\s+-?\d') THEN 'numeric_range_answer'
  WHEN contains(a, '=') AND len(nums) > 1 THEN 'numeric_formula_answer' WHEN contains(lower(q), 'ratio') AND contains(lower(a), 'ratio') AND len(nums) > 1 THEN 'numeric_ratio_prose_answer' WHEN len(nums) > 1 AND moved <> '' AND moved <> nums[1] THEN 'numeric_prose_prefix_answer'
  WHEN len(nums) > 1 AND (contains(unit, ',') OR regexp_matches(lower(q), '\bprovide the .*, .* and\b') OR contains(lower(q), 'and what is the approximate')) THEN 'numeric_multi_field_answer' END"""
_RULES = [
    ("empty_id", "id = ''"), ("empty_question", "q = ''"), ("empty_answer", "a = ''"), ("invalid_answer_type", "kind NOT IN ('numeric', 'exact_match', 'multiple_choice', 'boolean', 'unanswerable')"), ("split_mapping_mismatch", "expected <> '' AND split <> expected"), ("no_supporting_pages", "len(pages) = 0"),
    ("invalid_supporting_page", "len(list_filter(pages, lambda p: p < 1)) > 0"), ("no_page_images", "len(images) = 0"), ("malformed_page_image", "len(list_filter(images, lambda i: i IS NULL)) > 0"), ("invalid_page_image_dims", "len(list_filter(images, lambda i: i IS NOT NULL AND NOT (i.w > 0 AND i.h > 0))) > 0"),
    ("page_image_supporting_page_count_mismatch", "len(images) <> len(pages)"), ("no_supporting_bboxes", "boxes = 0"), ("numeric_answer_unparseable", "num AND len(nums) = 0"), ("numeric_missing_tolerance", "num AND tol IS NULL"), ("invalid_tolerance", "num AND tol < 0"), ("estimate_with_zero_tolerance", f"num AND tol = 0 AND {_ESTIMATE}"),
    ("tolerance_mismatch", f"num AND tol >= 0 AND NOT (tol = 0 AND {_ESTIMATE}) AND abs(tol - stated) > 1e-9"), ("answer_unit_mismatch", r"num AND regexp_matches(lower(q), '\b(in|how many) volts?\b') AND regexp_replace(lower(unit), '[^a-z%]', '', 'g') <> '' AND regexp_replace(lower(unit), '[^a-z%]', '', 'g') NOT LIKE 'v%'"),
    *[(code, f"num AND form = '{code}'") for code in ("numeric_hex_answer", "numeric_symbolic_expression_answer", "numeric_range_answer", "numeric_formula_answer", "numeric_ratio_prose_answer", "numeric_prose_prefix_answer", "numeric_multi_field_answer")],
    ("non_numeric_tolerance", "kind IN ('exact_match', 'multiple_choice', 'boolean') AND tol IS NOT NULL"), ("numeric_wording_with_non_numeric_type", r"kind = 'exact_match' AND regexp_matches(lower(q), '^(how many|how much)\b') AND regexp_matches(a, '^-?\d[\d,.]*$')"),
    ("unanswerable_answer_not_abstain", f"kind = 'unanswerable' AND a <> '' AND NOT {_ABSTAINS}"), ("answer_abstains_but_type_answerable", f"kind <> 'unanswerable' AND {_ABSTAINS}"), ("multi_region_without_multiple_bboxes", "multi AND boxes < 2"), ("multi_region_without_relations", "multi AND relations = 0"),
    ("spread_without_multi_page_support", "spread > 0 AND len(list_distinct(pages)) < 2"), ("stress_variant", "stress NOT IN ('', 'none')"),
]
_AUDITED = rf"""WITH r AS {_ROWS}, t AS (SELECT *, lower(list_last(string_split(typ, '.'))) AS kind, list_transform(regexp_extract_all(a, '{_NUMBER}'), lambda x: replace(x, ',', '')) AS nums, TRY_CAST(regexp_extract(q, '(?:±|\+/-)\s*(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS stated,
  replace(regexp_extract(a, '(?i)\bby\s+(?:approximately\s+|about\s+)?{_NUMBER}\b', 1), ',', '') AS moved FROM r), f AS (SELECT *, kind = 'numeric' AS num, {_FORMS} AS form FROM t),
i AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {test} THEN '{code}' END" for code, test in _RULES)}], lambda x: x IS NOT NULL) AS issues FROM f),
e AS (SELECT *, list_filter(issues, lambda x: NOT list_contains({list(dg.WARNINGS + dg.NOTES)!r}, x)) AS errors FROM i), g AS (SELECT *, CASE WHEN len(errors) = 0 THEN 'publishable' WHEN list_has_any(errors, {list(dg.REMOVING)!r}) THEN 'remove' ELSE 'fix_required' END AS status FROM e)"""


@query(f"{_AUDITED} SELECT id AS example_id, array_to_string(issues, ' ') AS issues, status FROM g")
def gold_rule_audit(spark, sf_dir):
    return dg.gold_rules(gold_rows(spark, sf_dir)).withColumn("issues", F.array_join("issues", " "))


@query(f"{_AUDITED} SELECT status, count(*) AS n, sum(len(errors))::BIGINT AS errors, sum(len(list_filter(issues, lambda x: list_contains({list(dg.WARNINGS)!r}, x))))::BIGINT AS warnings, sum(len(list_filter(issues, lambda x: list_contains({list(dg.NOTES)!r}, x))))::BIGINT AS notes FROM g GROUP BY status")
def gold_rule_counts(spark, sf_dir):
    return dg.audit_counts(dg.gold_rules(gold_rows(spark, sf_dir)), "status")


@query(f"SELECT id AS example_id, a AS gold_answer, typ AS answer_type, unit AS answer_unit, round(tol, 6) AS tolerance, '[' || array_to_string(pages, ',') || ']' AS pages, len(list_filter(images, lambda i: i IS NOT NULL)) AS n_images, (images[1]).w::BIGINT AS first_width FROM {_ROWS}")
def gold_review_payloads(spark, sf_dir):
    """What a reviewer gets, read back from its JSON."""
    p = dg.review_payload(gold_rows(spark, sf_dir))
    get = lambda path: F.get_json_object("payload", path)
    images = F.from_json(get("$.page_images"), "array<struct<index:int,width:int,height:int>>")
    return r6(p.select("example_id", get("$.gold_answer").alias("gold_answer"), get("$.answer_type").alias("answer_type"), get("$.answer_unit").alias("answer_unit"), get("$.tolerance").cast("double").alias("tolerance"), get("$.supporting_pages").alias("pages"), F.size(images).cast("long").alias("n_images"), F.get(images, 0)["width"].cast("long").alias("first_width")))


@query("""SELECT event_id, sha256('{"m":[' || event_id || ',{"a":"' || event_type || '","u":' || user_id || '},[]],"z":{"k":' || json_extract_string(props, '$.k') || ',"nothing":null}}') AS key FROM events""")
def nested_request_keys(spark, sf_dir):
    """Keys of requests whose objects are spelled in another order, with blanks."""
    e = vw.table(spark, sf_dir, "events")
    body = F.format_string('{"z": {"nothing": null, "k": %s}, "m": [%d, {"u": %d, "a": "%s"}, [ ]]}', F.get_json_object("props", "$.k"), "event_id", "user_id", "event_type")
    return e.select("event_id", calls.request_key(body).alias("key"))
