"""Failure classes, run diagnosis, gold audit and export filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import squeeze


def failure_reason(is_lazy: Column, n_citations: Column, region_recall: Column, bbox_iou: Column, answer: Column, terminated: Column, image_only: Column, supported: Column) -> Column:
    """The first of eight classes that a wrong answer falls into."""
    return (
        F.when(is_lazy == 1, "lazy_or_no_bbox")
        .when(n_citations == 0, "empty_citation")
        .when(region_recall <= 0, "localization_miss")
        .when(region_recall < 1, "partial_localization")
        .when(region_recall.isNull() & (bbox_iou <= 0.1), "localization_miss")
        .when((F.lower(F.trim(answer)) == "unanswerable") | (terminated == "abstained"), "abstained")
        .when(image_only, "cited_image_only")
        .when(supported == F.lit(False), "verifier_unsupported")
        .otherwise("reasoning_or_extraction")
    )


def taxonomy(wrong: DataFrame, reason: str = "reason", domain: str = "domain", domains: tuple[str, ...] = (), example: str = "example_id", examples: int = 3) -> DataFrame:
    """reason, total, a count for each domain given, and the least examples."""
    counts = [F.count_if(F.col(domain) == d).alias(f"n_{d}") for d in domains]
    ranked = wrong.withColumn("_r", F.row_number().over(Window.partitionBy(reason).orderBy(example)))
    return ranked.groupBy(reason).agg(F.count(F.lit(1)).alias("total"), *counts, F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.lpad(F.col(example).cast("string"), 20, "0")))), ",").alias("examples"))


def qualitative(correct: Column, answer: Column, gold: Column, page_recall: Column, bbox_iou: Column, n_citations: Column, is_lazy: Column) -> Column:
    """One of nine outcome labels of a record."""
    p, g = F.lower(squeeze(answer)), F.lower(squeeze(gold))
    low = F.lower(answer)
    raw = low.contains("action_input") | low.contains("final_answer") | low.contains("```json") | low.contains('"action"')
    ok = correct >= 1
    return (
        F.when(~ok & (low == "unanswerable"), "unanswerable")
        .when(raw, "raw tool transcript / invalid final")
        .when(~ok, "wrong answer")
        .when((p != g) & ~p.contains(g), "scorer accepted non-exact answer")
        .when((n_citations == 0) | (is_lazy == 1) | (page_recall == 0), "correct answer without grounded evidence")
        .when(p != g, "scorer accepted non-exact answer")
        .when(page_recall < 1, "correct answer with incomplete page grounding")
        .when(bbox_iou < 0.8, "correct answer with weak region grounding")
        .otherwise("grounded correct")
    )


def transient_error(error: Column) -> Column:
    return F.coalesce(F.lower(error).rlike(r"429|500|502|503|504|timeout|timed out|overloaded|rate.?limit|connection (?:reset|aborted)|temporarily unavailable"), F.lit(False))


def export_filter(correct: Column, coverage: Column, iou: Column, min_coverage: float = 0.8, min_iou: float = 0.3, require_correct: bool = True) -> Column:
    good = (F.coalesce(coverage, F.lit(0.0)) >= min_coverage) & (F.coalesce(iou, F.lit(0.0)) >= min_iou)
    return good & (F.coalesce(correct, F.lit(0.0)) >= 1) if require_correct else good


def diagnose(df: DataFrame, by: str = "run") -> DataFrame:
    """One wide row a run: counts, rates with null denominators, means."""
    n, wrong = F.count(F.lit(1)), F.count_if(F.col("answer_correct") < 1)
    return df.groupBy(by).agg(
        n.alias("n"), wrong.alias("n_wrong"), F.avg("answer_correct").alias("accuracy"), F.avg("is_lazy").alias("lazy_rate"),
        F.avg("tool_calls").alias("tool_calls_mean"), F.max("tool_calls").alias("tool_calls_max"),
        F.try_divide(F.count_if((F.col("answer_correct") < 1) & (F.col("bbox_iou") <= 0.1)), wrong).alias("wrong_without_region_rate"),
        F.try_divide(F.count_if((F.col("answer_correct") >= 1) & (F.col("is_lazy") == 1)), F.count_if(F.col("answer_correct") >= 1)).alias("lazy_correct_rate"),
        F.count_if(F.col("page_recall") == 0).alias("pages_missed"), F.avg("latency_ms").alias("latency_ms_mean"),
    )


# Answer types, issue codes by severity, and the codes for which a row is taken out.
ANSWER_TYPES = ("numeric", "exact_match", "multiple_choice", "boolean", "unanswerable")
WARNINGS = ("page_image_supporting_page_count_mismatch", "numeric_missing_tolerance", "non_numeric_tolerance", "multi_region_without_relations", "spread_without_multi_page_support")
NOTES = ("stress_variant",)
REMOVING = ("empty_question", "empty_answer", "no_page_images", "no_supporting_bboxes")
ABSTAIN_WORDS = ("unanswerable", "cannot be determined", "not enough information")
ESTIMATE_WORDS = r"(?i)\b(?:estimate|estimated|approximately|approx|nearest)\b|\binterpolat|±|\+/-"
NUMBER_TOKEN = r"(-?\d+(?:,\d{3})*(?:\.\d+)?)"


def number_tokens(text: Column) -> Column:
    """Numbers of a text, without thousands separators."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER_TOKEN), F.lit(1)), lambda x: F.regexp_replace(x, ",", ""))


def last_hex(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(0x[0-9A-Fa-f]+)"), F.lit(1)), F.lit(-1))


def number_after_equals(text: Column) -> Column:
    return F.try_element_at(number_tokens(F.element_at(F.split(F.coalesce(text, F.lit("")), "="), -1)), F.lit(-1))


def gold_rules(df: DataFrame) -> DataFrame:
    """example_id, issues, status of rows of gold: id, split, expected_split, question, answer, answer_type, answer_unit, tolerance, supporting_pages,
    supporting_bboxes, page_images [{width, height}], multi_region_required, evidence_relations (a count), evidence_page_spread, stress_type."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    q, gold, kind = text("question"), text("answer"), F.lower(F.element_at(F.split(text("answer_type"), r"\."), -1))
    unit, tolerance = F.lower(text("answer_unit")), F.col("tolerance")
    tokens, pages = number_tokens(gold), F.coalesce("supporting_pages", F.array().cast("array<int>"))
    images = F.coalesce("page_images", F.array().cast("array<struct<width:int,height:int>>"))
    boxes = F.col("n_bboxes")
    numeric = kind == "numeric"
    stated = F.regexp_extract(q, r"(?:±|\+/-)\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    abstains = reduce(lambda a, b: a | b, [F.lower(gold).contains(w) for w in ABSTAIN_WORDS])
    low = F.lower(q)
    by_value = F.regexp_replace(F.regexp_extract(gold, rf"(?i)\bby\s+(?:approximately\s+|about\s+)?{NUMBER_TOKEN}\b", 1), ",", "")
    forms = [  # what a numeric answer should not be: the first that holds
        ("numeric_hex_answer", last_hex(gold).isNotNull() | unit.contains("hex")),
        ("numeric_symbolic_expression_answer", gold.rlike(r"^[A-Za-z_]\w*\s*[-+*/]\s*\d")),
        ("numeric_range_answer", gold.rlike(r"(?i)\d\s+to\s+-?\d")),
        ("numeric_formula_answer", gold.contains("=") & (F.size(tokens) > 1)),
        ("numeric_ratio_prose_answer", low.contains("ratio") & F.lower(gold).contains("ratio") & (F.size(tokens) > 1)),
        ("numeric_prose_prefix_answer", (F.size(tokens) > 1) & (by_value != "") & (by_value != F.get(tokens, 0))),
        ("numeric_multi_field_answer", (F.size(tokens) > 1) & (unit.contains(",") | low.rlike(r"\bprovide the .*, .* and\b") | low.contains("and what is the approximate"))),
    ]
    form = F.coalesce(*[F.when(t, code) for code, t in forms])
    rules = [
        ("empty_id", text("id") == ""), ("empty_question", q == ""), ("empty_answer", gold == ""), ("invalid_answer_type", ~kind.isin(*ANSWER_TYPES)),
        ("split_mapping_mismatch", (text("expected_split") != "") & (F.col("split") != F.col("expected_split"))), ("no_supporting_pages", F.size(pages) == 0),
        ("invalid_supporting_page", F.exists(pages, lambda p: p.isNull() | (p < 1))), ("no_page_images", F.size(images) == 0), ("malformed_page_image", F.exists(images, lambda i: i.isNull())),
        ("invalid_page_image_dims", F.exists(images, lambda i: i.isNotNull() & ~F.coalesce((i["width"] > 0) & (i["height"] > 0), F.lit(False)))),
        ("page_image_supporting_page_count_mismatch", F.size(images) != F.size(pages)), ("no_supporting_bboxes", boxes == 0),
        ("numeric_answer_unparseable", numeric & (F.size(tokens) == 0)), ("numeric_missing_tolerance", numeric & tolerance.isNull()), ("invalid_tolerance", numeric & (tolerance < 0)),
        ("estimate_with_zero_tolerance", numeric & (tolerance == 0) & q.rlike(ESTIMATE_WORDS)),
        ("tolerance_mismatch", numeric & (tolerance >= 0) & ~((tolerance == 0) & q.rlike(ESTIMATE_WORDS)) & (F.abs(tolerance - stated) > 1e-9)),
        ("answer_unit_mismatch", numeric & low.rlike(r"\b(?:in|how many) volts?\b") & (F.regexp_replace(unit, "[^a-z%]", "") != "") & ~F.regexp_replace(unit, "[^a-z%]", "").startswith("v")),
        *[(code, numeric & (form == code)) for code, _ in forms],
        ("non_numeric_tolerance", kind.isin("exact_match", "multiple_choice", "boolean") & tolerance.isNotNull()),
        ("numeric_wording_with_non_numeric_type", (kind == "exact_match") & low.rlike(r"^(?:how many|how much)\b") & gold.rlike(r"^-?\d[\d,.]*$")),
        ("unanswerable_answer_not_abstain", (kind == "unanswerable") & (gold != "") & ~abstains), ("answer_abstains_but_type_answerable", (kind != "unanswerable") & abstains),
        ("multi_region_without_multiple_bboxes", F.col("multi_region_required") & (boxes < 2)), ("multi_region_without_relations", F.col("multi_region_required") & (F.col("evidence_relations") == 0)),
        ("spread_without_multi_page_support", (F.coalesce("evidence_page_spread", F.lit(0)) > 0) & (F.size(F.array_distinct(pages)) < 2)), ("stress_variant", ~F.lower(text("stress_type")).isin("", "none")),
    ]
    issues = F.filter(F.array(*[F.when(t, code) for code, t in rules]), lambda x: x.isNotNull())
    return df.select(F.col("id").alias("example_id"), issues.alias("issues")).withColumn("status", rule_status(F.col("issues")))


def severity(code: Column) -> Column:
    return F.when(code.isin(*WARNINGS), "warning").when(code.isin(*NOTES), "info").otherwise("error")


def rule_status(issues: Column) -> Column:
    """publishable without errors; remove for errors that leave nothing to mend; else fix_required."""
    errors = F.filter(issues, lambda x: ~x.isin(*WARNINGS, *NOTES))
    return F.when(F.size(errors) == 0, "publishable").when(F.arrays_overlap(errors, F.array(*[F.lit(x) for x in REMOVING])), "remove").otherwise("fix_required")


def audit_counts(audited: DataFrame, *by: str) -> DataFrame:
    """n rows and n issues by any keys (split, domain, type, status), and of each severity."""
    of = lambda s: F.sum(F.size(F.filter("issues", lambda x: severity(x) == s)))
    return audited.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("notes"))


def review_payload(df: DataFrame) -> DataFrame:
    """example_id and what a reviewer needs of a row of gold, as JSON: texts, type, unit, tolerance, pages, and images with their index and size."""
    images = F.transform(F.filter(F.coalesce("page_images", F.array().cast("array<struct<width:int,height:int>>")), lambda i: i.isNotNull()), lambda i, k: F.struct(k.alias("index"), i["width"].alias("width"), i["height"].alias("height")))
    body = F.struct(F.col("id"), F.col("split"), F.col("question"), F.col("answer").alias("gold_answer"), "answer_type", "answer_unit", "tolerance", F.coalesce("supporting_pages", F.array().cast("array<int>")).alias("supporting_pages"), images.alias("page_images"))
    return df.select(F.col("id").alias("example_id"), F.to_json(body).alias("payload"))


def gold_issues(df: DataFrame) -> DataFrame:
    """example_id and its issue codes, from rules over one row of gold (example_id, answer_type, gold, tolerance)."""
    kind = F.lower(F.element_at(F.split("answer_type", r"\."), -1))
    gold = F.coalesce("gold", F.lit(""))
    rules = (
        ("empty_answer", gold == ""),
        ("unknown_type", ~kind.isin(*ANSWER_TYPES)),
        ("numeric_without_number", (kind == "numeric") & ~gold.rlike(r"\d")),
        ("numeric_without_tolerance", (kind == "numeric") & F.col("tolerance").isNull()),
        ("boolean_not_boolean", (kind == "boolean") & ~F.lower(gold).rlike(r"^(yes|no|true|false)\b")),
        ("choice_without_letter", (kind == "multiple_choice") & ~gold.rlike(r"^[A-E]$")),
        ("explanation_in_answer", (kind == "exact_match") & gold.contains(";")),
        ("long_answer", F.length(gold) > 80),
    )
    issues = F.filter(F.array(*[F.when(t, code) for code, t in rules]), lambda x: x.isNotNull())
    return df.select("example_id", issues.alias("issues"))


#: Codes that keep a row from publication; others only warn.
ERROR_CODES = ("empty_answer", "unknown_type", "numeric_without_number", "boolean_not_boolean", "choice_without_letter")


def issue_status(issues: Column) -> Column:
    bad = F.arrays_overlap(issues, F.array(*[F.lit(x) for x in ERROR_CODES]))
    return F.when(F.array_contains(issues, "empty_answer"), "remove").when(bad, "fix_required").otherwise("publishable")


# ---- whole runs from their traces


def trace_facts(records: DataFrame, *keep: str) -> DataFrame:
    """keep and one row a record: what its steps tell of tools, errors, verdicts and context. No step leaves its record."""
    steps = F.coalesce("trace.steps", F.array())
    of = lambda test: F.filter(steps, test)
    n = lambda test: F.size(of(test))
    act = lambda s: F.coalesce(s["action"], F.lit(""))
    arg = lambda s, path: F.get_json_object(s["args"], path)
    verdicts = F.filter(F.transform(of(lambda s: s["stage"] == "verify"), lambda s: arg(s, "$.supported").try_cast("boolean")), lambda v: v.isNotNull())
    actions = F.filter(F.transform(of(lambda s: s["stage"] == "verify"), lambda s: arg(s, "$.next_action")), lambda v: v.isNotNull())
    used = F.transform(of(lambda s: (act(s).isin("tool_call", "tool_error") & s["tool"].isNotNull()) | ((s["stage"] == "expand_context") & (act(s) != "passthrough"))), lambda s: F.when(s["stage"] == "expand_context", "expand_context").otherwise(s["tool"]))
    added = lambda path: F.aggregate(of(lambda s: s["stage"] == "expand_context"), F.lit(0), lambda a, s: a + F.coalesce(arg(s, path).try_cast("int"), F.lit(0)))
    return records.select(
        *keep, F.coalesce("answer_correct", F.lit(0.0)).alias("correct"), F.size(steps).alias("n_steps"), n(lambda s: act(s) == "tool_call").alias("tool_calls"), n(lambda s: act(s) == "tool_error").alias("tool_errors"),
        n(lambda s: ~act(s).isin("final_answer", "react_final")).alias("iterations"), (n(lambda s: s["stage"] == "expand_context") > 0).alias("expanded"), added("$.n_neighbors_attached").alias("neighbours"),
        F.try_element_at(verdicts, F.lit(-1)).alias("supported"), F.try_element_at(actions, F.lit(-1)).alias("next_action"), used.alias("sequence"), F.array_distinct(used).alias("selected"),
        F.transform(of(lambda s: act(s) == "tool_error"), lambda s: F.coalesce(arg(s, "$.error"), F.lit("unknown"))).alias("errors"),
        F.coalesce("telemetry.retries_used", F.lit(0)).alias("retries"), F.col("telemetry.loop_terminated").alias("ended"), F.col("telemetry.loop_retry_helped").alias("helped"),
        (F.coalesce("evidence_reward", F.lit(0.0)) > 0).alias("earned"),
    )


def diagnose_traces(facts: DataFrame, *by: str) -> DataFrame:
    """One wide row a run (or any keys) from trace_facts: totals, means, and rates with null denominators."""
    flag = lambda c: F.avg(F.col(c).cast("int"))
    used = F.size("sequence")
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_steps").alias("n_steps"), F.sum("tool_calls").alias("n_tool_calls"), F.sum("tool_errors").alias("n_tool_errors"), F.count_if(F.col("correct") >= 1).alias("answers_correct"),
        F.avg("tool_calls").alias("tool_calls_mean"), F.avg("iterations").alias("iterations_mean"), F.avg("retries").alias("retries_mean"), F.avg((F.col("retries") > 0).cast("int")).alias("retry_rate"),
        F.avg((~F.col("supported")).cast("int")).alias("unsupported_rate"), flag("expanded").alias("expanded_rate"), F.avg("neighbours").alias("neighbours_mean"), flag("helped").alias("retry_helped_rate"),
        F.avg(F.when(F.col("earned"), used).otherwise(0)).alias("useful_mean"), F.avg(F.when(F.col("earned"), 0).otherwise(used)).alias("irrelevant_mean"),
    )


def histogram(facts: DataFrame, value: Column, *by: str) -> DataFrame:
    """by, value, n, n_wrong, n_unsupported: how often a value occurs, in wrong answers and with an unsupporting verdict."""
    return facts.withColumn("value", value).where("value is not null").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct") < 1).alias("n_wrong"), F.count_if(F.col("supported") == F.lit(False)).alias("n_unsupported"))


def packet_quality(packets: DataFrame, *by: str) -> DataFrame:
    """Rates over packets (text_layer_snippet, ocr_snippet, linked_crop_refs, chart_csv, cited): text, context, chart; and the same of cited ones."""
    told = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    text, chart, context = told("text_layer_snippet") | told("ocr_snippet"), told("chart_csv"), F.size(F.coalesce("linked_crop_refs", F.array().cast("array<string>"))) > 0
    rate = lambda t: F.avg(t.cast("int"))
    of_cited = lambda t: F.avg(F.when(F.col("cited"), t.cast("int")))
    return packets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(text).alias("text_rate"), rate(context).alias("context_rate"), rate(chart).alias("chart_rate"),
        of_cited(text).alias("cited_text_rate"), of_cited(context).alias("cited_context_rate"), of_cited(chart).alias("cited_chart_rate"), of_cited(~text & ~chart).alias("cited_image_only_rate"),
    )


def run_summary(records: DataFrame, *by: str) -> DataFrame:
    """The summary of a run: count, accuracy, abstentions, grounding, cost and tokens."""
    gone = reduce(lambda a, b: a | b, [F.lower(F.coalesce("answer_pred", F.lit(""))).contains(w) for w in ("unanswerable", "cannot be determined", "n/a")])
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(zero("answer_correct")).alias("accuracy"), F.avg(gone.cast("int")).alias("abstain_rate"), F.avg(zero("page_recall")).alias("page_recall"), F.avg(zero("bbox_iou")).alias("bbox_iou"),
        F.sum(zero("usd")).alias("usd_total"), F.try_divide(F.sum(zero("usd")), F.count_if(F.col("answer_correct") != 0)).alias("usd_per_correct"),
        F.round(F.sum(zero("tokens_in"))).cast("long").alias("tokens_in"), F.round(F.sum(zero("tokens_out"))).cast("long").alias("tokens_out"), F.avg(zero("latency_ms")).alias("latency_ms_mean"),
    )


def stage_notes(records: DataFrame, key: str = "example_id") -> DataFrame:
    """key, stage, n_steps, first_step, tools: what each stage of a record did, with its tools in order."""
    s = records.select(key, F.posexplode("trace.steps").alias("i", "s")).where("s.stage is not null")
    tool = F.when(F.col("s.tool").isNotNull(), F.struct("i", F.col("s.tool").alias("tool")))
    return s.groupBy(key, F.col("s.stage").alias("stage")).agg(F.count(F.lit(1)).alias("n_steps"), F.min("i").alias("first_step"), F.array_join(F.transform(F.array_sort(F.collect_list(tool)), lambda x: x["tool"]), ",").alias("tools"))


def record_summary(records: DataFrame, key: str = "example_id") -> DataFrame:
    """key and a nested summary of each record as one struct: answer, verdict (its last), tools, retries."""
    facts = trace_facts(records, key, "answer_pred")
    return facts.select(key, F.struct(F.col("answer_pred").alias("answer"), "correct", "supported", "next_action", "sequence", "errors", "retries", "ended").alias("summary"))


def duplicates(df: DataFrame, keys: list[Column], id_column: str) -> DataFrame:
    """key, n, first_id of keys that occur more than once: counted on the map side."""
    return df.groupBy(F.sha2(F.concat_ws("\x1f", *keys), 256).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id")).where("n > 1")


def final_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, text of the last assistant turn, and whether it came by the second turn."""
    last = turns.where("role = 'assistant'").groupBy(key).agg(F.max_by(F.struct("turn", "text"), "turn").alias("t"))
    return last.select(key, "t.turn", "t.text", (F.col("t.turn") <= 1).alias("premature"))
