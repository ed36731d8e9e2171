"""Verdicts of a verifier: tolerant parsing, canonical codes, and control flow made consistent.

A verdict is a struct (supported, reason, next_action, confidence, missing_context, target_packet_ids, answer_shape_failure); fields
that a response lacks or spells in no known way are null or empty, and `reconciled` decides what is done.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structured import json_part

# Actions, and the spellings under which contexts and failures are known.
NEXT_ACTIONS = ("accept", "retry_localization", "expand_context", "abstain", "escalate_reasoner")
CONTEXTS = {
    "axis_label": "axis axis_label axis_labels tick_label tick_labels",
    "caption": "caption captions",
    "column_header": "column_header column_headers column_label column_labels",
    "continuation": "continued continued_table continuation next_page previous_page",
    "footnote": "footnote footnotes note notes",
    "header": "footer header headers page_footer page_header section_header title",
    "legend": "legend legends",
    "row_header": "row_header row_headers row_label row_labels",
    "unit": "unit units",
    "x_axis": "x_axis x_axis_label",
    "y_axis": "y_axis y_axis_label",
}
FAILURES = {
    "missing_field": "missing_field missing_fields incomplete_answer incomplete_fields",
    "label_value_mismatch": "label_value_mismatch label_instead_of_value value_label_mismatch",
    "wrong_row_risk": "wrong_row wrong_row_risk row_confusion row_disambiguation",
    "legend_binding_risk": "legend_binding legend_binding_risk series_binding chart_binding chart_legend_binding",
    "checkbox_binding_risk": "checkbox_binding checkbox_binding_risk checkmark_binding check_mark_binding",
}
#: Phrases of a reason that name a context, in the order in which contexts are listed.
SPOKEN = (
    ("x_axis", ("x axis", "x-axis")), ("y_axis", ("y axis", "y-axis")), ("axis_label", ("axis label", "tick label")), ("caption", ("caption",)),
    ("column_header", ("column header", "column label")), ("row_header", ("row header", "row label")), ("footnote", ("note",)), ("legend", ("legend",)),
    ("continuation", ("continued table", "continuation", "continued on", "next page", "previous page")), ("header", ("header", "title")), ("unit", ("unit",)),
)
REASON_CHARS, PACKET_ID_CHARS = 240, 80


def _lookup(table: dict[str, str], key: Column) -> Column:
    names = [(F.lit(spelling), F.lit(code)) for code, spellings in table.items() for spelling in spellings.split()]
    return F.element_at(F.create_map(*[x for pair in names for x in pair]), key)


def spelling_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def texts_of(raw: Column) -> Column:
    """A JSON value that is a text or a list of texts, as a list."""
    return F.coalesce(F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.when(raw.isNotNull(), F.array(raw))), F.array().cast("array<string>"))


def next_action(c: Column) -> Column:
    """A known action in any spelling, else null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^[`'\".,;:()\[\]{}\s]+|[`'\".,;:()\[\]{}\s]+$", "")
    name = F.regexp_replace(bare, r"[\s_-]+", "_")
    return F.when(name.isin(*NEXT_ACTIONS), name)


def codes(raw: Column, table: dict[str, str]) -> Column:
    return F.filter(F.transform(texts_of(raw), lambda x: _lookup(table, spelling_key(x))), lambda x: x.isNotNull())


def contexts_in(reason: Column) -> Column:
    """The contexts that a reason speaks of."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    says = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return F.filter(F.array(*[F.when(says(words), code) for code, words in SPOKEN]), lambda x: x.isNotNull())


def verdict(text: Column) -> Column:
    body = json_part(text)
    v = F.from_json(body, "struct<supported:string,reason:string,next_action:string,confidence:string,diagnostics:struct<missing_context:string,target_packet_ids:string,answer_shape_failure:string,answer_shape_failures:string>>")
    reason = F.substring(F.trim(v["reason"]), 1, REASON_CHARS)
    reason = F.when(reason != "", reason)
    confidence = v["confidence"].try_cast("double")
    d = v["diagnostics"]
    ids = F.filter(F.transform(texts_of(d["target_packet_ids"]), lambda x: F.substring(F.trim(x), 1, PACKET_ID_CHARS)), lambda x: x != "")
    return F.struct(
        F.when(v["supported"].isin("true", "false"), v["supported"] == "true").alias("supported"),
        reason.alias("reason"),
        next_action(v["next_action"]).alias("next_action"),
        F.when(confidence.between(0, 1), confidence).alias("confidence"),
        F.array_distinct(F.concat(codes(d["missing_context"], CONTEXTS), contexts_in(reason))).alias("missing_context"),
        F.array_distinct(ids).alias("target_packet_ids"),
        F.array_distinct(F.concat(codes(d["answer_shape_failure"], FAILURES), codes(d["answer_shape_failures"], FAILURES))).alias("answer_shape_failure"),
    )


def reconciled(v: Column) -> Column:
    """{supported, next_action, normalized_from}: supported accepts, unsupported never does; normalized_from is the action that was given up."""
    supported = F.coalesce(v["supported"], F.lit(False))
    given = v["next_action"]
    action = F.when(supported, "accept").when(given == "accept", F.when(F.size(v["missing_context"]) > 0, "expand_context").otherwise("escalate_reasoner")).otherwise(F.coalesce(given, F.lit("escalate_reasoner")))
    return F.struct(supported.alias("supported"), action.alias("next_action"), F.when(given.isNotNull() & (given != action), given).alias("normalized_from"))


def contract_guard(supported: Column, action: Column, known_failures: Column, failures: Column, risks: Column) -> Column:
    """{supported, next_action, answer_shape_failure}: an answer that breaks its question's contract is never accepted."""
    broken = F.size(failures) > 0
    told = F.when(broken, F.concat(known_failures, failures, risks)).when(~supported & (action == "escalate_reasoner"), F.concat(known_failures, risks)).otherwise(known_failures)
    return F.struct((supported & ~broken).alias("supported"), F.when(supported & broken, "escalate_reasoner").otherwise(action).alias("next_action"), F.array_distinct(told).alias("answer_shape_failure"))


def has_shape_failure(v: Column) -> Column:
    return F.arrays_overlap(v["answer_shape_failure"], F.array(*[F.lit(c) for c in FAILURES]))


def packet_id(mention: Column) -> Column:
    """A mention of a packet ('pkt-7', 'packet 7', '7') as its id; other ids that look like one stay; else null."""
    low = F.lower(F.trim(mention))
    number = F.regexp_extract(low, r"^(?:packet\s+)?(?:pkt[_-]?)?(\d{1,4})$", 1)
    return F.when(number != "", F.concat(F.lit("pkt_"), F.lpad(number.cast("int").cast("string"), 3, "0"))).when(low.rlike(r"^[a-z][a-z0-9_-]{0,79}$"), low)
