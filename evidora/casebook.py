"""Queries of scalar rules against tables of worked cases: every order gets one case, and the expected result is written by hand.

A rule that SQL cannot repeat (tokens, tolerant JSON, word distances) is compared with known answers instead: the query applies the
rule to the case of each row of the whole orders table, and the SQL joins the same rows with the expected texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import answers as an
from .functions import boxes as bx
from .functions import contracts as ct
from .functions import focus as fo
from .functions import policies as po
from .functions import shapes as sh
from .functions import structured as st
from .functions import verdicts as ve
from .operators import diagnosis as dg
from .operators import evidence as ev
from .operators import expansion as ex
from .sources import views as vw

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
CASES: dict[str, tuple[list[str], list[tuple], Callable[[], Column]]] = {}


def quoted(x: str | None) -> str:
    return "NULL::VARCHAR" if x is None else "'" + x.replace("'", "''") + "'"


def add(name: str, columns: str, rows: list[tuple], rule: Callable[[], Column]) -> None:
    """Register a rule over text columns; the last value of a row is the expected text."""
    names = columns.split()
    CASES[name] = (names, rows, rule)

    def run(spark, sf_dir: str) -> DataFrame:
        cases = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], ", ".join(["_case int", *[f"{c} string" for c in names]]))
        orders = vw.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), F.pmod("o_orderkey", F.lit(len(rows))).cast("int").alias("_case"))
        return orders.join(F.broadcast(cases), "_case").select("example_id", rule().alias("result"))  # the cases stand in the code

    run.__name__ = name
    QUERIES[name] = run
    values = ", ".join(f"({i}, {quoted(r[-1])})" for i, r in enumerate(rows))
    ORACLE_SQL[name] = f"SELECT o_orderkey AS example_id, result FROM orders JOIN (VALUES {values}) v(n, result) ON o_orderkey % {len(rows)} = n"


def c(name: str) -> Column:
    return F.col(name)


def flags(**tests: Column) -> Column:
    """The names of the tests that hold, with commas."""
    return F.array_join(F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull()), ",")


def joined(*parts: Column) -> Column:
    """Parts with bars; lists with commas, nulls as '-'."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def listed(x: Column) -> Column:
    return F.array_join(F.coalesce(x, F.array().cast("array<string>")), ",")


def numbers(name: str) -> Column:
    return F.from_json(c(name), "array<double>")


def box(name: str) -> bx.Box:
    v = numbers(name)
    return bx.Box(*[F.get(v, i) for i in range(4)])


# ---- answers

add("shape_normalise", "a t d q", [
    ("The answer is Yes, since", "boolean", "", "q", "yes"), ("False.", "AnswerType.BOOLEAN", "", "q", "no"), ("(1,234) million", "numeric", "finance", "q", "-1234"),
    ("(1,234)", "numeric", "finance", "q", "(1,234)"), ("ABC 12 - DEF 5 = 7 mA", "numeric", "datasheet", "q", "7 mA"), ("so it is 9 = -3%", "numeric", "finance", "What is the difference?", "-3%"),
    ("12.5 mA (typical at 25C)", "numeric", "datasheet", "q", "12.5 mA"), ("12 (note)", "numeric", "datasheet", "q", "12"), ("12 not 14", "numeric", "datasheet", "q", "12"),
    ("12 V instead of 14 V", "numeric", "datasheet", "q", "12 V"), ("It draws 3 V and then 20 mA in sleep", "numeric", "datasheet", "What is the current?", "20 mA"),
    ("In the long run the value reported in the table equals 37 units", "numeric", "datasheet", "How many?", "37 units"), ("0x0000", "exact_match", "datasheet", "What is the reset value?", "0 (reset value)"),
    ("0x00001f40", "exact_match", "datasheet", "What is the final address?", "0x1F40"), ("0x1f", "exact_match", "datasheet", "What code?", "0x1F"), ("value: 0xab (BIT0)", "exact_match", "datasheet", "What?", "0xAB (BIT0)"),
    ("Little-endian R1 = 0x1f", "exact_match", "datasheet", "What?", "R1= 0x1F"), ("min 1 V, typ 2 V, max 3 V", "exact_match", "datasheet", "What?", "min: 1 V, typ: 2 V, max: 3 V"),
    ("Canada, about 12%", "exact_match", "finance", "Which country grew most?", "Canada"), ("January, 12%", "exact_match", "finance", "Which line grew most?", "January, 12%"),
    ("Canada and Mexico", "exact_match", "finance", "Which country grew most?", "Canada"), ("Canada and Mexico", "exact_match", "finance", "Which country, or both?", "Canada and Mexico"),
    ("180,683, middle", "exact_match", "finance", "?", "180,683; typical"), ("$(1,200) and the highest", "exact_match", "finance", "?", "-1,200; maximum"),
    ("The corresponding value was 12.5 which is the lowest of all", "exact_match", "finance", "?", "12.5; minimum"), ("Sales of 4.5% is the highest seen", "exact_match", "finance", "?", "4.5%; maximum"),
    ("boot.bin, 12 KB; the file is the largest", "exact_match", "datasheet", "?", "boot.bin, 12 KB"), ("VCC=5V", "exact_match", "datasheet", "?", "VCC = 5 V"),
    ("37; see the chapter", "exact_match", "datasheet", "On which page number is it?", "37"), ("Fig 2, page 12", "exact_match", "datasheet", "Which page? refer to", "Fig 2; page 12"),
    ("Timers, 45", "exact_match", "datasheet", "On which page is it?", "Timers, page 45"), ("The 'Reset' entry is at 112 and others", "exact_match", "datasheet", "On which page number is 'Reset'?", "112"),
    ("set to b0101", "exact_match", "datasheet", "What code is set?", "b0101"), ("12 ppt", "exact_match", "finance", "What if it is misinterpreted?", "12%"),
    ("it is an undefined exception here", "exact_match", "datasheet", "What result?", "Undefined exception"), ("1 Reset; 2 NMI", "exact_match", "datasheet", "Which has priority?", "Reset"),
    ("Reset, 1; NMI, 2", "exact_match", "datasheet", "Which is handled first?", "Reset"), ("[7:4], Reserved", "exact_match", "datasheet", "Which bits?", "[7:4]"),
    ("WFI_EN and set by WFI_EN", "exact_match", "datasheet", "What?", "WFI_EN"), ("a fully-differential input", "exact_match", "datasheet", "What input mode?", "Fully-differential input mode"),
    ("TXE; RXNE", "exact_match", "datasheet", "Which field is set?", "TXE"), ("the codes TXE, RXNE", "exact_match", "datasheet", "Which bit field is immediately adjacent?", "TXE"),
    ("getTemp and C", "exact_match", "datasheet", "Which method and unit?", "getTemp(), C"), ("Acme Corp and 12.5%", "exact_match", "finance", "?", "Acme Corp, 12.5%"), ("Typical; ABC", "exact_match", "finance", "?", "ABC"),
    ('The registrant is a "large accelerated filer"', "exact_match", "finance", "What classification?", "large accelerated filer"),
    ("I think Red line shows it", "exact_match", "finance", "Which one (Blue line, Red line or Green line)?", "Red line"),
    ("Red line and Blue line. Blue line had the largest drop", "exact_match", "datasheet", "Which one (Blue line, Red line or Green line)?", "Blue line"),
    ("lOUT is plotted", "exact_match", "datasheet", "Which variable, VOUT or IOUT?", "IOUT"), ("BZ 12 A, shown in the chart", "exact_match", "datasheet", "?", "BZ12_A"),
    ("C. Label one, determined by eye", "exact_match", "datasheet", "?", "Label one"), ("Blue; the legend says so", "exact_match", "datasheet", "?", "Blue"), ("Phase 2: the one with", "exact_match", "datasheet", "Which phase?", "Phase 2"),
    ("John Smith - chief officer", "exact_match", "finance", "Who?", "John Smith"), ("ABC 12. It is so", "exact_match", "datasheet", "?", "ABC_12"), ("Timers on page 12", "exact_match", "datasheet", "What?", "Timers; page 12"),
    ("plain answer", "exact_match", "datasheet", "What?", "plain answer"), ("  as   it is ", "exact_match", "", "", "as it is"), (None, "numeric", "", "", ""),
], lambda: an.normalise_answer(c("a"), c("t"), c("d"), c("q")))

add("bit_assignments", "a", [
    ("[7:4] = B0001, [3] is 1", "[7:4]=b0001, [3]=1"), ("[7:4]: b01 [3]: 0", "[7:4]=b01, [3]=0"), ("[7:4] = 1", "[7:4] = 1"), ("bits [7:4] = 1, [3] = 0", "bits [7:4] = 1, [3] = 0"), ("plain", "plain"),
], lambda: sh.bit_assignments(c("a")))


def _contract(q: str = "q", t: str | None = "t") -> dict[str, Column]:
    return ct.answer_contract(c(q), None if t is None else c(t))


def _contract_text() -> Column:
    k = _contract()
    return F.concat(flags(**{n: v for n, v in k.items() if n != "row_cues"}), F.lit("|"), listed(k["row_cues"]))


add("answer_contract_flags", "q t", [
    ("What is the lowest voltage rating in the row?", "", "|lowest,row"),
    ("What voltage is it?", "", "requires_quantitative_value|"),
    ("Which unit and value does the table give?", "", "|value"),
    ("How many?", "AnswerType.numeric", "requires_quantitative_value|"),
    ("Explain the visual cues in the chart.", "", "requires_multi_field,requires_visual_explanation,chart_binding|"),
    ("What are the min/typ/max values?", "", "requires_multi_field,requires_min_typ_max|min_typ_max"),
    ("Are both boxes checked?", "boolean", "checkbox_binding|"),
    ("Which company reached its maximum, and the corresponding value?", "", "requires_multi_field,requires_row_binding|corresponding,value"),
    ("Name the part number and the condition.", "", "|part_number,condition"),
    ("Name the row and condition.", "", "requires_multi_field|row,condition"),
    ("What is the label, and what is its colour?", "", "requires_multi_field|"),
    ("Compare the visually similar rows", "", "|compare,visually_similar"),
    (None, "", "|"),
], _contract_text)

add("contract_failures", "q a", [
    ("What are the min/typ/max voltages?", "5", "missing_field|wrong_row_risk"),
    ("What are the min/typ/max voltages?", "min 1, typ 2, max 3", "|wrong_row_risk"),
    ("What voltage is it?", "low", "label_value_mismatch|"),
    ("What voltage is it?", "5 V", "|"),
    ("What voltage is it?", "unanswerable", "|"),
    ("Which two colours are named?", "red", "missing_field|"),
    ("Which two colours are named?", "red and blue", "|"),
    ("Explain the visual cues in the chart.", "it is red", "missing_field|legend_binding_risk"),
    ("Explain the visual cues in the chart.", "the red line in the legend shows it, next to the blue one", "|legend_binding_risk"),
    ("Is the checkbox checked?", "", "|checkbox_binding_risk"),
], lambda: F.concat(listed(ct.contract_failures(c("a"), _contract(t=None))), F.lit("|"), listed(ct.contract_risks(_contract(t=None)))))

add("contract_diagnostics", "q", [
    ("Which row has the lowest value?", "row_disambiguation_cues=lowest,row,value"),
    ("Which company reached its maximum, and the corresponding sales?", "row_disambiguation_cues=corresponding;corresponding_row_binding_cues=source_row,output_field"),
    ("Is the checkbox checked?", "checkbox_binding_cues=check_mark,nearest_label"),
    ("What does the legend say?", "chart_binding_cues=series,legend,panel,caption,axis"),
    ("Who?", ""),
], lambda: F.array_join(F.transform(F.map_entries(ct.contract_diagnostics(_contract(t=None))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";"))

# ---- responses


def _verdict_text() -> Column:
    v = ve.verdict(c("t"))
    r = ve.reconciled(v)
    return joined(v["supported"], v["next_action"], v["confidence"], listed(v["missing_context"]), listed(v["target_packet_ids"]), listed(v["answer_shape_failure"]), r["next_action"], r["normalized_from"])


add("verdict_parse", "t", [
    ('{"supported": true, "next_action": "accept", "confidence": 0.9}', "true|accept|0.9||||accept|-"),
    ('Sure:\n```json\n{"supported": true, "next_action": "Expand-Context."}\n```', "true|expand_context|-||||accept|expand_context"),
    ('{"supported": false, "next_action": "accept", "reason": "the legend is missing"}', "false|accept|-|legend|||expand_context|accept"),
    ('{"supported": false, "next_action": "accept", "reason": "wrong"}', "false|accept|-||||escalate_reasoner|accept"),
    ('{"supported": "yes", "next_action": "look again", "confidence": 3}', "-|-|-||||escalate_reasoner|-"),
    ('{"supported": false, "next_action": "retry localization", "diagnostics": {"missing_context": ["Tick Labels", "x axis", "other"], "target_packet_ids": "pkt_001"}}', "false|retry_localization|-|axis_label,x_axis|pkt_001||retry_localization|-"),
    ('{"supported": false, "next_action": "abstain", "diagnostics": {"answer_shape_failure": "row confusion", "answer_shape_failures": ["missing fields", "row_confusion"]}}', "false|abstain|-|||wrong_row_risk,missing_field|abstain|-"),
    ("no json at all", "-|-|-||||escalate_reasoner|-"), (None, "-|-|-||||escalate_reasoner|-"),
], _verdict_text)

add("verdict_guard", "s n f r", [
    ("true", "accept", "missing_field", "wrong_row_risk", "false|escalate_reasoner|known,missing_field,wrong_row_risk"),
    ("true", "accept", "", "wrong_row_risk", "true|accept|known"), ("false", "escalate_reasoner", "", "wrong_row_risk", "false|escalate_reasoner|known,wrong_row_risk"),
    ("false", "abstain", "", "wrong_row_risk", "false|abstain|known"), ("false", "abstain", "known", "", "false|abstain|known"),
], lambda: (lambda some: (lambda g: joined(g["supported"], g["next_action"], listed(g["answer_shape_failure"])))(ve.contract_guard(c("s") == "true", c("n"), F.array(F.lit("known")), some("f"), some("r"))))(lambda x: F.filter(F.split(c(x), ","), lambda y: y != "")))

add("packet_mentions", "m", [("pkt-7", "pkt_007"), ("Packet 12", "pkt_012"), ("packet pkt_3", "pkt_003"), ("5", "pkt_005"), ("table_a", "table_a"), ("", None), ("7th!", None)], lambda: ve.packet_id(c("m")))

add("plan_parse", "t", [
    ('```json\n{"budget_class": "huge", "evidence_types": ["table"]}\n```', "unknown|table|easy_local|hybrid"), ('{"question_family": "table_note_fusion", "budget_class": "cross_page", "routing_policy": "text_first"}', "table_note_fusion|text,image|cross_page|text_first"), ("nothing", "unknown|text,image|easy_local|hybrid"),
], lambda: (lambda p: joined(p["question_family"], listed(p["evidence_types"]), p["budget_class"], p["routing_policy"]))(st.plan(c("t"))))

add("answer_parse", "t", [
    ('{"answer": "4", "citations": ["p1", "p9"], "confidence": 0.25}', "4|p1|0.25"), (" plain ", "plain||0.5"), ('{"answer": "5", "confidence": 7}', "5||1.0"),
], lambda: (lambda a: joined(a["answer"], listed(a["citations"]), a["confidence"]))(st.answer(c("t"), F.array(F.lit("p1"), F.lit("p2")))))

add("simple_answer_parse", "t", [
    ('{"answer": "4", "citations": [{"page": 2, "bbox": [0, 0, 1, 1]}, {"page": "3", "bbox": [0, 0, 1, 0.5]}, {"page": "x", "bbox": [0, 0, 1, 1]}, {"page": 1, "bbox": [0, 1]}]}', "4|2,3"),
    ("So:\n```json\n{\"answer\": \"yes\"}\n```", "yes|"), ("free text ", "free text|"), ("[1, 2]", "[1, 2]|"), ("", "|"), (None, "|"),
], lambda: (lambda a: joined(a["answer"], F.array_join(F.transform(a["citations"], lambda x: x["page"].cast("string")), ",")))(st.simple_answer(c("t"))))

add("turn_parse", "t", [
    ('{"action": "inspect", "action_input": "r1"}', "inspect|r1|-"), ('{"action": "final_answer", "final_answer": "4"}', "-|-|4"), ("so it is 4", "-|-|so it is 4"),
], lambda: (lambda t: joined(t["tool"], t["input"], t["final"]))(st.turn(c("t"))))

add("crop_plan_parse", "t s", [
    ('[{"region_idx": 1, "mode": "zoom"}, {"region_idx": 9, "mode": "zoom"}]', "[0.1,0.9,0.5]", "1:zoom"), ("none", "[0.1,0.9,0.5,0.9]", "1:full,3:full,2:full"), ("[]", "[0.2]", "0:full"),
], lambda: F.array_join(F.transform(st.crop_plan(c("t"), F.size(numbers("s")), numbers("s")), lambda r: F.concat_ws(":", r["region_idx"].cast("string"), r["mode"])), ","))

add("structured_region_parse", "t", [
    ('{"region_kind": " key  table ", "headers": ["A", " A", "B  c"], "candidate_rows": ["x | 1"], "confidence": 1.5}', "key table|A,B c||x | 1|1.0"),
    ('```json\n{"units": ["V", ""], "confidence": "high"}\n```', "unknown||V||0.0"), ("oops", "unknown||||0.0"), (None, "unknown||||0.0"),
], lambda: (lambda r: joined(r["region_kind"], listed(r["headers"]), listed(r["units"]), listed(r["candidate_rows"]), r["confidence"]))(st.structured_region(c("t"))))

add("json_list_issue", "t", [("[1]", None), ("{}", "not_a_list"), ("[", "invalid_json"), ("", None), (None, None)], lambda: st.json_list_issue(c("t")))
add("json_shape", "t", [('{"b": 1, "a": "x"}', "OBJECT<a: STRING, b: BIGINT>"), ("[1]", "ARRAY<BIGINT>"), ("no", None)], lambda: st.shape(c("t")))

# ---- questions, answers, policies

add("question_intents", "q", [
    ("Which of the listed companies is it?", ""), ("Which region leads?", "single_entity,named_entity"), ("Which fund's share fell?", "single_entity"), ("Which value is read on the y-axis of the chart?", "single_entity,variable,chart_reading"),
    ("Estimate the height of the curve", "estimate"), ("Calculate it; show your work", "calculation"), ("During which period did it rise fastest?", "period"), ("How did sales drop?", ""), (None, ""),
], lambda: flags(single_entity=po.asks_single_entity(c("q")), named_entity=po.asks_named_entity(c("q")), variable=po.asks_variable(c("q")), estimate=po.asks_estimate(c("q")), chart_reading=po.asks_chart_reading(c("q")), calculation=po.asks_calculation(c("q")), period=po.asks_period(c("q"))))

add("entity_margin", "q", [("Which variable is it?", "0.25"), ("What is on the x-axis?", "0.25"), ("Which company?", "0.15"), (None, "0.15")], lambda: po.entity_margin(c("q")).cast("string"))

add("answer_forms", "a", [
    ("12.50 mA", "concise,scalar,starts|2"), ("Vout = a*(b+c)", "concise,formula|0"), ("March 2021", "concise|0"), ("Mar, 2021", "concise,list|0"), ("March 2021 to May 2021", "concise,range|0"),
    ("5 points", "concise,scalar,starts,surrogate|0"), ("-7%", "concise,scalar,starts,surrogate|0"), ("red and blue", "concise,list|0"), ("unanswerable", "gone|0"), ("", "gone|0"), (None, "gone|0"),
    ("a text that says many different things at once without an end", "list|0"),
], lambda: F.concat(flags(concise=po.is_concise(c("a")), gone=po.looks_unanswerable(c("a")), formula=po.is_formula(c("a")), scalar=po.is_scalar(c("a")), starts=po.starts_with_scalar(c("a")), range=po.is_date_range(c("a")), surrogate=po.is_numeric_surrogate(c("a")), list=po.is_list(c("a"))), F.lit("|"), po.decimal_places(c("a")).cast("string")))

add("single_dates", "a", [("March 2021", "true"), ("Mar, 2021", "true"), ("March 2021 to May 2021", "false"), ("2021", "false"), ("Sales 2021", "false")], lambda: po.is_single_date(c("a")).cast("string"))

add("answer_pairs", "a b", [
    ("yes", "No.", "opposite,same_shape"), ("Yes", "true", "same_shape"), ("5 V", "7 mA", "same_shape"), ("5 V", "high", ""), ("red", "blue", "same_shape"), ("The 5_V rail", "5 V", "contains"), ("5 V; see the table", "5 V", "contains,explains,extends"), ("5 V", "5 V", "contains,same_shape"),
], lambda: flags(opposite=po.opposite_booleans(c("a"), c("b")), contains=po.contains_span(c("a"), c("b")), explains=po.explains_after(c("a"), c("b")), extends=po.is_verbose_extension(c("a"), c("b")), same_shape=po.same_shape_scalars(c("a"), c("b"))))

add("question_overlap", "a q", [("the red line", "Which line is red?", "2"), ("µA", "How many uA?", "1"), ("", "Which?", "0"), (None, None, "0")], lambda: po.question_overlap(c("a"), c("q")).cast("string"))
add("required_fields", "a q", [("min 1 typ 2 max 3", "What are min/typ/max?", "true"), ("min 1", "What are min/typ/max?", "false"), ("red and blue", "Name both", "true"), ("red", "Name both", "false"), ("red and blue", "Name it", "false")], lambda: po.adds_required_fields(c("a"), c("q")).cast("string"))


def _kept() -> Column:
    attempt = lambda x: F.from_json(c(x), "struct<answer:string,citations:array<string>,confidence:double>")
    return po.keeps_initial_answer(attempt("a"), attempt("b"), c("q"), ct.answer_contract(c("q")), c("r").cast("int")).cast("string")


_ATTEMPT = '{"answer": "%s", "citations": [%s], "confidence": %s}'
add("keeps_initial_answer", "a b q r", [
    (_ATTEMPT % ("Canada", '"p1"', 0.8), _ATTEMPT % ("Canada, because the table on that page shows its row first", '"p1"', 0.8), "Who?", "1", "true"),
    (_ATTEMPT % ("Canada", '"p1"', 0.8), _ATTEMPT % ("Canada, because the table on that page shows its row first", '"p1"', 0.8), "Who?", "0", "false"),
    (_ATTEMPT % ("Canada", "", 0.8), _ATTEMPT % ("Canada, because the table on that page shows its row first", '"p1"', 0.8), "Who?", "1", "false"),
    (_ATTEMPT % ("Canada", '"p1"', 0.5), _ATTEMPT % ("Mexico", '"p1"', 0.9), "Who?", "1", "false"),
    (_ATTEMPT % ("Canada", '"p1"', 0.5), _ATTEMPT % ("unanswerable", "", 0.5), "Who?", "1", "true"),
    (_ATTEMPT % ("5 V", '"p1"', 0.9), _ATTEMPT % ("7 V", '"p1"', 0.9), "What voltage does the curve read at 25?", "1", "true"),
    (_ATTEMPT % ("5 V", '"p1"', 0.9), _ATTEMPT % ("7 V", '"p2"', 0.9), "What voltage does the curve read at 25?", "1", "false"),
    (_ATTEMPT % ("5 V", '"p1"', 0.9), _ATTEMPT % ("V = 2*(1+1.5)", '"p1"', 0.9), "What voltage is it?", "2", "true"),
], _kept)

add("inspector_choice", "b f r", [("highres_tiny", "", None, "true"), ("easy_local", "confusable_label", "0.4", "true"), ("easy_local", "confusable_label", "0.6", "false"), ("easy_local", "confusable_label", None, "false"), ("easy_local", "other", "0.1", "false")], lambda: po.uses_tool_inspector(c("b"), c("f"), c("r").cast("double")).cast("string"))
add("first_expansion", "p n h r s w", [
    ("y", None, "0", "0.4", "y", "", "false"), ("y", None, "0", "0.5", "y", "", "true"), ("y", "primary", "0", None, "y", "", "true"), ("y", "caption_context", "0", None, "y", "", "true"), ("y", None, "1", None, "y", "", "true"), ("y", None, "0", None, "n", "", "true"), ("n", None, "0", None, "y", "", "true"), ("y", None, "0", "0.1", "y", "unclear", "true"), ("y", "other", "0", None, "y", "", "false"),
], lambda: po.expands_at_first(c("p") == "y", c("n"), c("h").cast("int"), c("r").cast("double"), c("s") == "y", c("w"), F.lit(False)).cast("string"))
add("first_cap", "f s w", [("table_note_fusion", "y", "", "true"), ("curve_axis_reading", "y", "", "false"), ("table_note_fusion", "n", "", "false"), ("table_note_fusion", "y", "look", "false"), (None, "y", None, "true")], lambda: po.caps_first_expansion(c("f"), c("s") == "y", c("w"), F.lit(False)).cast("string"))
add("retry_context", "w t n m k a", [
    ("the diagram is fragmented", "y", "2", "2", "figure", "0.3", "union"), ("the crop is too small", "y", "2", "1", "figure", "0.3", ""), ("the waveforms are cut", "y", "1", "1", "Picture", "0.2", "panels"), ("the waveforms are cut", "y", "1", "1", "table", "0.9", ""), ("the waveforms are cut", "n", "1", "1", "figure", "0.9", ""), (None, "y", "3", "3", "figure", "0.9", ""),
], lambda: flags(union=po.adds_union_context(c("w"), c("t") == "y", c("n").cast("int"), c("m").cast("int")), panels=po.adds_panels(c("w"), c("t") == "y", c("k"), c("a").cast("double"))))
add("inspection_gates", "f g q n r i", [
    ("legend_series_binding", "bar_chart", "Who?", None, "0.5", "0", "chart,visual"), ("legend_series_binding", "logo", "Which row is lowest?", "primary", None, "1", "structure,visual,crop"), ("legend_series_binding", "", "Who?", "primary", None, "2", "visual"), ("table_note_fusion", None, "Who?", None, None, "9", "structure,crop"),
], lambda: flags(chart=po.is_chart(c("g")), structure=po.wants_structure(c("f"), F.array().cast("array<string>"), c("q")), visual=po.needs_visual_context(c("f")), crop=po.allows_context_crop(c("f"), c("n"), c("r").cast("double"), c("i").cast("int"))))
add("error_classes", "e", [
    ("Error 429: Too Many Requests", "transient,throttle,aborts"), ("quota exceeded for requests per day", "throttle,quota,aborts"), ("HTTP 503 temporarily unavailable", "transient"), ("StubResponseError: one box", "aborts"), ("KeyError", ""), (None, ""),
], lambda: flags(transient=dg.transient_error(c("e")), throttle=po.is_throttle(c("e")), quota=po.is_quota_exhausted(c("e")), aborts=po.aborts_run(c("e"), F.lit(True))))
add("stub_layouts", "n b p", [("1", "95", "100", "true"), ("1", "94", "100", "false"), ("2", "100", "100", "false"), ("1", "1", "0", "false")], lambda: F.coalesce(po.is_stub_layout(c("n").cast("int"), c("b").cast("double"), c("p").cast("double")), F.lit(False)).cast("string"))
add("protocol_fits", "a p", [("focus", "focus_default", "true"), ("focus", "full_doc", "false"), ("react", "oracle_page", "true"), ("simple", "tiled_2up", "true"), ("simple", "focus_default", "false")], lambda: po.protocol_fits(c("a"), c("p")).cast("string"))

# ---- packets and evidence

_PAGE = "Intro line\nSupply voltage 3 V\nIdle current 5 mA\nNoise floor\nSleep current 2 uA\nEnd"
add("question_lines", "t q", [
    (_PAGE, "What is the idle current?", "Supply voltage 3 V / Idle current 5 mA / Noise floor / Sleep current 2 uA / End"), (_PAGE, "Who wrote it?", _PAGE), ("a\nb", "", "a\nb"), (_PAGE, "noise", "Idle current 5 mA / Noise floor / Sleep current 2 uA"),
], lambda: fo.question_lines(c("t"), c("q"), 20))
add("answer_lines", "t a", [
    (_PAGE, "5 mA", "Supply voltage 3 V / Idle current 5 mA / Noise floor / Sleep current 2 uA"), (_PAGE, "idle current", "Supply voltage 3 V / Idle current 5 mA / Noise floor / Sleep current 2 uA"), (_PAGE, "unanswerable", ""), (_PAGE, None, ""), (_PAGE, "3 V supply voltage", "Intro line / Supply voltage 3 V / Idle current 5 mA / Noise floor"),
], lambda: fo.answer_lines(c("t"), c("a")))
add("focused_text", "t q a", [(_PAGE, "noise", "noise floor", "Idle current 5 mA / Noise floor / Sleep current 2 uA / End"), (_PAGE, "supply", "noise floor", "Idle current 5 mA / Noise floor / Sleep current 2 uA / End / Intro line / Supply voltage 3 V / Idle current 5 mA"), (_PAGE, "supply", None, "Intro line / Supply voltage 3 V / Idle current 5 mA")], lambda: fo.focused_text(c("t"), c("q"), c("a"), 20))
add("packet_snippet", "t o", [("a  b\nc", "x", "a b c"), ("", "from  ocr", "from ocr"), (None, None, ""), ("12345678901234567890123", "", "12345678901234567...")], lambda: fo.snippet(c("t"), c("o"), F.lit(""), 20))
add("neighbour_delivery", "r n t", [('["a", "", "b"]', '["title", "x", "caption"]', '["Title"]', "caption|title"), ('["a", "b"]', '["title"]', "[]", "title,unknown|")], lambda: (lambda x: joined(listed(x["image"]), listed(x["text"])))(fo.neighbour_roles(*[F.from_json(c(k), "array<string>") for k in "rnt"])))
add("proposed_answers", "t", [("Notes\nProposed answer:  5 V \nmore", "5 V"), ("none", ""), (None, "")], lambda: fo.proposed_answer(c("t")))
add("chart_scales", "o q", [
    ("V_OUT (400mV/div) Time (2.5us/div)", "What is V OUT?", "Detected chart scales: VOUT=400mV/div; TIME=2.5us/div. Question target scale: VOUT=400mV/div."), ("VOUR 1V/div VOUT 1V/div", "Who?", "Detected chart scales: VOUT=1V/div."), ("nothing", "V OUT", None), (None, None, None),
], lambda: fo.chart_scales(c("o"), c("q")))
add("packet_overlap", "q t k", [("What is V_OUT in millivolts?", "vout 5mV", "", "2"), ("What is V_OUT?", "vout 5mV", "x,y", "3"), ("red", "blue", "a", "2"), ("", "blue", "a", "0")], lambda: fo.packet_overlap(c("q"), c("t"), c("k")).cast("string"))
add("table_note_rows", "t", [
    ("headers: Item | 2020 | 2021\ncandidate_rows: Sales | 1,200 | 1,300 | Costs | 5 | (note) | Other", "Sales=1,200;1,300/Costs=5;(note)"), ("headers: Item | V\ncandidate_rows: 12 | A | 7", "A=7"), ("none", ""),
], lambda: F.array_join(F.transform(ev.table_rows(c("t")), lambda r: F.concat(r["label"], F.lit("="), F.array_join(r["vals"], ";"))), "/"))
_NOTE = "headers: Item | 2019 | 2020 | 2021\ncandidate_rows: Total Sales | 10 | 30 | 20 | Net Costs | 180,683 | 1,000 | 250,000"
add("corresponding_answers", "q t", [
    ("When 'Total Sales' was highest, what was the corresponding 'Net Costs'?", _NOTE, "1,000; minimum"), ("When 'Total Sales' was lowest, what was the corresponding 'Net Costs'?", _NOTE, "180,683; typical"), ("When 'Total Sales' was lowest, what was the corresponding 'Nothing'?", _NOTE, None), ("What are the sales?", _NOTE, None),
], lambda: ev.corresponding_answer(c("q"), c("t")))
add("money_amounts", "t", [("was $1,234.5 then (2,000) and 7", "1234.5,-2000"), ("none", "")], lambda: listed(an.money_amounts(c("t"))))
add("month_ranges", "t", [("from March 2021 to May 2021, then June 2021", "1,2"), ("May 2021", "")], lambda: F.array_join(F.transform(ev.shortest_ranges(an.month_index(c("t"))), lambda r: r["months"].cast("string")), ","))
add("reading_order", "s", [
    ('[{"text":"b","x0":5,"y0":0,"y1":2},{"text":"a","x0":1,"y0":1,"y1":3},{"text":"c","x0":0,"y0":9,"y1":11}]', "a b\nc"), ("[]", ""),
], lambda: ev.reading_order(F.from_json(c("s"), "array<struct<text:string,x0:double,y0:double,y1:double>>")))
add("context_roles", "t", [("body\nContext [Page Header]: Acme  Inc\nContext [x_axis]: Time\ncontext [page_header]: Acme Inc", "body|header=Acme Inc;axis=Time"), ("", "|")], lambda: joined(ev.primary_text(c("t")), F.array_join(F.transform(F.map_entries(ev.context_by_role(c("t"))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")))
add("group_kinds", "k t v", [("Table", "x", "", "table"), ("text", "min typ max unit", "", "table"), ("picture", "x", "", "visual"), ("picture", "x", "1,2", "chart"), ("text", "x", "", "text")], lambda: ev.group_kind(c("k"), c("t"), c("v"), F.lit(False)))
add("safe_ids", "i", [("a/b c", "a_b_c"), ("Ünï-1.x", "_n_-1.x")], lambda: an.safe_id(c("i")))
add("small_parsers", "t", [("$1,200", "1200.0|-|$1,200"), ("a_page_12.png", "-|12|png"), ("Domain.Finance", "-|-|finance"), ("", "-|-|?")], lambda: joined(an.tick_value(c("t")), an.page_of_file(c("t")), an.domain_stem(c("t"))))
add("clean_contexts", "t", [("a  b\n c", "a b c"), ("", None), ("x" * 250, "x" * 237 + "...")], lambda: an.clean_context(c("t")))
add("figure_classes", "s", [('["figure_class=bar_chart", "x"]', "bar_chart"), ('["x"]', None)], lambda: F.nullif(an.figure_class(F.from_json(c("s"), "array<string>")), F.lit("")))
add("numeric_probes", "t", [("5 + 1,200 = 1,205 at 0x1F then 0x2a", "5,1200,1205,0,1,0,2|0x2a|2"), ("none", "|-|-")], lambda: joined(listed(dg.number_tokens(c("t"))), dg.last_hex(c("t")), dg.number_after_equals(c("t"))))
add("strongest_attempts", "a", [
    ('[{"answer":"unanswerable","n_citations":1,"confidence":0.9},{"answer":"5 V","n_citations":0,"confidence":0.1}]', "5 V"), ('[{"answer":"yes","n_citations":1,"confidence":0.5},{"answer":"no","n_citations":1,"confidence":0.6}]', "yes"), ('[{"answer":"5 V","n_citations":1,"confidence":0.5},{"answer":"5 V, as the table of the page says","n_citations":1,"confidence":0.6}]', "5 V"), ('[{"answer":"5 V","n_citations":0,"confidence":0.9},{"answer":"7 V","n_citations":2,"confidence":0.2}]', "7 V"),
], lambda: ev.strongest_attempt(F.from_json(c("a"), "array<struct<answer:string,n_citations:int,confidence:double>>"))["answer"])

# ---- expansion

add("evidence_types", "e", [('["figure", "Legend", "odd"]', "chart,curve,diagram,figure,image,legend,picture,plot"), ("[]", ""), ('["table", "footer"]', "page-footer,table")], lambda: listed(F.array_sort(ex.detector_types(F.from_json(c("e"), "array<string>")))))
add("permitted_types", "e w", [
    ('["legend"]', "", "legend"), ("[]", "the caption is missing", "caption"), ('["x_axis"]', "no footnotes seen", "axis-label,axis_label,footnote"), ("[]", "", ""),
], lambda: listed(F.array_sort(ex.permitted_types(F.from_json(c("e"), "array<string>"), c("w")))))

# ---- geometry

add("directions", "a b", [
    ("[0,0.1,1,0.2]", "[0,0.3,1,0.4]", "above,nearby"), ("[0,0.3,1,0.4]", "[0,0.1,1,0.2]", "below,nearby"), ("[0.1,0,0.2,1]", "[0.3,0,0.4,1]", "left,nearby"), ("[0.3,0,0.4,1]", "[0.1,0,0.2,1]", "right,nearby"), ("[0,0,0.1,0.1]", "[0.9,0.9,1,1]", ""), ("[0,0.1,0.1,0.2]", "[0.3,0.3,1,0.4]", ""),
], lambda: flags(**{d: bx.in_direction(box("a"), box("b"), F.lit(d)) for d in ("above", "below", "left", "right", "nearby")}))
add("box_relations", "a b", [("[0,0,1,1]", "[0.2,0.2,0.4,0.4]", "contains,overlaps"), ("[0,0,1,1]", "[0,0,1,1.0000001]", "overlaps,same"), ("[0,0,0.1,0.1]", "[0.1,0,0.2,0.1]", ""), ("[0,0,0.5,0.5]", "[0.4,0.4,0.9,0.9]", "overlaps")], lambda: flags(contains=bx.contains(box("a"), box("b")), overlaps=bx.overlaps(box("a"), box("b")), same=bx.same(box("a"), box("b"))))


def rounded(b: bx.Box) -> Column:
    return F.concat_ws(",", *[F.format_string("%.3f", getattr(b, k)) for k in ("x0", "y0", "x1", "y1")])


add("padded_boxes", "a", [("[0.05,0.5,0.1,0.99]", "0.000,0.420,0.180,1.000"), ("[0.5,0.5,0.6,0.6]", "0.420,0.420,0.680,0.680")], lambda: rounded(bx.pad(box("a"), 0.08)))
