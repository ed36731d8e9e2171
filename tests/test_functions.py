"""Scalar rules on known answers."""

import pytest
from pyspark.sql import functions as F

from evidora.functions import answers as an
from evidora.functions import boxes as bx
from evidora.functions import contracts as ct
from evidora.functions import structured as st
from evidora.functions import verdicts as ve


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items())) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


SCORES = [
    ("$1,234.56", "1234.56", "AnswerType.NUMERIC", None, 1.0),
    ("5.5V", "5.5", "numeric", None, 1.0),
    ("about 520 A", "Approximately 521 A", "numeric", None, 1.0),
    ("40 degrees", "40", "numeric", None, 1.0),
    ("10-20", "10", "numeric", None, 1.0),
    ("1.1", "1.0", "numeric", "0.1", 1.0),
    ("1.2", "1.0", "numeric", "0.1", 0.0),
    ("none", "1.0", "numeric", None, 0.0),
    ("Yes, it is", "TRUE", "boolean", None, 1.0),
    ("No. never", "yes", "boolean", None, 0.0),
    ("maybe", "Maybe;", "boolean", None, 1.0),
    ("Option (b)", "B", "multiple_choice", None, 1.0),
    ("the answer is c", "C.", "Answer.multiple_choice", None, 1.0),
    ("It is not answerable", "x", "unanswerable", None, 1.0),
    ("42", "x", "unanswerable", None, 0.0),
    ("fast mode2a", "fast_mode2a", "exact_match", None, 1.0),
    ("RESET", "reset; clears all bits", "exact_match", None, 1.0),
    ("Alpha (beta)", "alpha", "exact_match", None, 1.0),
    ("alpha", "omega", "exact_match", None, 0.0),
    ("\tAlpha\n", "alpha", "other", None, 1.0),
]


def test_score_answer(spark):
    rows = spark.createDataFrame(SCORES, "p string, g string, k string, t string, want double")
    got = rows.select("p", "want", an.score_answer(F.col("p"), F.col("g"), F.col("k"), F.col("t")).alias("got")).where("not (got <=> want)").collect()
    assert got == []


SHAPES = [
    ("Yes, because", "boolean", "", "", "yes"),
    ("the answer is FALSE", "boolean", "", "", "no"),
    ("$(1,234) million", "numeric", "finance", "", "-1234"),
    ("MAX 1.35 - TYP 1 = 0.35 µVpp", "numeric", "datasheet", "", "0.35 µVpp"),
    ("12 V (not shown)", "numeric", "", "", "12 V"),
    ("12 instead of 14", "numeric", "", "", "12"),
    ("It draws 3 mA at 5 V and 4 mA at 6 V", "numeric", "", "What current does it draw?", "4 mA"),
    ("0x0000", "exact_match", "", "value after reset", "0 (reset value)"),
    ("0x0000abcd", "exact_match", "", "Which address?", "0xABCD"),
    ("Lanes Enabled; OxFF (CTRLO, CTRL1)", "exact_match", "", "", "0xFF (CTRL0, CTRL1)"),
    ("little endian r0 = 0xab", "exact_match", "", "", "r0= 0xAB"),
    ("r0 (0x5)", "exact_match", "", "", "r0 (0x5)"),
    ("123, see the table", "exact_match", "", "On which page number is it?", "123"),
    ("Electrical notes, page 7", "exact_match", "", "Which page does it refer to?", "Electrical notes; page 7"),
    ("Timing 412", "exact_match", "", "What page shows 'Clock'?", "412"),
    ("set to b0101 now", "exact_match", "", "Which setting?", "b0101"),
    ("3.5 ppt", "exact_match", "", "If read without the note?", "3.5%"),
    ("takes the Undefined exception path", "exact_match", "", "What is the result?", "Undefined exception"),
    ("1 Reset; 2 Abort", "exact_match", "", "Which is handled first?", "Reset"),
    ("[31:4], Reserved", "exact_match", "", "Which?", "[31:4]"),
    ("FOO_A and its copy by FOO_A", "exact_match", "", "Which?", "FOO_A"),
    ("a fully differential one", "exact_match", "", "Which input mode?", "Fully-differential input mode"),
    ("ABC; DEF", "exact_match", "", "Which field is set?", "ABC"),
    ("get_temp and C", "exact_match", "", "Which function and unit?", "get_temp(), C"),
    ("(1,234)", "numeric", "finance", "How much?", "(1,234)"),
    ("(1,234) million", "numeric", "finance", "How much?", "-1234"),
    ("the codes are TXE, RXNE", "exact_match", "", "Which bit field is immediately adjacent?", "TXE"),
    ("Acme Corp and 12.5%", "exact_match", "finance", "How much?", "Acme Corp, 12.5%"),
    ("March 12", "exact_match", "finance", "How much?", "March 12"),
    ("Brazil, about 12%", "exact_match", "finance", "Which country leads?", "Brazil"),
    ("Brazil and Chile", "exact_match", "finance", "Which country leads?", "Brazil"),
    ("Both: the corresponding total was $1,200 which is the lowest", "exact_match", "finance", "", "1,200; minimum"),
    ("It says that the registrant is a \"large filer\"", "exact_match", "", "Which classification?", "large filer"),
    ("it is the Red bar", "exact_match", "", "Which (red bar, blue bar, or green bar)?", "Red bar"),
    ("the lOUT curve", "exact_match", "", "Which variable is it, IOUT or VOUT?", "IOUT"),
    ("Blue; the legend shows it", "exact_match", "", "Which?", "Blue"),
    ("Europe: it grew", "exact_match", "", "Which region?", "Europe"),
    ("min 1 typ 2 max 3", "exact_match", "", "", "min: 1, typ: 2, max: 3"),
    ("(180), max", "exact_match", "finance", "", "-180; maximum"),
    ("5.5 V, typ", "numeric", "", "", "5.5 V, typ"),
    ("fw.bin, 12 KB; the boot image", "exact_match", "datasheet", "", "fw.bin, 12 KB"),
    ("VCC=5V", "exact_match", "", "", "VCC = 5 V"),
    ("ABC 12. explained", "exact_match", "", "", "ABC_12"),
    ("John Smith — the chair", "exact_match", "finance", "", "John Smith"),
    ("Table 4 on page 12", "exact_match", "", "", "Table 4; page 12"),
    ("  as   it is ", "exact_match", "", "", "as it is"),
    (None, "numeric", "", "", ""),
]


def test_normalise_answer(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(SHAPES)], "i int, a string, k string, d string, q string, want string")
    got = rows.select("a", "want", an.normalise_answer(F.col("a"), F.col("k"), F.col("d"), F.col("q")).alias("got")).where("not (got <=> want)").collect()
    assert got == []


def test_contract(spark):
    c = ct.answer_contract(F.col("q"))
    flags = lambda q: one(spark, F.struct(*[v.alias(k) for k, v in c.items()]), q=q)
    assert flags("What are the min/typ/max voltages?").requires_min_typ_max
    f = flags("Which voltage is lowest in the row, and the corresponding current?")
    assert f.requires_multi_field and f.row_cues == ["lowest", "corresponding", "row"] and f.requires_row_binding
    fail = lambda q, a: one(spark, ct.contract_failures(F.col("a"), ct.answer_contract(F.col("q"))), q=q, a=a)
    assert fail("What are the min/typ/max voltages?", "5") == ["missing_field"]
    assert fail("What voltage is it?", "low") == ["label_value_mismatch"]
    assert fail("What voltage is it?", "unanswerable") == []


def test_boxes(spark):
    box = lambda *v: bx.Box(*[F.lit(float(x)) for x in v])
    get = lambda e: one(spark, e)
    assert get(bx.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert get(bx.iou(box(0, 0, 1, 1), box(1, 1, 2, 2))) == 0
    assert get(bx.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    u = bx.to_unit(box(10, 20, 50, 40), F.lit(100), F.lit(200))
    assert [get(x) for x in (u.x0, u.y0, u.x1, u.y1)] == [0.1, 0.1, 0.5, 0.2]
    assert get(bx.in_direction(box(0, 0.1, 1, 0.2), box(0, 0.3, 1, 0.4), F.lit("above")))
    assert not get(bx.in_direction(box(0, 0.1, 0.1, 0.2), box(0.5, 0.3, 1, 0.4), F.lit("above")))
    assert get(bx.page_recall(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(2)))) == 0.5
    assert get(bx.page_recall(F.array(F.lit(1)), F.array().cast("array<int>"))) == 1.0
    assert get(bx.box_issues(box(0, 0, 1, 1), F.lit(3), F.array(F.lit(1)))) == ["off_page", "too_large"]


def test_structured(spark):
    v = one(spark, F.struct(ve.verdict(F.col("t")).alias("v"), ve.reconciled(ve.verdict(F.col("t"))).alias("r")), t='Sure: {"supported": true, "next_action": "Retry-Localization.", "confidence": 3}')
    assert (v.v.supported, v.v.next_action, v.v.confidence, v.r.next_action, v.r.normalized_from) == (True, "retry_localization", None, "accept", "retry_localization")
    v = one(spark, ve.reconciled(ve.verdict(F.col("t"))), t='{"supported": false, "next_action": "accept", "reason": "the legend is missing"}')
    assert v.next_action == "expand_context"
    p = one(spark, st.plan(F.col("t")), t='```json\n{"budget_class": "huge", "evidence_types": ["table"]}\n```')
    assert (p.question_family, p.evidence_types, p.budget_class, p.routing_policy) == ("unknown", ["table"], "easy_local", "hybrid")
    a = one(spark, st.answer(F.col("t"), F.array(F.lit("p1"))), t='{"answer": "4", "citations": ["p1", "p9"]}')
    assert (a.answer, a.citations) == ("4", ["p1"])
    assert one(spark, st.answer(F.col("t"), F.array(F.lit("p1"))), t=" plain ").answer == "plain"
    t = one(spark, st.turn(F.col("t")), t='{"action": "inspect", "action_input": "r1"}')
    assert (t.tool, t.input, t.final) == ("inspect", "r1", None)
    assert one(spark, st.turn(F.col("t")), t="so it is 4").final == "so it is 4"
    assert [one(spark, st.json_list_issue(F.col("t")), t=x) for x in ("[1]", "{}", "[", "")] == [None, "not_a_list", "invalid_json", None]


def test_small_parsers(spark):
    assert one(spark, an.money_amounts(F.lit("was $1,234.5 then (2,000) and 7"))) == ["1234.5", "-2000"]
    assert one(spark, an.month_index(F.lit("from March 2021 to May 2021, March 2021"))) == [2021 * 12 + 3, 2021 * 12 + 5]
    assert one(spark, an.tick_value(F.lit("$1,200"))) == 1200.0
    assert one(spark, an.page_of_file(F.lit("a_page_12.png"))) == 12
    assert len(one(spark, an.safe_id(F.lit("x" * 200)))) == 16
    assert one(spark, an.clean_context(F.lit("a  b\n c"))) == "a b c"
