"""Packets, tables in notes, finance programs and retries on known answers."""

from pyspark.sql import functions as F

from evidora.operators import evidence as ev

NOTE = "headers: Item | 2021 | 2022 | 2023\ncandidate_rows: Revenue: | Net sales | 100 | 300 | 200 | Operating income | $10 | 30 | 20 | Purchase price | 5 | 6 | 7"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_table_rows_and_corresponding_value(spark):
    rows = one(spark, ev.table_rows(F.lit(NOTE)))
    assert [(r.label, r.vals) for r in rows] == [("Net sales", ["100", "300", "200"]), ("Operating income", ["$10", "30", "20"]), ("Purchase price", ["5", "6", "7"])]
    q = "For the year in which 'Net sales' reached its {}, what was the corresponding 'Operating income', and is it typical, minimum or maximum?"
    assert one(spark, ev.corresponding_answer(F.lit(q.format("maximum")), F.lit(NOTE))) == "30; maximum"
    assert one(spark, ev.corresponding_answer(F.lit(q.format("lowest")), F.lit(NOTE))) == "10; minimum"
    assert one(spark, ev.corresponding_answer(F.lit("What is it?"), F.lit(NOTE))) is None
    assert one(spark, ev.table_rows(F.lit("plain text"))) == []


def test_finance_programs(spark):
    p = spark.createDataFrame([("a", "p1", "Share repurchases 2022: 1,000 then 3,000 2021 9,999", "ratio of repurchase to dividend in fiscal year 2022"), ("a", "p2", "Dividends Fiscal Year 2022 1,200 Fiscal Year 2021 7,000", "ratio of repurchase to dividend in fiscal year 2022")], "example_id string, packet_id string, text string, question string")
    assert ev.repurchase_ratio(p).first().answer == "2.50"
    s = spark.createDataFrame([("a", "p1", "headers: Segment | Opening | Acquisition\ncandidate_rows: North | 10 | 250 | South | 20 | 100 | Total | 30 | 350"), ("a", "p2", "The total purchase price was $1,000.")], "example_id string, packet_id string, text string")
    assert ev.segment_percent(s).first().answer == "25%"


def test_context_and_kinds(spark):
    text = "Main line\nContext [caption]: Fig 1\nContext [Caption Context]: Fig 1\nContext [x-axis]: time  (s)"
    assert one(spark, ev.context_by_role(F.lit(text))) == {"caption": ["Fig 1"], "axis": ["time (s)"]}
    p = spark.createDataFrame([("p", 1, "figure", text, None), ("q", 1, "text", "a | b", None), ("r", 1, "text", "x", "1,2"), ("s", 1, None, None, None)], "packet_id string, page int, region_type string, text string, chart_csv string")
    assert {r.packet_id: (r.group_kind, r.focus_text) for r in ev.groups(p).collect()} == {"p": ("visual", "Main line"), "q": ("table", "a | b"), "r": ("chart", "x"), "s": ("text", "")}


def test_reading_order_follows_the_running_baseline(spark):
    spans = [("b", 50.0, 0.0, 10.0), ("a", 0.0, 2.0, 12.0), ("c", 0.0, 20.0, 30.0), (" ", 5.0, 21.0, 31.0), ("d", 9.0, 22.5, 32.5)]
    df = spark.createDataFrame([(spans,)], "s array<struct<text:string,x0:double,y0:double,y1:double>>")
    assert df.select(ev.reading_order(F.col("s")).alias("x")).first().x == "a b\nc d"


def test_strongest_attempt(spark):
    pick = lambda *xs: spark.createDataFrame([(list(xs),)], "a array<struct<answer:string,n_citations:int,confidence:double>>").select(ev.strongest_attempt(F.col("a")).alias("x")).first().x.answer
    assert pick(("unanswerable", 1, 0.9), ("4 V", 1, 0.2), ("unanswerable", 1, 0.99)) == "4 V"
    assert pick(("4 V", 0, 0.9), ("5 V", 1, 0.1)) == "5 V"
    assert pick(("4 V", 1, 0.6), ("It is 4 V since the table says so, clearly and often", 1, 0.7)) == "4 V"
    assert pick(("yes", 1, 0.6), ("no", 1, 0.7)) == "yes"
    assert pick(("yes", 1, 0.6), ("no", 1, 0.8)) == "no"


def test_repair_lines_and_small_ones(spark):
    p = spark.createDataFrame([(1, "p1", 0, "VCC max 6 V\nother text", "What is the VCC max?", "6 V", True), (1, "p2", 1, "VCC typical", "What is the VCC max?", "6 V", False)], "id int, packet_id string, ordinal int, text string, question string, answer string, cited boolean")
    assert [(r.packet_id, r.line) for r in ev.repair_lines(p, ["id"]).orderBy("rank").collect()] == [("p1", "VCC max 6 V"), ("p2", "VCC typical")]
    assert [tuple(x) for x in one(spark, ev.shortest_ranges(F.array(F.lit(10), F.lit(22), F.lit(25))))] == [(3, 22, 25), (12, 10, 22)]
    e = spark.createDataFrame([(1, "s", "t", 1), (1, "s", "t", 2), (1, "s", "u", 3)], "k int, stage string, event_type string, o int")
    assert sorted(r.event_id for r in ev.event_ids(e, ["k"], ["o"]).collect()) == ["s.t.1", "s.t.2", "s.u.1"]
    n = {r.x: r["count"] for r in spark.range(2000).groupBy(ev.tile_size(F.col("id").cast("string")).alias("x")).count().collect()}
    assert set(n) == {2, 4, 8} and 850 < n[4] < 1150
    pages = spark.createDataFrame([("d", i) for i in range(6)], "doc string, page int")
    gold = spark.createDataFrame([("d", 2)], "doc string, page int")
    noise = [r.page for r in ev.noise_pages(pages, gold, ["doc"], "page", 3, 1).collect()]
    assert len(noise) == 3 and 2 not in noise


def test_focused_packets(spark):
    p = spark.createDataFrame([("k", "t", 1, 0.0, 0.0, 0.2, 0.2, "table", False, True, 0), ("k", "c", 1, 0.0, 0.0, 0.1, 0.1, "text", True, False, 1), ("k", "v1", 1, 0.8, 0.8, 1.0, 1.0, "figure", False, False, 2), ("k", "v2", 1, 0.1, 0.1, 0.3, 0.3, "figure", False, False, 3), ("k", "x", 2, 0.0, 0.0, 1.0, 1.0, "figure", False, False, 4)], "key string, packet_id string, page int, x0 double, y0 double, x1 double, y1 double, region_type string, cited boolean, target boolean, ordinal int")
    assert sorted((r.packet_id, r.why) for r in ev.focused_packets(p, ["key"], 1).collect()) == [("c", "cited"), ("t", "target"), ("v2", "visual")]


def test_a_note_is_read_once_for_a_corresponding_answer(spark):
    """However often the rule uses what it read, its expression splits the question and the note once each."""
    df = spark.range(1).select(ev.corresponding_answer(F.col("id").cast("string"), F.col("id").cast("string")).alias("x"))
    for plan in (df._jdf.queryExecution().analyzed(), df._jdf.queryExecution().optimizedPlan()):
        assert plan.toString().count("candidate_rows") == plan.toString().count("headers:") == 1
