"""Stems and full-text ranks against SQLite's index, tools, settings, the command line and small plans."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from evidora import __main__ as cli
from evidora import config, registry
from evidora.functions.stemming import fold, stem
from evidora.operators import retrieval as rt
from evidora.plans import recorded
from evidora.sources import views as vw

SF = "/root/testdata/sf0.001"


def index(texts):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(texts))
    return con


def test_stems_are_those_of_a_full_text_index(spark):
    words = {w for r in vw.page_texts(spark, SF).collect() for w in fold(r.text or "")}
    words |= set("ratings rated relational conditional rationalization hopping tanned falling hissing fizzed failing filing happy sky flies dies agreed plastered motoring conflated troubled sized vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angularity homologous effective bowdlerize probate rate cease controlling rolling be bes".split())
    words = sorted(w for w in words if w.isascii() and w.isalpha())
    con = index(words)
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    want = dict(con.execute("SELECT doc, term FROM v").fetchall())
    assert {w: stem(w) for w in words} == {w: want[i] for i, w in enumerate(words)}


def test_ranks_are_those_of_a_full_text_index(spark):
    texts = ["VCC maximum ratings: VCC 5 V, the rating is absolute", "Ratings of supply. Naïve café ratings", "nothing here", "maximum maximum", None]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, page int, text string")
    con = index([t or "" for t in texts])
    for q, terms in (("VCC rated?", "vcc OR rated"), ("naive cafés", "naive OR cafés"), ("maximum", "maximum")):
        asked = spark.createDataFrame([(1, q)], "question_id int, question string")
        got = [(r.page, r.score) for r in rt.bm25(pages, asked, analyse=rt.porter_terms).orderBy("rank").collect()]
        want = [(i, -s) for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid", (terms,))]
        assert [p for p, _ in got] == [p for p, _ in want] and got
        assert all(a == pytest.approx(b, rel=1e-4) for (_, a), (_, b) in zip(got, want))


def test_tools(spark):
    spans = spark.createDataFrame([("d", 1, "s1", "b", 5.0, 0.0, 9.0, 2.0), ("d", 1, "s2", "a", 1.0, 0.0, 3.0, 2.0)], "doc string, page int, span_id string, text string, x0 double, y0 double, x1 double, y1 double")
    assert registry.TOOLS["get_text_layer"](spans=spans).first().text == "a b"
    crops = spans.where("span_id = 's1'").withColumn("crop_id", F.lit("c"))
    assert [r.span_id for r in registry.TOOLS["inspect_region"](crops=crops, spans=spans).collect()] == ["s1"]
    with pytest.raises(ValueError, match="lacks text"):
        registry.TOOLS["get_text_layer"](spans=spans.drop("text"))
    assert [t.name for t in registry.tool_set("plus_2")] == ["inspect_region", "get_text_layer"]
    assert "search_pages" in registry.describe(registry.tool_set("all")) and registry.describe(registry.tool_set("plus_4"), "json").startswith("[{")
    registry.register_sql(spark)
    assert spark.sql("SELECT porter_terms('Café ratings') AS t").first().t == ["cafe", "rate"]


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text("top_pages = 3\nplanner = 'x'\n")
    s = config.load(str(f), environ={"EVIDORA_TOP_PAGES": "7"})
    assert (s.top_pages, s.planner, s.seed) == (7, "x", 42)
    f.write_text("odd = 1")
    with pytest.raises(ValueError, match="odd"):
        config.load(str(f), environ={})


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert cli.main(["status"]) == 0 and "get_text_layer" in capsys.readouterr().out


def test_resolve_stops_at_the_budget(spark):
    seen = []

    def attempt(df, n):
        seen.append(sorted(r.key for r in df.collect()))
        return df.select("key", (F.col("key") == n).alias("supported"))

    got = {r.key: (r.tries, r.status) for r in recorded.resolve(spark.range(4).toDF("key"), attempt, 3, "key").collect()}
    assert got == {0: (1, "accepted"), 1: (2, "accepted"), 2: (3, "accepted"), 3: (3, "exhausted")}
    assert seen == [[0, 1, 2, 3], [1, 2, 3], [2, 3]]
