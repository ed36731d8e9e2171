"""The stored page index: the same ranking as scoring everything, built once, and blocks skipped."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from evidora.operators import page_index as pi
from evidora.operators import retrieval as rt
from evidora.sources import views as vw
from evidora.sources.staging import files_key

SF = "/root/testdata/sf0.001"


def ranking(df):
    return {(r.question_id, r.doc, r["rank"]): (r.page, round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize(("analysis", "direct"), [(pi.PLAIN, None), (pi.PORTER, rt.porter_terms)])
def test_same_ranking_as_scoring_all(spark, tmp_path, analysis, direct):
    pages, asked = vw.page_texts(spark, SF), vw.asked(spark, SF)
    index = pi.stored(pages, str(tmp_path), analysis)
    for questions in (asked, asked.drop("doc")):
        for k in (1, 5):
            want = ranking(rt.bm25(pages, questions, k, analyse=direct))
            assert want and ranking(index.search(questions, k)) == want


def test_a_second_call_reads_no_text(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "pages")
    spark.createDataFrame([("d", i, f"alpha w{i % 5} beta") for i in range(50)], "doc string, page int, text string").write.parquet(source)
    pages, folder = spark.read.parquet(source), str(tmp_path / "index")
    questions = spark.createDataFrame([(1, "w3 beta")], "question_id int, question string")
    first = ranking(pi.stored(pages, folder).search(questions))
    monkeypatch.setattr(pi, "counts", lambda *a, **k: pytest.fail("the texts were read again"))
    assert ranking(pi.stored(spark.read.parquet(source), folder).search(questions)) == first
    monkeypatch.undo()
    # another view of the same files, and files that changed, are other corpora
    upper = pages.withColumn("text", F.lit("nothing"))
    assert files_key(pages, str(pages.semanticHash())) != files_key(upper, str(upper.semanticHash()))
    assert ranking(pi.stored(upper, folder).search(questions)) == {}
    spark.createDataFrame([("d", 99, "w3 w3 w3")], "doc string, page int, text string").write.mode("append").parquet(source)
    again = ranking(pi.stored(spark.read.parquet(source), folder).search(questions))
    assert again[1, "d", 1][0] == 99


def test_a_build_that_died_is_not_read(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([("d", 1, "alpha"), ("d", 2, "beta"), ("d", 3, "beta")], "doc string, page int, text string")
    path = str(tmp_path / f"k-plain-{pi.VERSION}")
    real = spark.createDataFrame

    def dies(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(spark), "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        pi.build(pages, path)
    monkeypatch.undo()
    assert pi.opened(spark, path) is None
    index = pi.stored(pages, str(tmp_path), key="k")
    q = real([(1, "alpha"), (1, "alpha"), (2, "?!"), (3, None), (4, "beta")], "question_id int, question string")
    assert {k: v[0] for k, v in ranking(index.search(q)).items()} == {(1, "d", 1): 1, (4, "d", 1): 2, (4, "d", 2): 3}


def test_pages_without_terms_count(spark, tmp_path):
    """Against SQLite's full-text index, which counts empty pages too."""
    texts = ["Ratings of the café", None, "", "rating rated RATE", "  ", "other words here", "cafe cafe résumé"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, t or "") for i, t in enumerate(texts, 1)])
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc string, page int, text string")
    index = pi.stored(pages, str(tmp_path), pi.PORTER, key="k")
    for words in ("ratings", "café", "resume cafe", "rate other"):
        got = ranking(index.search(spark.createDataFrame([(1, words)], "question_id int, question string"), 7))
        asked = " OR ".join(f'"{w}"' for w in words.split())
        want = con.execute("SELECT rowid, -bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid", (asked,)).fetchall()
        assert [got[1, "d", i + 1] for i in range(len(got))] == [(p, round(s, 6)) for p, s in want]


def test_blocks_that_cannot_reach_the_floor_are_skipped(spark, tmp_path):
    rows = spark.range(6000).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.when(F.col("id") % 1000 == 7, "rare term common").otherwise(F.concat(F.lit("common "), F.repeat(F.lit("filler "), (F.col("id") % 40).cast("int")))).alias("text"))
    index = pi.stored(rows, str(tmp_path), key="k")
    q = spark.createDataFrame([(1, "rare common")], "question_id int, question string")
    r = index.report(q, 3).first()
    assert r.blocks > 80 and r.read + r.skipped == r.blocks and r.skipped > 0.8 * r.blocks
    assert ranking(index.search(q, 3)) == ranking(rt.bm25(rows, q, 3))
    assert [v[0] for _, v in sorted(ranking(index.search(q, 3)).items())] == [7, 1007, 2007]
    assert index.blocks.join(index.postings, ["term", "doc", "block"]).where("part > top").isEmpty()


def test_only_files_have_a_key(spark):
    with pytest.raises(ValueError):
        files_key(spark.range(3))


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.split("\n"))


def test_counting_words_shuffles_nothing(spark):
    pages = spark.createDataFrame([("d", 1, "b a B c b"), ("d", 2, None), ("d", 3, "?"), ("e", 1, "z")], "doc string, page int, text string")
    got = pi.counts(pages)
    assert _shuffles(got) == 0
    assert {(r.doc, r.page, r.term): (r.dl, r.tf) for r in got.collect()} == {("d", 1, None): (5, 1), ("d", 1, "a"): (5, 1), ("d", 1, "b"): (5, 3), ("d", 1, "c"): (5, 1), ("d", 2, None): (0, 1), ("d", 3, None): (0, 1), ("e", 1, None): (1, 1), ("e", 1, "z"): (1, 1)}


def test_counts_go_when_the_postings_are_written(spark, tmp_path):
    pi.build(spark.createDataFrame([("d", 1, "alpha beta")], "doc string, page int, text string"), str(tmp_path / "x"))
    assert {p.name for p in tmp_path.glob("x/*/*") if p.is_dir()} == {"totals", "sizes", "postings", "blocks"}
