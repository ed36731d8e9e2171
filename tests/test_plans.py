"""Readers, sinks, retrieval anchors, plans and streams."""

import json

import pytest
from pyspark.sql import functions as F

from evidora.operators import aggregates, comparison, retrieval, selection
from evidora.plans import evaluation
from evidora.sources import readers as rd
from evidora.sources import views as vw
from evidora.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_records_round_trip(spark, tmp_path):
    d = tmp_path / "run1" / "predictions"
    d.mkdir(parents=True)
    good = {"example_id": "a", "answer_correct": 1.0, "trace": {"steps": [{"stage": "verify", "args": {"supported": False}}]}}
    (d / "a.json").write_text(json.dumps(good))
    (d / "b.json").write_text("{broken")
    rows = rd.read_records(spark, str(d)).collect()
    assert [(r.example_id, r.run, r.trace.steps[0].stage) for r in rows] == [("a", "run1", "verify")]
    assert json.loads(rows[0].trace.steps[0].args) == {"supported": False}
    rd.write_run(spark.createDataFrame([("a", 1.0)], "example_id string, answer_correct double"), {"n": 1}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/per_example")).count() == 1
    for fmt in ("csv", "json", "parquet", "markdown"):
        rd.write_table(spark.createDataFrame([("a", None)], "x string, y double"), str(tmp_path / fmt), fmt)
    assert [r.value for r in spark.read.text(str(tmp_path / "markdown")).collect()] == ["| x | y |", "|---|---|", "| a | — |"]


def test_examples(spark, tmp_path):
    raw = spark.createDataFrame([("q1", '[{"page": 1, "x0": 0, "y0": 0, "x1": 1, "y1": 1}]', None, 2, None, 3, "validation", [4], ["img0", "img1"])], "id string, supporting_bboxes string, alternate_bboxes string, difficulty_visual int, difficulty_reasoning int, difficulty_localization int, split string, supporting_pages array<int>, page_images array<string>")
    t = rd.typed_examples(raw).first()
    assert (t.split, t.supporting_bboxes[0].page, t.alternate_bboxes, t.difficulty.reasoning) == ("dev", 1, [], 1)
    assert [(r.page, r.image) for r in rd.page_images(raw).collect()] == [(4, "img0"), (2, "img1")]
    u = rd.with_unique_ids(spark.createDataFrame([("x", 1), ("x", 2), (None, 3), ("", 4)], "example_id string, o int"), ["o"], position="o")
    assert sorted(r.unique_id for r in u.collect()) == ["row-0003", "row-0004", "x", "x__2"]


def test_replay_and_record(spark):
    req = spark.createDataFrame([("k1",), ("k2",)], "key string")
    rec = spark.createDataFrame([("k1", "old")], "key string, response string")

    def call(frames):
        for f in frames:
            yield f.assign(response="new")

    got = {r.key: r.response for r in rd.record_or_replay(req, rec, call, "key string, response string").collect()}
    assert got == {"k1": "old", "k2": "new"}


def test_bm25_ranks_the_matching_page_and_omits_others(spark):
    pages = spark.createDataFrame([("d", 1, "Supply current and package notes"), ("d", 2, "Absolute ratings: VCC maximum 6 V, VCC typical 5 V"), ("d", 3, "Ordering information"), ("d", 4, "Maximum junction temperature")], "doc string, page int, text string")
    q = spark.createDataFrame([(1, "V(CC)? maximum")], "question_id int, question string")
    hits = retrieval.bm25(pages, q)
    ranked = [r.page for r in hits.orderBy("rank").collect()]
    assert ranked[0] == 2 and 3 not in ranked
    routed = [(r.page, r.reason) for r in retrieval.route(pages, hits, q.withColumn("doc", F.lit("d")), k=4).orderBy("rank").collect()]
    assert routed[0] == (2, "hit") and len(routed) == 4 and routed[-1] == (3, "pad")


def test_touching_intervals_overlap(spark):
    f = lambda *v: spark.range(1).select(comparison.intervals_overlap(*[F.lit(x) for x in v]).alias("x")).first().x
    assert f(0.1, 0.2, 0.2, 0.3) and not f(0.1, 0.19, 0.2, 0.3) and f(None, 0.1, 0.2, 0.3)


def test_paired_flips_keep_both_occurrences(spark):
    a = spark.createDataFrame([("x", 1, 0.0, "d"), ("x", 2, 1.0, "d"), ("y", 1, 1.0, "e")], "example_id string, occurrence int, answer_correct double, domain string")
    b = spark.createDataFrame([("x", 1, 1.0, "d"), ("x", 2, 0.0, "d"), ("z", 1, 1.0, "e")], a.schema)
    out = evaluation.compare_runs(a, b, ["example_id", "occurrence"])
    assert {r.domain: (r.n, r.recoveries, r.regressions) for r in out["summary"].collect()} == {"d": (2, 1, 1), "_overall": (2, 1, 1)}
    assert tuple(out["only"].first()) == (1, 1, 2)


def test_greedy_takes_each_region_once(spark):
    prim = spark.createDataFrame([("d", 1, 1, "table", 0.1, 0.4, 0.9, 0.6, ["footnote"])], "doc string, page int, primary_id long, region_type string, x0 double, y0 double, x1 double, y1 double, hints array<string>")
    cand = spark.createDataFrame([("d", 1, 2, "section_header", 0.9, 0.1, 0.3, 0.9, 0.35), ("d", 1, 3, "caption", 0.5, 0.1, 0.62, 0.9, 0.66), ("d", 1, 4, "footnote", 0.7, 0.1, 0.68, 0.9, 0.7), ("d", 1, 5, "caption", 0.4, 0.1, 0.62, 0.9, 0.66), ("d", 2, 6, "caption", 0.9, 0.1, 0.62, 0.9, 0.66)], "doc string, page int, region_id long, region_type string, score double, x0 double, y0 double, x1 double, y1 double")
    got = {r.region_id: (r.role, round(r.score, 3)) for r in selection.greedy_neighbours(prim, cand, ["doc", "page"]).collect()}
    assert got == {2: ("title", 0.9), 3: ("caption", 0.5), 4: ("footnote", 1.05)}


def test_score_plan(spark, tmp_path):
    box = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    ex = spark.createDataFrame([("q", "finance", "42", "numeric", None, [1], [(1, 0.0, 0.0, 0.5, 0.5)], None)], f"id string, domain string, answer string, answer_type string, tolerance double, supporting_pages array<int>, supporting_bboxes {box}, alternate_bboxes {box}")
    pred = spark.createDataFrame([("q", "x", "$42", [(1, [0.0, 0.0, 0.5, 0.5]), (2, [0.0])], 2, 0.01)], "example_id string, domain string, answer_pred string, citations array<struct<page:int,bbox:array<double>>>, tool_calls int, usd double")
    r = evaluation.evaluate(ex, pred)["records"].first()
    assert (r.answer_correct, r.page_recall, r.bbox_iou, r.evidence_reward, r.is_lazy) == (1.0, 1.0, 1.0, 1.0, 0)
    evaluation.export_traces(evaluation.score(ex, pred), str(tmp_path / "sft"))
    assert spark.read.text(str(tmp_path / "sft")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    vw.steps(spark, SF).select(F.col("ts").cast("timestamp").alias("ts"), "stage", "latency", "tool", "trace").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = incremental.stage_windows(stream, late="400 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.window_start), r.stage, r.n) for r in df.collect())
    assert key(spark.sql("SELECT * FROM w")) == key(incremental.stage_windows(batch))
    assert incremental.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_run_totals_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"run": "r", "answer_correct": 1.0}\n{"run": "r", "answer_correct": 0.0}\n')
    s = incremental.record_stream(spark, str(tmp_path / "in"), "run string, answer_correct double")
    incremental.run_totals(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert tuple(spark.read.parquet(str(tmp_path / "out")).first()) == ("r", 2, 1.0)


@pytest.mark.parametrize("name", ["agg_by_domain", "paired_flips_by_domain"])
def test_plans_push_columns_to_the_scan(spark, name, capsys):
    from evidora import catalog

    catalog.QUERIES[name](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "l_comment" not in plan and "ReadSchema" in plan


def test_bootstrap_of_all_records_against_brute_force(spark):
    import numpy as np

    from evidora import catalog
    from evidora.sources import views

    records = views.records(spark, "/root/testdata/sf0.001").select("domain", "answer_correct", "usd").toPandas()
    means = {r.domain: (r.lo, r.hi) for r in catalog.QUERIES["bootstrap_accuracy_ci"](spark, "/root/testdata/sf0.001").collect()}
    ratios = {r.domain: (r.lo, r.hi) for r in catalog.QUERIES["bootstrap_usd_ratio_ci"](spark, "/root/testdata/sf0.001").collect()}
    exact = {r.domain: (r.lo, r.hi) for r in catalog.QUERIES["bootstrap_mersenne"](spark, "/root/testdata/sf0.001").collect()}
    rng = np.random.default_rng(5)
    for domain, rows in records.groupby("domain"):
        c, u = rows["answer_correct"].fillna(0).astype(float).to_numpy(), rows["usd"].fillna(0).astype(float).to_numpy()
        at = rng.integers(0, len(c), (2000, len(c)))
        mean, ratio = c[at].mean(axis=1), u[at].sum(axis=1) / c[at].sum(axis=1)
        for got, want in ((means, mean), (exact, mean), (ratios, ratio)):
            assert np.abs(np.array(got[domain]) - np.quantile(want, [0.025, 0.975])).max() < 0.5 * want.std(), domain


def test_block_resamples_draw_n_rows_evenly(spark):
    n, b = 50, 400
    df = spark.range(n).selectExpr("id % 1 AS g", "id", "1.0 AS one", "IF(id = 7, 1.0, 0.0) AS seven")
    rows = aggregates._block_resample(df, ["g"], ["id"], {"one": "one", "seven": "seven"}, b, 42, 8).collect()
    assert len(rows) == b and all(r.one == n == r.n for r in rows)
    mean = sum(r.seven for r in rows) / b
    var = sum((r.seven - mean) ** 2 for r in rows) / b
    assert abs(mean - 1) < 0.2 and abs(var - (1 - 1 / n)) < 0.3


def test_route_hits_cover_all_sources(spark):
    from evidora import catalog
    from evidora.sources import views

    sf = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["route_hit_at_k"](spark, sf).collect()
    assert len({r.doc for r in rows}) == views.page_texts(spark, sf).select("doc").distinct().count() > 1


def test_questions_meet_only_their_own_document(spark):
    from evidora.sources import views

    sf = "/root/testdata/sf0.001"
    pages, asked = views.page_texts(spark, sf), views.asked(spark, sf)
    routed = retrieval.route(pages, retrieval.bm25(pages, asked), asked)
    assert {(r.question_id, r.doc) for r in routed.collect()} <= {(r.question_id, r.doc) for r in asked.collect()}
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Inner\n" not in plan


def test_rerank_and_repair_cover_all_boxes_and_items(spark):
    import re

    from evidora import catalog
    from evidora.sources import views

    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["rerank_json_validate"](spark, sf).count() == views.boxes(spark, sf).count()
    items = [r.text for r in views.table(spark, sf, "benchmark").orderBy("item_id").collect()]
    texts = {r.doc_id: r.text or "" for r in views.table(spark, sf, "documents").collect()}
    words = lambda t: set(re.findall("[a-z0-9]{3,}", t.lower()))
    want = set()
    for d, t in texts.items():
        q = words(items[d % len(items)])
        hits = sorted((-len(words(x) & q), i) for i, x in enumerate(t.split("\n")) if words(x) & q)
        want |= {(d, i, -n) for n, i in hits[:6]}
    got = {(r.doc_id, r.line, r.overlap) for r in catalog.QUERIES["repair_lines_topk"](spark, sf).collect()}
    assert got == want
