"""Queries of nested traces, whole evaluations and evidence packets, with their DuckDB SQL.

A trace is made of the lines of an order: each line is a step. SQL works on the flat lines, the operators on the nested records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalog as cat
from .functions import boxes as bx
from .operators import comparison as cm
from .operators import diagnosis as dg
from .operators import evidence as ev
from .operators import expansion as ex
from .operators import retrieval as rt
from .operators import selection as se
from .operators import stages as sg
from .plans import evaluation
from .plans import recorded as recorded_plans
from .plans import retry_machine as rm
from .sources import readers as rd
from .sources import views as vw
from .streaming import tool_loop as tl

QUERIES, ORACLE_SQL, query, r6 = cat.QUERIES, cat.ORACLE_SQL, cat.query, cat.r6

STAGES, ACTIONS, TOOLS, NEXT = ("route_pages", "inspect", "verify", "reason", "expand_context"), ("tool_call", "tool_error", "passthrough", "run"), ("zoom", "ocr", "crop"), ("accept", "abstain", "expand_context")
ENDS = ("accepted", "abstained", "exhausted", "accepted_preserved_initial")


_pick, _sql_pick = vw.pick, vw.sql_pick


def traces(spark, sf_dir) -> DataFrame:
    """Records with a nested trace, one an order that has lines."""
    p, s, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    args = F.format_string('{"candidates": [%d, %d, %d], "supported": %s, "next_action": "%s", "n_neighbors_attached": %d, "error": "E%d"}', s % 9, p % 9, (s + p) % 9, F.when(p % 2 == 0, "true").otherwise("false"), _pick(NEXT, p), ln, p % 3)
    step = F.struct(
        ln.alias("ln"), p.alias("p"), s.alias("s"), _pick(STAGES, s).alias("stage"), _pick(ACTIONS, p).alias("action"), F.when(p % 4 < 2, _pick(TOOLS, s)).alias("tool"), args.alias("args"),
        F.col("l_quantity").cast("long").alias("tokens_in"), ln.cast("long").alias("tokens_out"), (F.col("l_quantity") * 10).cast("long").alias("latency_ms"), (F.col("l_extendedprice") / 1e6).alias("usd"),
    )
    t = vw.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(step)).alias("steps"))  # a few lines an order
    k = F.col("k")
    steps = F.transform("steps", lambda x, i: F.struct(i.alias("step_index"), *[x[c].alias(c) for c in ("stage", "action", "tool", "args", "tokens_in", "tokens_out", "latency_ms", "usd")]))
    return t.select(
        k.cast("string").alias("example_id"), F.when(k % 4 == 0, "Unanswerable").when(k % 4 == 1, "n/a").otherwise("x").alias("answer_pred"), F.when(k % 3 == 0, "AnswerType.UNANSWERABLE").otherwise("numeric").alias("answer_type"),
        (k % 2).cast("double").alias("answer_correct"), ((k % 5) / 5.0).alias("evidence_reward"), F.array(k % 9, (k + 3) % 9).cast("array<int>").alias("gold_pages"),
        F.struct((k % 3).cast("int").alias("retries_used"), _pick(ENDS, k).alias("loop_terminated"), F.when(k % 3 == 2, k % 2 == 0).alias("loop_retry_helped")).alias("telemetry"), F.struct(steps.alias("steps")).alias("trace"),
    )


_L = f"(SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_suppkey AS s, {_sql_pick(STAGES, 'l_suppkey')} AS stage, {_sql_pick(ACTIONS, 'l_partkey')} AS action, CASE WHEN l_partkey % 4 < 2 THEN {_sql_pick(TOOLS, 'l_suppkey')} END AS tool, {_sql_pick(NEXT, 'l_partkey')} AS next, l_quantity::BIGINT AS tin, l_linenumber::BIGINT AS tout, (l_quantity * 10)::BIGINT AS lat, l_extendedprice / 1e6 AS usd FROM lineitem)"
_R = f"""(SELECT k, CASE k % 4 WHEN 0 THEN 'Unanswerable' WHEN 1 THEN 'n/a' ELSE 'x' END AS pred, CASE WHEN k % 3 = 0 THEN 'AnswerType.UNANSWERABLE' ELSE 'numeric' END AS typ, (k % 2)::DOUBLE AS correct, (k % 5) > 0 AS earned, [k % 9, (k + 3) % 9] AS gold, (k % 3)::BIGINT AS retries,
 {_sql_pick(ENDS, 'k')} AS ended, CASE WHEN k % 3 = 2 THEN k % 2 = 0 END AS helped FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem))"""
_M = f"""WITH l AS {_L}, r AS {_R}, pg AS (SELECT k, arg_min([s % 9, p % 9, (s + p) % 9], (ln, p, s)) AS pages FROM l WHERE stage = 'route_pages' GROUP BY k), vf AS (SELECT k, arg_min(p % 2 = 0, (ln, p, s)) AS sup FROM l WHERE stage = 'verify' GROUP BY k),
tl AS (SELECT k, list(coalesce(tool, action) ORDER BY ln, p, s) AS seq FROM l WHERE tool IS NOT NULL OR action = 'tool_call' GROUP BY k),
m AS (SELECT r.*, coalesce(pages, []) AS pages, coalesce(seq, []) AS seq, sup, k % 4 < 2 AS gone FROM r LEFT JOIN pg USING (k) LEFT JOIN vf USING (k) LEFT JOIN tl USING (k)),
x AS (SELECT k::VARCHAR AS example_id, typ, list_has_any(pages[1:1], gold)::INT::DOUBLE AS hit_1, list_has_any(pages[1:3], gold)::INT::DOUBLE AS hit_3, list_has_any(pages[1:5], gold)::INT::DOUBLE AS hit_5, coalesce(len(list_filter(pages, lambda q: list_contains(gold, q))) / nullif(len(pages), 0)::DOUBLE, 0) AS precision_5, len(pages) AS pages,
 gone AS abstained, gone AND typ <> 'numeric' AS rightly, correct < 1 AND coalesce(sup, true) = false AS caught, retries, CASE WHEN ended IN ('accepted', 'abstained', 'exhausted') THEN ended ELSE 'no_loop' END AS ended, CASE WHEN retries > 0 THEN coalesce(helped, false) END AS helped, array_to_string(seq, ',') AS sequence, len(list_distinct(seq)) AS n_tools, CASE WHEN earned THEN len(seq) ELSE 0 END AS useful, CASE WHEN earned THEN 0 ELSE len(seq) END AS irrelevant FROM m)"""


@query(f"{_M} SELECT example_id, hit_1, hit_3, hit_5, round(precision_5, 6) AS precision_5, pages, abstained, rightly, caught, retries, ended, helped, sequence, n_tools, useful, irrelevant FROM x")
def stage_metrics_records(spark, sf_dir):
    m = sg.stage_metrics(traces(spark, sf_dir))
    return r6(m.select("example_id", "routing.*", "reasoning.*", "loop.*", F.array_join("tools.sequence", ",").alias("sequence"), F.size("tools.distinct").alias("n_tools"), "tools.useful", "tools.irrelevant"))


@query(f"{_M} SELECT typ AS answer_type, count(*) AS n, round(avg(hit_1), 6) AS hit_1, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5, round(avg(precision_5), 6) AS precision_5, round(avg(pages), 6) AS pages_mean, round(avg(abstained::INT), 6) AS abstention_rate, round(avg(rightly::INT), 6) AS correct_abstention_rate, round(avg(caught::INT), 6) AS caught_rate, round(avg(retries), 6) AS retries_mean, round(avg(helped::INT), 6) AS retry_helped_rate, {', '.join(f'''round(avg((ended = '{e}')::INT), 6) AS ended_{e}''' for e in sg.LOOP_ENDS)} FROM x GROUP BY typ")
def stage_metrics_aggregate(spark, sf_dir):
    return r6(sg.aggregate(sg.stage_metrics(traces(spark, sf_dir)), "answer_type"))


@query(f"SELECT k::VARCHAR AS example_id, stage, sum(tin + tout)::BIGINT AS tokens, round(sum(usd::DECIMAL(24,12)), 6)::DOUBLE AS usd, sum(lat)::BIGINT AS latency_ms, count(*) FILTER (tool IS NOT NULL OR action = 'tool_call') AS tool_calls FROM {_L} GROUP BY k, stage")
def stage_efficiency_records(spark, sf_dir):
    return r6(sg.efficiency(traces(spark, sf_dir)))


_F = f"""WITH l AS {_L}, f AS (SELECT k, count(*) AS n_steps, count(*) FILTER (action = 'tool_call') AS tool_calls, count(*) FILTER (action = 'tool_error') AS tool_errors, bool_or(stage = 'expand_context') AS expanded, coalesce(sum(ln) FILTER (stage = 'expand_context'), 0)::BIGINT AS neighbours,
 arg_max(p % 2 = 0, (ln, p, s)) FILTER (stage = 'verify') AS supported, arg_max(next, (ln, p, s)) FILTER (stage = 'verify') AS next_action,
 coalesce(list(CASE WHEN stage = 'expand_context' THEN stage ELSE tool END ORDER BY ln, p, s) FILTER (tool IS NOT NULL OR (stage = 'expand_context' AND action <> 'passthrough')), []) AS seq, coalesce(list('E' || (p % 3) ORDER BY ln, p, s) FILTER (action = 'tool_error'), []) AS errors FROM l GROUP BY k),
d AS (SELECT f.*, r.* EXCLUDE (k) FROM f JOIN {_R} r USING (k))"""


@query(f"{_F} SELECT k::VARCHAR AS example_id, correct, n_steps, tool_calls, tool_errors, n_steps AS iterations, expanded, neighbours, supported, next_action, array_to_string(seq, ',') AS sequence, len(list_distinct(seq)) AS n_selected, array_to_string(errors, ',') AS errors, retries, ended, helped, earned FROM d")
def trace_facts(spark, sf_dir):
    f = dg.trace_facts(traces(spark, sf_dir), "example_id")
    return r6(f.withColumns({"sequence": F.array_join("sequence", ","), "n_selected": F.size("selected"), "errors": F.array_join("errors", ",")}).drop("selected"))


@query(f"{_F} SELECT ended, count(*) AS n, sum(n_steps)::BIGINT AS n_steps, sum(tool_calls)::BIGINT AS n_tool_calls, sum(tool_errors)::BIGINT AS n_tool_errors, count(*) FILTER (correct >= 1) AS answers_correct, round(avg(tool_calls), 6) AS tool_calls_mean, round(avg(n_steps), 6) AS iterations_mean, round(avg(retries), 6) AS retries_mean, round(avg((retries > 0)::INT), 6) AS retry_rate, round(avg((NOT supported)::INT), 6) AS unsupported_rate, round(avg(expanded::INT), 6) AS expanded_rate, round(avg(neighbours), 6) AS neighbours_mean, round(avg(helped::INT), 6) AS retry_helped_rate, round(avg(CASE WHEN earned THEN len(seq) ELSE 0 END), 6) AS useful_mean, round(avg(CASE WHEN earned THEN 0 ELSE len(seq) END), 6) AS irrelevant_mean FROM d GROUP BY ended")
def trace_diagnosis(spark, sf_dir):
    return r6(dg.diagnose_traces(dg.trace_facts(traces(spark, sf_dir)), "ended"))


@query(f"{_F} SELECT next_action AS value, count(*) AS n, count(*) FILTER (correct < 1) AS n_wrong, count(*) FILTER (supported = false) AS n_unsupported FROM d WHERE next_action IS NOT NULL GROUP BY next_action")
def next_action_histogram(spark, sf_dir):
    return dg.histogram(dg.trace_facts(traces(spark, sf_dir)), F.col("next_action"))


@query(f"{_F} SELECT value, count(*) AS n, count(*) FILTER (correct < 1) AS n_wrong, count(*) FILTER (supported = false) AS n_unsupported FROM (SELECT unnest(errors) AS value, correct, supported FROM d) GROUP BY value")
def tool_error_histogram(spark, sf_dir):
    f = dg.trace_facts(traces(spark, sf_dir)).withColumn("error", F.explode("errors"))
    return dg.histogram(f, F.col("error"))


@query(f"SELECT k::VARCHAR AS example_id, stage, count(*) AS n_steps, min(i)::BIGINT AS first_step, coalesce(array_to_string(list(tool ORDER BY i) FILTER (tool IS NOT NULL), ','), '') AS tools FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ln, p, s) - 1 AS i FROM {_L}) GROUP BY k, stage")
def stage_notes(spark, sf_dir):
    return r6(dg.stage_notes(traces(spark, sf_dir)))


@query(f"{_F} SELECT k::VARCHAR AS example_id, pred AS answer, supported, next_action, array_to_string(seq, ',') AS sequence, retries, ended FROM d")
def record_summaries(spark, sf_dir):
    s = dg.record_summary(traces(spark, sf_dir)).select("example_id", "summary.*")
    return r6(s.select("example_id", "answer", "supported", "next_action", F.array_join("sequence", ",").alias("sequence"), "retries", "ended"))


# ---- whole evaluations

_EVAL = f"""WITH s AS (SELECT example_id AS id, domain, (CASE kind WHEN 'numeric' THEN {cat._NUMERIC} WHEN 'boolean' THEN {cat._BOOL} WHEN 'multiple_choice' THEN {cat._CHOICE} WHEN 'unanswerable' THEN {cat._ABST('pred', cat.an.ABSTAIN_SCORING)} ELSE {cat._EXACT} END)::INT::DOUBLE AS correct, pred FROM {cat._SCORED}),
io AS (SELECT g.doc AS id, max({cat._IOU}) AS iou FROM {cat._JOIN} GROUP BY g.doc), n AS (SELECT doc AS id, count(DISTINCT page) FILTER (is_gold) AS pages, count(*) FILTER (NOT is_gold) AS cited FROM {cat.BOX} GROUP BY doc), h AS (SELECT g.doc AS id, count(DISTINCT g.page) AS hit FROM {cat._JOIN} GROUP BY g.doc),
e AS (SELECT id, domain, pred, correct, CASE WHEN coalesce(pages, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(hit, 0) / pages::DOUBLE END AS recall, coalesce(iou, 0)::DOUBLE AS iou, id % 3 AS tool_calls, coalesce(cited, 0) AS cited FROM s LEFT JOIN io USING (id) LEFT JOIN n USING (id) LEFT JOIN h USING (id))"""


def evaluated(spark, sf_dir) -> DataFrame:
    a, b = vw.answers(spark, sf_dir), vw.boxes(spark, sf_dir).withColumn("page", F.col("page").cast("int"))
    gold = b.where("is_gold").groupBy("doc").agg(F.collect_list(F.struct("page", "x0", "y0", "x1", "y1")).alias("boxes"), F.collect_set("page").alias("pages"))
    cited = b.where("not is_gold").groupBy("doc").agg(F.collect_list(F.struct("page", F.array("x0", "y0", "x1", "y1").alias("bbox"))).alias("citations"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    boxes = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    examples = a.join(gold, a["example_id"] == gold["doc"], "left").select(F.col("example_id").alias("id"), "domain", F.col("gold").alias("answer"), "answer_type", "tolerance", none("pages", "array<int>").alias("supporting_pages"), none("boxes", boxes).alias("supporting_bboxes"), F.array().cast(boxes).alias("alternate_bboxes"))
    predictions = a.join(cited, a["example_id"] == cited["doc"], "left").select("example_id", F.col("pred").alias("answer_pred"), none("citations", "array<struct<page:int,bbox:array<double>>>").alias("citations"), (F.col("example_id") % 3).cast("int").alias("tool_calls"))
    return evaluation.score(examples, predictions)


@query(f"{_EVAL} SELECT id AS example_id, correct AS answer_correct, round(recall, 6) AS page_recall, round(iou, 6) AS bbox_iou, round(CASE WHEN tool_calls = 0 OR cited = 0 THEN 0 ELSE greatest(0, least(1, correct * recall * iou)) END, 6) AS evidence_reward, (tool_calls = 0 OR cited = 0)::BIGINT AS is_lazy FROM e")
def score_records(spark, sf_dir):
    return r6(evaluated(spark, sf_dir).select("example_id", "answer_correct", "page_recall", "bbox_iou", "evidence_reward", "is_lazy"))


@query(f"{_EVAL} SELECT domain, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg((contains(lower(pred), 'unanswerable') OR contains(lower(pred), 'cannot be determined') OR contains(lower(pred), 'n/a'))::INT), 6) AS abstain_rate, round(avg(recall), 6) AS page_recall, round(avg(iou), 6) AS bbox_iou, round(sum(id % 7 / 10.0::DOUBLE), 6) AS usd_total, round(sum(id % 7 / 10.0::DOUBLE) / nullif(count(*) FILTER (correct <> 0), 0), 6) AS usd_per_correct, sum(id % 11)::BIGINT AS tokens_in, sum(id % 13)::BIGINT AS tokens_out, round(avg(id % 17), 6) AS latency_ms_mean FROM e GROUP BY domain")
def run_summary(spark, sf_dir):
    i = F.col("example_id")
    r = evaluated(spark, sf_dir).withColumns({"usd": (i % 7) / 10.0, "tokens_in": i % 11, "tokens_out": i % 13, "latency_ms": (i % 17).cast("double")})
    return r6(dg.run_summary(r, "domain"))


@query(f"SELECT l_orderkey AS example_id, l_linenumber::BIGINT AS line, l_partkey AS part, l_suppkey AS supp FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def filter_by_ids(spark, sf_dir):
    ids = vw.table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("example_id"))
    return r6(cm.only_ids(vw.records(spark, sf_dir).select("example_id", "line", "part", "supp"), ids, "example_id"))


@query("SELECT l_orderkey AS example_id, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS part, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS domain FROM lineitem GROUP BY 1")
def last_by_id(spark, sf_dir):
    return rd.last_by_id(vw.records(spark, sf_dir).select("example_id", "line", "part", "supp", "domain"), ["line", "part", "supp"], "example_id").select("example_id", "part", "domain")


@query(f"SELECT o_orderkey::VARCHAR AS id, ['dev', 'dev', 'test'][(o_orderkey % 3 + 1)::INT] AS split, coalesce(n, 0) AS n_boxes, round(coalesce(x, 0), 6) AS sum_x0, 1 AS visual FROM orders LEFT JOIN (SELECT doc, count(*) AS n, sum(x0) AS x FROM {cat.BOX} WHERE is_gold GROUP BY doc) ON doc = o_orderkey")
def typed_examples(spark, sf_dir):
    b = vw.boxes(spark, sf_dir).where("is_gold").groupBy("doc").agg(F.to_json(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "x0", "y0", "x1", "y1"))).alias("supporting_bboxes"))
    o = vw.table(spark, sf_dir, "orders").join(b, F.col("doc") == F.col("o_orderkey"), "left")
    none = F.lit(None).cast("int")
    raw = o.select(F.col("o_orderkey").cast("string").alias("id"), _pick(("validation", "val", "test"), F.col("o_orderkey")).alias("split"), "supporting_bboxes", F.lit("not json").alias("alternate_bboxes"), *[none.alias(f"difficulty_{d}") for d in ("visual", "reasoning", "localization")])
    t = rd.typed_examples(raw)
    return r6(t.select("id", "split", F.size("supporting_bboxes").alias("n_boxes"), F.aggregate("supporting_bboxes", F.lit(0.0), lambda a, x: a + x["x0"]).alias("sum_x0"), F.col("difficulty.visual").alias("visual")))


@query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4 END AS first_page, CASE WHEN o_orderkey % 5 > 0 THEN 2 ELSE 0 END AS n_pages, 'p' || o_custkey || ',q' AS images, 'r' || o_orderkey % 9 AS distractor, '{"kind":"' || o_orderstatus || '"}' AS relation,
  CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_custkey % 4 = 0 THEN 1 ELSE o_custkey % 4 END::BIGINT AS visual, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 ELSE 1 END::BIGINT AS reasoning FROM orders""")
def decoded_examples(spark, sf_dir):
    """Rows whose lists and difficulty come as JSON texts, some of them broken."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = vw.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.lit("val").alias("split"), F.lit(None).cast("string").alias("supporting_bboxes"), F.lit("[]").alias("alternate_bboxes"), F.when(k % 5 > 0, F.format_string("[%d, 7]", c % 4)).otherwise("[1, ").alias("supporting_pages"),
        F.format_string('["p%d", 3, null, "q", {"a": 1}]', c).alias("page_images"), F.format_string('["r%d"]', k % 9).alias("distractor_region_ids"), F.format_string('[{"kind":"%s"}]', "o_orderstatus").alias("evidence_relations"),
        F.when(k % 3 == 0, F.format_string('{"visual": 2, "reasoning": %d}', c % 5)).when(k % 3 == 1, "").alias("difficulty"), (c % 4).cast("int").alias("difficulty_visual"),
    )
    t = rd.typed_examples(raw)
    n = F.coalesce(F.size("supporting_pages"), F.lit(0))
    return r6(t.select("id", F.get("supporting_pages", F.lit(0)).alias("first_page"), F.greatest(n, F.lit(0)).alias("n_pages"), F.array_join("page_images", ",").alias("images"), F.get("distractor_region_ids", F.lit(0)).alias("distractor"), F.get("evidence_relations", F.lit(0)).alias("relation"), "difficulty.visual", "difficulty.reasoning"))


# ---- evidence and regions

_ITEMS = "(SELECT text AS question, substr(text, 1, 20) AS answer, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark)"
_W = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, question, answer FROM documents JOIN {_ITEMS} ON doc_id % (SELECT count(*) FROM benchmark) = i),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, {_W.format('question')} AS q, {_W.format('answer')} AS a FROM d),
o AS (SELECT *, len(list_intersect({_W.format('line')}, q)) AS nq, len(list_intersect({_W.format('line')}, a)) AS na FROM l),
s AS (SELECT doc_id, i, line, least(8, 2 * nq) + least(4, 2 * na) + CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END AS score FROM o WHERE nq > 0 OR na > 0)
SELECT doc_id, line, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM s WHERE score > 0) WHERE rank <= 6""")
def repair_lines(spark, sf_dir):
    q = vw.questions(spark, sf_dir)
    n = max(1, q.count())
    from pyspark.sql import Window

    q = q.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("question_id")) - 1)  # over items, a bounded list
    d = vw.table(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(n)).cast("int").alias("_i"))
    p = d.join(q, "_i").select("doc_id", F.col("doc_id").alias("packet_id"), F.col("doc_id").alias("ordinal"), "text", "question", F.substring("question", 1, 20).alias("answer"), (F.col("doc_id") % 2 == 0).alias("cited"))
    return r6(ev.repair_lines(p, ["doc_id"]).select("doc_id", "line", "score", "rank"))


_PK = f"(SELECT *, part || ':' || supp || ':' || line AS packet_id, part * 1000000 + supp * 10 + line AS ordinal, supp % 2 = 0 AS cited, is_gold AS target FROM {cat.BOX})"


def packets(spark, sf_dir) -> DataFrame:
    return vw.boxes(spark, sf_dir).withColumns({"packet_id": F.concat_ws(":", "part", "supp", "line"), "ordinal": F.col("part") * 1000000 + F.col("supp") * 10 + F.col("line"), "cited": F.col("supp") % 2 == 0, "target": F.col("is_gold")})


@query(f"""WITH p AS {_PK}, t AS (SELECT doc, page, avg((x0 + x1) / 2) AS tx, avg((y0 + y1) / 2) AS ty FROM p WHERE target GROUP BY ALL), n AS (SELECT p.*, tx, ty FROM p JOIN t USING (doc, page) WHERE NOT target)
SELECT doc, packet_id, 'target' AS why FROM p WHERE target UNION ALL SELECT doc, packet_id, 'cited' FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS r FROM n WHERE cited) WHERE r <= 2
UNION ALL SELECT doc, packet_id, 'visual' FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(sqrt(((x0 + x1) / 2 - tx) ** 2 + ((y0 + y1) / 2 - ty) ** 2), 9), packet_id) AS r FROM n WHERE NOT cited AND region_type = 'picture') WHERE r <= 2""")
def focused_packets(spark, sf_dir):
    return ev.focused_packets(packets(spark, sf_dir), ["doc"])


_CL = "greatest(0, least(1, {}))"


@query(f"SELECT doc, page::BIGINT AS page, count(*) AS n, {', '.join(f'round({_CL.format(e)}, 6) AS {c}' for c, e in (('x0', 'min(x0) - 0.14'), ('y0', 'min(y0) - 0.14'), ('x1', 'max(x1) + 0.14'), ('y1', 'max(y1) + 0.14')))} FROM {cat.BOX} WHERE is_gold GROUP BY doc, page HAVING count(*) >= 2")
def target_unions(spark, sf_dir):
    return r6(ex.target_unions(packets(spark, sf_dir), ["doc", "page"]))


_DET = f"(SELECT doc, page, 'r' || line || '_p' || page AS region_id, {', '.join(f'{_CL.format(f'{c} * 1200 / {s}')} AS {c}' for c, s in (('x0', 1000), ('y0', 1300), ('x1', 1000), ('y1', 1300)))}, region_type, score FROM {cat.BOX} WHERE NOT is_gold AND score >= 0.5)"


def detected(spark, sf_dir) -> DataFrame:
    b = vw.boxes(spark, sf_dir).where("not is_gold").withColumns({"width": F.lit(1000.0), "height": F.lit(1300.0), "idx": F.col("line"), "label": F.upper("region_type"), **{c: F.col(c) * 1200 for c in ("x0", "y0", "x1", "y1")}})
    return ex.detections(b, ["doc"], "page", 0.5)


@query(f"SELECT doc, page::BIGINT AS page, region_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))}, region_type, round(score, 6) AS score FROM {_DET}")
def layout_detections(spark, sf_dir):
    return r6(detected(spark, sf_dir))


@query(f"SELECT p.doc, p.page::BIGINT AS page, coalesce(region_id, 'page_' || p.page) AS region_id, round(coalesce(x0, 0), 6) AS x0, round(coalesce(y0, 0), 6) AS y0, round(coalesce(x1, 1), 6) AS x1, round(coalesce(y1, 1), 6) AS y1, round(coalesce(score, 0), 6) AS score, CASE WHEN region_id IS NULL THEN 'no_detections' ELSE 'detected' END AS signal FROM (SELECT DISTINCT doc, page FROM {cat.BOX}) p LEFT JOIN {_DET} d ON d.doc = p.doc AND d.page = p.page")
def propose_regions(spark, sf_dir):
    return r6(ex.propose_regions(vw.boxes(spark, sf_dir).select("doc", "page").distinct(), detected(spark, sf_dir), ["doc"], "page"))


@query(f"WITH p AS {_PK} SELECT a.doc, a.page::BIGINT AS page, b.packet_id AS crop_id, a.packet_id AS span_id FROM p a JOIN p b ON a.doc = b.doc AND a.page = b.page WHERE NOT a.target AND b.target AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1")
def spans_in_crops(spark, sf_dir):
    p = packets(spark, sf_dir)
    return r6(ex.spans_in_crops(p.where("not target").withColumn("span_id", F.col("packet_id")), p.where("target").withColumn("crop_id", F.col("packet_id")), ["doc", "page"]))


_CON = "({0}.x0 <= {1}.x0 AND {0}.y0 <= {1}.y0 AND {0}.x1 >= {1}.x1 AND {0}.y1 >= {1}.y1)"


@query(f"""WITH p AS {_PK}, j AS (SELECT g.doc, g.page, g.packet_id AS target_id, p.packet_id, CASE WHEN {_CON.format('g', 'p')} OR {_CON.format('p', 'g')} THEN 0 WHEN {cat._I} / nullif(least({cat._AR.format('g')}, {cat._AR.format('p')}), 0) >= 0.25 THEN 1 ELSE 2 END AS bucket,
round(sqrt(((p.x0 + p.x1) / 2 - (g.x0 + g.x1) / 2) ** 2 + ((p.y0 + p.y1) / 2 - (g.y0 + g.y1) / 2) ** 2), 9) AS d, round({cat._AR.format('p')}, 9) AS a FROM p g JOIN p ON g.doc = p.doc AND g.page = p.page WHERE g.target AND NOT p.target)
SELECT doc, page::BIGINT AS page, target_id, packet_id, bucket::BIGINT AS bucket, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, target_id ORDER BY bucket, d, a, packet_id) AS rank FROM j) WHERE rank <= 2""")
def packet_siblings(spark, sf_dir):
    return r6(ex.siblings(packets(spark, sf_dir), ["doc", "page"]))


@query(f"""WITH p AS (SELECT *, x0 + CASE part % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 5e-7 ELSE 0 END AS sx FROM {_PK} WHERE target), r AS {_PK}
SELECT p.doc, p.page::BIGINT AS page, p.packet_id, coalesce(min(r.ordinal)::VARCHAR, 'synth_' || p.packet_id) AS primary_id, min(r.ordinal) IS NOT NULL AS matched FROM p LEFT JOIN r ON r.doc = p.doc AND r.page = p.page AND abs(r.x0 - p.sx) <= 1e-6 AND abs(r.y0 - p.y0) <= 1e-6 AND abs(r.x1 - p.x1) <= 1e-6 AND abs(r.y1 - p.y1) <= 1e-6 GROUP BY p.doc, p.page, p.packet_id""")
def match_primary(spark, sf_dir):
    p = packets(spark, sf_dir)
    shift = F.when(F.col("part") % 3 == 0, 0.01).when(F.col("part") % 3 == 1, 5e-7).otherwise(0.0)
    own = p.where("target").select("doc", "page", "packet_id", (F.col("x0") + shift).alias("x0"), "y0", "x1", "y1", "region_type", F.lit(0.5).alias("confidence"))
    return r6(ex.match_primary(own, p.withColumn("region_id", F.col("ordinal")), ["doc", "page"]).select("doc", "page", "packet_id", "primary_id", "matched"))


@query(f"WITH p AS (SELECT doc, packet_id, min(page) AS page, min(x0) AS x0 FROM {_PK} GROUP BY ALL HAVING bool_or(cited)) SELECT doc, count(*) AS n, sum(page)::BIGINT AS pages, round(sum(x0), 6) AS x0 FROM p GROUP BY doc")
def packet_citations(spark, sf_dir):
    own = packets(spark, sf_dir).groupBy("doc", "packet_id").agg(F.min("page").alias("page"), F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"), F.bool_or("cited").alias("cited"))
    p = own.groupBy("doc").agg(F.collect_list(F.struct("packet_id", "page", "bbox")).alias("packets"), F.collect_list(F.when(F.col("cited"), F.col("packet_id"))).alias("ids"))  # the packets of one document
    got = p.select("doc", ex.citations(F.concat(F.array(F.lit("unknown")), F.col("ids")), F.col("packets")).alias("c")).where(F.size("c") > 0)
    return r6(got.select("doc", F.size("c").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["page"]).alias("pages"), F.aggregate("c", F.lit(0.0), lambda a, x: a + F.get(x["bbox"], 0)).alias("x0")))


@query(f"SELECT run, count(*) AS n, round(avg(text::INT), 6) AS text_rate, round(avg(ctx::INT), 6) AS context_rate, round(avg(chart::INT), 6) AS chart_rate, round(avg(text::INT) FILTER (cited), 6) AS cited_text_rate, round(avg(ctx::INT) FILTER (cited), 6) AS cited_context_rate, round(avg(chart::INT) FILTER (cited), 6) AS cited_chart_rate, round(avg((NOT text AND NOT chart)::INT) FILTER (cited), 6) AS cited_image_only_rate FROM (SELECT target AS run, cited, part % 3 = 0 OR supp % 5 = 0 AS text, line % 2 = 0 AS ctx, part % 7 = 0 AS chart FROM {_PK}) GROUP BY run")
def packet_quality(spark, sf_dir):
    p = packets(spark, sf_dir).select(F.col("target").alias("run"), "cited", F.when(F.col("part") % 3 == 0, "t").alias("text_layer_snippet"), F.when(F.col("supp") % 5 == 0, "o").otherwise(" ").alias("ocr_snippet"), F.when(F.col("line") % 2 == 0, F.array(F.lit("r"))).alias("linked_crop_refs"), F.when(F.col("part") % 7 == 0, "x,y").alias("chart_csv"))
    return r6(dg.packet_quality(p, "run"))


@query(f"SELECT user_id AS trace, event_id AS source_id, event_type || '.' || kind || '.' || row_number() OVER (PARTITION BY user_id, event_type, kind ORDER BY ts, event_id) AS event_id FROM (SELECT *, 'k' || (event_id % 2) AS kind FROM events)")
def debug_event_ids(spark, sf_dir):
    s = vw.steps(spark, sf_dir).select("trace", "ts", F.col("event_id").alias("source_id"), "stage", F.concat(F.lit("k"), F.col("event_id") % 2).alias("event_type"))
    return ev.event_ids(s, ["trace"], ["ts", "source_id"]).select("trace", "source_id", "event_id")


@query("SELECT o_orderkey AS example_id, CASE WHEN u < 0.25 THEN 2 WHEN u < 0.75 THEN 4 ELSE 8 END::BIGINT AS tiles FROM (SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::UBIGINT / 4294967296.0 AS u FROM orders)")
def tile_sizes(spark, sf_dir):
    return r6(vw.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id"), ev.tile_size(F.col("o_orderkey").cast("string")).alias("tiles")))


@query("SELECT doc, page FROM (SELECT source AS doc, doc_id AS page, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || source || ':' || doc_id), doc_id) AS r FROM documents WHERE doc_id % 3 <> 0) WHERE r <= 3")
def noise_pages(spark, sf_dir):
    pages = vw.page_texts(spark, sf_dir).select("doc", "page")
    return ev.noise_pages(pages, pages.where("page % 3 = 0"), ["doc"], "page", 3, 7)


@query("SELECT conv_id, turn, sha256('{\"role\":' || to_json(role) || ',\"score\":' || printf('%.4f', turn / 7.0::DOUBLE) || ',\"text\":\"' || sha256(text) || '\"}') AS key FROM conversations")
def canonical_cache_key(spark, sf_dir):
    t = vw.turns(spark, sf_dir)
    body = rd.canonical_json(role=rd.json_text(F.col("role")), score=rd.json_number(F.col("turn") / 7.0), text=rd.json_text(F.sha2("text", 256)))
    return t.select("conv_id", "turn", F.sha2(body, 256).alias("key"))


# ---- recorded responses and retries


@query("SELECT o_orderkey AS key, o_orderkey % 3 <> 0 AS recorded, CASE WHEN o_orderkey % 3 = 1 THEN 'table_note_fusion' ELSE 'unknown' END AS family, CASE WHEN o_orderkey % 3 = 1 THEN 'table' ELSE 'text,image' END AS types, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'cross_page' ELSE 'easy_local' END AS budget, 'hybrid' AS route FROM orders")
def plan_with_fallback(spark, sf_dir):
    k = F.col("o_orderkey")
    o = vw.table(spark, sf_dir, "orders").select(k.alias("key"))
    body = F.format_string('{"question_family": "table_note_fusion", "evidence_types": ["table"], "budget_class": "%s"}', F.when(F.col("key") % 2 == 0, "cross_page").otherwise("huge"))
    recorded = o.where("key % 3 <> 0").select("key", F.when(F.col("key") % 3 == 1, body).otherwise("I can't plan that.").alias("text"))
    p = recorded_plans.planned(o, recorded)
    return p.select("key", "recorded", F.col("plan.question_family").alias("family"), F.array_join("plan.evidence_types", ",").alias("types"), F.col("plan.budget_class").alias("budget"), F.col("plan.routing_policy").alias("route"))


@query("SELECT o_orderkey AS key, CASE WHEN (o_orderkey + 1) % 4 = 0 THEN 1 WHEN (o_orderkey + 2) % 4 = 0 THEN 2 ELSE 3 END::BIGINT AS tries, CASE WHEN o_orderkey % 4 = 0 THEN 'exhausted' ELSE 'accepted' END AS status FROM orders")
def retry_resolution(spark, sf_dir):
    o = vw.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    attempt = lambda df, n: df.select("key", ((F.col("key") + n + 1) % 4 == 0).alias("supported"))
    return r6(recorded_plans.resolve(o, attempt, 3, "key").select("key", "tries", "status"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 < 3 THEN 'computed' ELSE 'given' END AS answer, o_orderkey % 2 = 0 AND o_orderkey % 5 < 3 AS overridden FROM orders")
def deterministic_override(spark, sf_dir):
    o = vw.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    given = o.select("key", F.lit("given").alias("answer"), (F.col("key") % 2 == 1).alias("supported"))
    return recorded_plans.deterministic_override(given, o.where("key % 5 < 3").withColumn("answer", F.lit("computed")), "key").select("key", "answer", "overridden")


@query("SELECT conv_id, count(*) AS n_packets, string_agg('[' || r || '] ' || t, chr(10) ORDER BY r) AS prompt FROM (SELECT conv_id, t, row_number() OVER (PARTITION BY conv_id ORDER BY o, t) AS r FROM (SELECT conv_id, substr(trim(text), 1, 600) AS t, min(turn) AS o FROM conversations WHERE coalesce(trim(text), '') <> '' GROUP BY 1, 2)) GROUP BY conv_id")
def prompt_assembly(spark, sf_dir):
    return r6(recorded_plans.prompts(vw.turns(spark, sf_dir), ["conv_id"], "turn"))


# ---- retries over recorded responses

MACHINE_ACTIONS = ("accept", "abstain", "retry_localization", "expand_context", "escalate_reasoner", "ask_again")
MACHINE = rm.Policy(max_retries=2, max_evidence_retries=3)


def recorded_attempts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, answers, verdicts): an order is a question, each of its lines a region and what was recorded for one attempt."""
    # lines are ordered as whole structs, so that the three tables need the same columns and rows and share one shuffle by the order's key; equal lines stay as read
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.monotonically_increasing_id().alias("read"), "l_quantity", "l_discount", "l_tax").alias("line")
    w = Window.partitionBy("example_id").orderBy("line")  # the lines of one order
    lines = vw.table(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(F.col("l_orderkey").alias("example_id"), line).withColumn("attempt", F.row_number().over(w) - 1)
    p, s, n = F.col("line.l_partkey"), F.col("line.l_suppkey"), F.col("attempt").cast("string")
    region = F.struct(F.concat(F.lit("p"), n).alias("id"), (F.col("line.l_discount") * 5).alias("confidence"))
    near = F.struct(F.concat(F.lit("p"), n).alias("of"), F.concat(F.lit("n"), n).alias("id"), (F.col("line.l_tax") * 2).alias("distance"))
    questions = lines.groupBy("example_id").agg(F.array_sort(F.collect_list(region)).alias("regions"), F.array_sort(F.collect_list(near)).alias("neighbours"))
    questions = questions.select("*", F.lit("What is stated?").alias("question"), F.when(F.col("example_id") % 3 == 0, "AnswerType.UNANSWERABLE").otherwise("numeric").alias("answer_type"))
    cites = F.array(F.concat(F.lit("p"), (s % 4).cast("string")), F.concat(F.lit("n"), (p % 4).cast("string")))
    answer = lambda gone, shift: F.when(gone, "Unanswerable").otherwise(F.concat(F.lit("V"), (s % 90 + shift).cast("string")))
    said = lambda answer, confidence, nudged: F.struct(answer.alias("answer"), confidence.alias("confidence"), F.lit(nudged).alias("nudged"))
    both = F.array(said(answer(s % 4 == 0, 100), F.col("line.l_quantity") / 50, False), F.when((F.col("attempt") == 0) & (s % 3 == 0), said(answer(s % 8 == 0, 300), F.lit(0.5), True)))
    answers = lines.select("example_id", "attempt", cites.alias("citations"), F.inline(F.array_compact(both)))
    verdicts = lines.select("example_id", "attempt", (p % 6 == 0).alias("supported"), _pick(MACHINE_ACTIONS, p).alias("next_action"), F.array(F.concat(F.lit("p"), (p % 4).cast("string"))).alias("targets"), (s % 5 == 0).alias("shape_failure"))
    return questions, answers, verdicts


_MACHINE = f"""WITH RECURSIVE ln AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS a FROM lineitem),
rec AS MATERIALIZED (SELECT l_orderkey AS k, a, CASE WHEN l_suppkey % 4 = 0 THEN 'Unanswerable' ELSE 'V' || (l_suppkey % 90 + 100) END AS answer, ['p' || (l_suppkey % 4), 'n' || (l_partkey % 4)] AS cites, l_quantity / 50 AS conf, l_partkey % 6 = 0 AS sup,
  {_sql_pick(MACHINE_ACTIONS, 'l_partkey')} AS act, ['p' || (l_partkey % 4)] AS targets, l_suppkey % 5 = 0 AS shape, l_suppkey % 3 = 0 AS again, CASE WHEN l_suppkey % 8 = 0 THEN 'Unanswerable' ELSE 'V' || (l_suppkey % 90 + 300) END AS answer2 FROM ln),
q AS MATERIALIZED (SELECT l_orderkey AS k, list({{'id': 'p' || a, 'c': l_discount * 5}} ORDER BY a) AS regions, list({{'of': 'p' || a, 'id': 'n' || a, 'd': l_tax * 2}} ORDER BY a) AS near, l_orderkey % 3 = 0 AS untyped FROM ln GROUP BY l_orderkey),
s0 AS (SELECT q.*, list_transform(list_filter(regions, lambda r: r.c >= 0.3::DOUBLE), lambda r: r.id) AS e0 FROM q),
s1 AS (SELECT s0.*, list_concat(e0, list_transform(list_filter(near, lambda n: list_contains(e0, n.of) AND n.d <= 0.08::DOUBLE), lambda n: n.id)) AS ev FROM s0),
s2 AS (SELECT s1.*, r.*EXCLUDE (k, cites, answer, conf), list_filter(r.cites, lambda c: list_contains(ev, c)) AS ci, r.answer AS an1, r.conf AS cf1 FROM s1 JOIN rec r ON r.k = s1.k AND r.a = 0),
s3 AS (SELECT s2.*, an1 = 'Unanswerable' AND len(ci) > 0 AND again AS asked FROM s2),
m AS (
  SELECT k, 0 AS a, regions, near, untyped, 0.3::DOUBLE AS th, 0.08::DOUBLE AS pad, ev, ev AS scope, CASE WHEN asked AND answer2 <> 'Unanswerable' THEN answer2 ELSE an1 END AS an, ci, CASE WHEN asked AND answer2 <> 'Unanswerable' THEN 0.5::DOUBLE ELSE cf1 END AS cf, sup, act, targets, shape, 0 AS er, false AS tr,
    'plan route_pages localize rerank inspect expand_context answer ' || CASE WHEN asked THEN 'answer ' ELSE '' END || 'verify' AS st,
    CASE WHEN asked AND answer2 <> 'Unanswerable' THEN answer2 ELSE an1 END AS i_an, ci AS i_ci, CASE WHEN asked AND answer2 <> 'Unanswerable' THEN 0.5::DOUBLE ELSE cf1 END AS i_cf, ev AS i_scope, sup AS i_sup,
    NOT sup AS has_b, CASE WHEN asked AND answer2 <> 'Unanswerable' THEN answer2 ELSE an1 END AS b_an, ci AS b_ci, CASE WHEN asked AND answer2 <> 'Unanswerable' THEN 0.5::DOUBLE ELSE cf1 END AS b_cf, ev AS b_scope, false AS lost FROM s3
  UNION ALL
  SELECT k, a, regions, near, untyped, th, pad, ev, scope, CASE WHEN lost THEN an ELSE r_an END, CASE WHEN lost THEN ci ELSE r_ci END, CASE WHEN lost THEN cf ELSE r_cf END, CASE WHEN lost THEN sup ELSE r_sup END, CASE WHEN lost THEN act ELSE r_act END, targets, shape, er, tr, st || CASE WHEN lost THEN '' ELSE ' answer verify' END, i_an, i_ci, i_cf, i_scope, i_sup,
    has_b OR (NOT lost AND NOT r_sup), CASE WHEN swap THEN r_an ELSE b_an END, CASE WHEN swap THEN r_ci ELSE b_ci END, CASE WHEN swap THEN r_cf ELSE b_cf END, CASE WHEN swap THEN scope ELSE b_scope END, lost FROM (
    SELECT *, NOT lost AND NOT r_sup AND (NOT has_b OR CASE WHEN r_an = 'Unanswerable' AND b_an <> 'Unanswerable' THEN false WHEN b_an = 'Unanswerable' AND r_an <> 'Unanswerable' THEN true WHEN len(r_ci) > 0 AND len(b_ci) = 0 THEN true WHEN len(b_ci) > 0 AND len(r_ci) = 0 THEN false ELSE r_cf - b_cf > 0 END) AS swap FROM (
    SELECT t.* EXCLUDE (targets), r.k IS NULL AS lost, r.answer AS r_an, list_filter(r.cites, lambda c: list_contains(t.scope, c)) AS r_ci, r.conf AS r_cf, r.sup AS r_sup, r.act AS r_act, coalesce(r.targets, []) AS targets, coalesce(r.shape, false) AS shape FROM (
      SELECT y.* EXCLUDE (tg, foc, lost), CASE WHEN act = 'expand_context' AND len(foc) > 0 THEN foc ELSE ev END AS scope FROM (
        SELECT x.*, list_filter(ev, lambda e: list_contains(tg, e) OR list_contains(ci, e) OR len(list_filter(near, lambda n: n.id = e AND list_contains(tg, n.of) AND n.d <= pad)) > 0) AS foc FROM (
          SELECT z.* EXCLUDE (ev, loc), CASE act WHEN 'retry_localization' THEN list_concat(loc, list_transform(list_filter(near, lambda n: list_contains(loc, n.of) AND n.d <= pad), lambda n: n.id))
            WHEN 'expand_context' THEN list_concat(ev, list_filter(list_transform(list_filter(near, lambda n: list_contains(tg, n.of) AND list_contains(ev, n.of) AND n.d <= pad), lambda n: n.id), lambda i: NOT list_contains(ev, i))) ELSE ev END AS ev FROM (
            SELECT w.*, list_transform(list_filter(regions, lambda r: r.c >= th), lambda r: r.id) AS loc, CASE WHEN len(list_filter(targets, lambda t: list_contains(ev, t))) > 0 THEN list_filter(targets, lambda t: list_contains(ev, t)) ELSE ci END AS tg FROM (
              SELECT k, a + 1 AS a, regions, near, untyped, CASE WHEN act = 'retry_localization' THEN th * 0.7::DOUBLE ELSE th END AS th, CASE WHEN act = 'expand_context' THEN least(pad * 1.5::DOUBLE, 0.3::DOUBLE) ELSE pad END AS pad, ev, an, ci, cf, sup, act, targets, er + (act = 'expand_context')::INT AS er, tr OR act <> 'escalate_reasoner' AS tr,
                st || CASE act WHEN 'retry_localization' THEN ' localize rerank inspect expand_context' WHEN 'expand_context' THEN ' expand_context' ELSE '' END AS st, i_an, i_ci, i_cf, i_scope, i_sup, has_b, b_an, b_ci, b_cf, b_scope, lost
              FROM m WHERE NOT lost AND act IN ('retry_localization', 'expand_context', 'escalate_reasoner') AND a < CASE WHEN act = 'expand_context' OR (act = 'escalate_reasoner' AND NOT sup AND len(ci) > 0 AND shape) THEN 3 ELSE 2 END
            ) w) z) x) y) t LEFT JOIN rec r ON r.k = t.k AND r.a = t.a))),
l AS (SELECT *, a > 0 AND len(i_ci) > 0 AND i_an <> 'Unanswerable' AND an = 'Unanswerable' AND (len(ci) = 0 OR list_has_any(i_ci, ci)) AND cf - i_cf <= {rm.policies.CONFIDENCE_MARGIN} AS keep, row_number() OVER (PARTITION BY k ORDER BY a DESC) AS rn FROM m),
f AS (SELECT *, CASE WHEN lost THEN 'unrecorded' WHEN act = 'accept' THEN CASE WHEN keep THEN 'accepted_preserved_initial' ELSE 'accepted' END
  WHEN act = 'abstain' THEN CASE WHEN a > 0 AND NOT untyped AND has_b AND len(b_ci) > 0 AND b_an <> 'Unanswerable' AND b_cf >= 0.45::DOUBLE THEN 'exhausted' ELSE 'abstained' END WHEN act = 'ask_again' THEN 'accepted' ELSE 'exhausted' END AS ended FROM l WHERE rn = 1),
g AS (SELECT *, ended = 'exhausted' AND NOT sup AND has_b AS weak FROM f),
h AS (SELECT *, CASE WHEN ended = 'accepted_preserved_initial' THEN i_an WHEN ended = 'abstained' THEN 'Unanswerable' WHEN weak THEN b_an ELSE an END AS answer, CASE WHEN ended = 'accepted_preserved_initial' THEN i_ci WHEN ended = 'abstained' THEN [] WHEN weak THEN b_ci ELSE ci END AS cites,
  CASE WHEN ended = 'accepted_preserved_initial' THEN i_cf WHEN weak THEN b_cf ELSE cf END AS conf, CASE WHEN ended = 'accepted_preserved_initial' THEN i_scope WHEN weak THEN b_scope ELSE scope END AS fin FROM g)"""


@query(f"{_MACHINE} SELECT k::VARCHAR AS example_id, answer, array_to_string(cites, ',') AS citations, round(conf, 6) AS confidence, ended, a::BIGINT AS retries, er::BIGINT AS evidence_retries, sup AS supported, CASE WHEN a > 0 THEN NOT i_sup AND sup AND ended <> 'accepted_preserved_initial' END AS helped, tr AND answer <> i_an AS changed, st AS stages, array_to_string(list_sort(fin), ',') AS evidence FROM h")
def retry_machine(spark, sf_dir):
    out = rm.run(*recorded_attempts(spark, sf_dir), MACHINE)
    return r6(out.withColumns({"example_id": F.col("example_id").cast("string"), "citations": F.array_join("citations", ","), "stages": F.array_join("stages", " "), "evidence": F.array_join(F.array_sort("evidence"), ",")}))


# ---- tool loops over conversations

LOOP_TOOLS = ["zoom", "ocr", "crop"]


def recorded_turns(spark, sf_dir) -> DataFrame:
    """The assistant's turns of conversations, each wrapped as a tool call, a fenced final answer, or left as it is."""
    c = vw.turns(spark, sf_dir).where("role = 'assistant'")
    pick = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    head = F.regexp_replace(F.substring("text", 1, 12), r"[^\p{L} ]", "")
    call = F.format_string('I look. {"action": "%s", "action_input": {"page": %d}}', F.element_at(F.array(*[F.lit(x) for x in (*LOOP_TOOLS, "launch")]), (F.col("turn") % 4 + 1).cast("int")), F.col("turn"))
    final = F.format_string('```json\n{"final_answer": "%s", "citations": [{"page": %d, "bbox": [0, 0, 1, 0.5]}, 7, {"page": "x"}]}\n```', head, F.col("turn"))
    return c.select("conv_id", "turn", F.when(pick < 3, call).when(pick == 3, final).otherwise(F.col("text")).alias("text"))


@query(r"""WITH t AS (SELECT conv_id, turn, text, (conv_id + turn) % 5 AS pick, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)),
h AS (SELECT *, pick >= 3 AS fin, ['zoom', 'ocr', 'crop', 'launch'][(turn % 4 + 1)::INT] AS tool FROM t WHERE r <= 6), f AS (SELECT conv_id, min(r) FILTER (fin) AS f FROM h GROUP BY conv_id),
u AS (SELECT h.*, f.f FROM h JOIN f USING (conv_id) WHERE f.f IS NULL OR r <= f.f)
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (NOT fin AND tool <> 'launch') AS n_tool_calls, count(*) FILTER (NOT fin AND tool = 'launch') AS n_errors, coalesce(string_agg(tool, ',' ORDER BY r) FILTER (NOT fin), '') AS tools, CASE WHEN any_value(f) IS NOT NULL THEN 'final' WHEN count(*) >= 6 THEN 'budget' ELSE 'open' END AS ended,
 arg_max(CASE WHEN pick < 3 THEN 'I look. {"action": "' || tool || '", "action_input": {"page": ' || turn || '}}' WHEN pick = 3 THEN regexp_replace(substr(text, 1, 12), '[^\p{L} ]', '', 'g') ELSE trim(text) END, r) AS answer, arg_max(CASE WHEN pick = 3 THEN 2 ELSE 0 END, r)::BIGINT AS n_citations FROM u GROUP BY conv_id""")
def tool_loops(spark, sf_dir):
    return r6(tl.loops(recorded_turns(spark, sf_dir), LOOP_TOOLS))
