"""Stage metrics on a nested record."""

import json

from evidora.operators import stages
from evidora.sources.readers import RECORD_SCHEMA


def test_stage_metrics(spark, tmp_path):
    steps = [
        {"stage": "route_pages", "args": {"candidates": [3, 1, 7]}, "tokens_in": 5},
        {"stage": "inspect", "tool": "zoom", "latency_ms": 10, "usd": 0.5},
        {"stage": "inspect", "action": "tool_call", "latency_ms": 5},
        {"stage": "verify", "args": {"supported": False}},
        {"stage": "verify", "args": {"supported": True}},
    ]
    rows = [
        {"example_id": "a", "answer_pred": "n/a", "answer_correct": 0.0, "evidence_reward": 0.0, "telemetry": {"retries_used": 1, "loop_terminated": "accepted_preserved_initial"}, "trace": {"steps": steps}, "gold_pages": [1], "answer_type": "AnswerType.UNANSWERABLE"},
        {"example_id": "b", "answer_pred": "4", "answer_correct": 1.0, "evidence_reward": 0.5, "gold_pages": [], "answer_type": "numeric"},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    df = spark.read.schema(RECORD_SCHEMA + ", gold_pages array<int>, answer_type string").json(str(tmp_path / "r.json"))
    m = {r.example_id: r for r in stages.stage_metrics(df).collect()}
    a, b = m["a"], m["b"]
    assert tuple(a.routing) == (0.0, 1.0, 1.0, 1 / 3, 3)
    assert tuple(a.reasoning) == (True, True, True)
    assert tuple(a.loop) == (1, "no_loop", False)
    assert (a.tools.sequence, a.tools.useful, a.tools.irrelevant) == (["zoom", "tool_call"], 0, 2)
    assert tuple(b.routing) == (None, None, None, None, 0) and tuple(b.loop) == (0, "no_loop", None)
    e = {r.stage: (r.tokens, r.usd, r.latency_ms, r.tool_calls) for r in stages.efficiency(df).collect()}
    assert e == {"route_pages": (5, 0.0, 0, 0), "inspect": (0, 0.5, 15, 2), "verify": (0, 0.0, 0, 0)}
    g = stages.aggregate(stages.stage_metrics(df)).first()
    assert (g.n, g.hit_3, g.abstention_rate, g.ended_no_loop, g.retry_helped_rate) == (2, 1.0, 0.5, 1.0, 0.0)
