"""Whole evaluations as plans: score recorded answers, aggregate, compare with a pinned run, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import boxes as bx
from ..operators import aggregates, comparison, diagnosis


def score(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Records: predictions (example_id, answer_pred, citations, tool_calls, ...) joined with typed examples (id, answer, ...)."""
    gold = examples.select(F.col("id").alias("example_id"), "domain", "answer", "answer_type", "tolerance", "supporting_pages", "supporting_bboxes", "alternate_bboxes")
    j = predictions.drop("domain").join(gold, "example_id", "left")
    cited = F.filter(F.transform("citations", lambda c: F.struct(c["page"].alias("page"), bx.from_list(c["bbox"]).alias("b"))), lambda c: c["b"].isNotNull())
    golds = F.concat(F.coalesce("supporting_bboxes", F.array()), F.coalesce("alternate_bboxes", F.array()))
    j = j.withColumn("_cited", cited).withColumn("_gold", golds)
    one = lambda c, g: F.when(c["page"] == g["page"], bx.iou(bx.Box.item(c["b"]), bx.Box.item(g))).otherwise(0.0)
    best = F.coalesce(F.array_max(F.transform("_cited", lambda c: F.coalesce(F.array_max(F.transform("_gold", lambda g: one(c, g))), F.lit(0.0)))), F.lit(0.0))
    pages = F.transform("_cited", lambda c: c["page"])
    correct = an.score_answer(F.col("answer_pred"), F.col("answer"), F.col("answer_type"), F.col("tolerance"))
    recall = bx.page_recall(pages, F.coalesce("supporting_pages", F.array().cast("array<int>")))
    box_recall = bx.page_recall(pages, F.transform("supporting_bboxes", lambda b: b["page"]))
    reward = an.evidence_reward(correct, box_recall, best, F.coalesce("tool_calls", F.lit(0)), F.size("_cited"))
    lazy = ((F.coalesce("tool_calls", F.lit(0)) == 0) | (F.size("_cited") == 0)).cast("int")
    return j.withColumns({"answer_gold": F.col("answer"), "answer_correct": correct, "page_recall": recall, "bbox_iou": best, "evidence_reward": reward, "is_lazy": lazy}).drop("_cited", "_gold", "answer", "supporting_pages", "supporting_bboxes", "alternate_bboxes")


def evaluate(examples: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """records, by_domain and failures of a run, all lazy."""
    records = score(examples, predictions)
    return {"records": records, "by_domain": aggregates.aggregate_by_domain(records), "failures": records.where("answer_correct < 1")}


def compare_runs(baseline: DataFrame, treatment: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    pairs = comparison.paired(baseline, treatment, keys, keep=("domain",))
    return {"pairs": pairs, "summary": comparison.flip_summary(pairs), "only": comparison.only_counts(baseline, treatment, keys)}


def export_traces(records: DataFrame, path: str, **limits) -> None:
    """Traces that pass the filter, as JSON lines."""
    good = records.where(diagnosis.export_filter(F.col("answer_correct"), F.col("page_recall"), F.col("bbox_iou"), **limits))
    good.select(F.to_json(F.struct(*[c for c in good.columns])).alias("value")).write.mode("overwrite").text(path)
