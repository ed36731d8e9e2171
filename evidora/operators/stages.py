"""Stage metrics of one record's nested trace, as expressions over its steps (an array of structs with args as JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import ABSTAIN_STAGE, enum_stem, mentions_any

# How a retry loop may end; anything else counts as no loop.
LOOP_ENDS = ("no_loop", "accepted", "abstained", "exhausted")


def of_stage(steps: Column, stage: str) -> Column:
    return F.filter(F.coalesce(steps, F.array()), lambda s: s["stage"] == stage)


def routed_pages(steps: Column) -> Column:
    """Pages of the first routing step, in order."""
    args = F.get(of_stage(steps, "route_pages"), 0)["args"]
    return F.coalesce(F.from_json(F.get_json_object(args, "$.candidates"), "array<int>"), F.array().cast("array<int>"))


def routing(steps: Column, gold_pages: Column) -> Column:
    """{hit_1, hit_3, hit_5, precision_5, pages}: whether a gold page is among the first k; nulls without gold, zeros without routing."""
    pages, gold = routed_pages(steps), F.array_distinct(F.coalesce(gold_pages, F.array().cast("array<int>")))
    known = F.size(gold) > 0
    hit = lambda k: F.when(known, F.arrays_overlap(F.slice(pages, 1, k), gold).cast("double"))
    five = F.slice(pages, 1, 5)
    precision = F.when(known, F.coalesce(F.try_divide(F.size(F.filter(five, lambda p: F.array_contains(gold, p))), F.size(five)), F.lit(0.0)))
    return F.struct(hit(1).alias("hit_1"), hit(3).alias("hit_3"), hit(5).alias("hit_5"), precision.alias("precision_5"), F.when(known, F.size(pages)).otherwise(0).alias("pages"))


def verdicts(steps: Column) -> Column:
    """The 'supported' values of verify steps that have one, in order. Stage metrics read the first, diagnoses the last."""
    return F.filter(F.transform(of_stage(steps, "verify"), lambda s: F.get_json_object(s["args"], "$.supported").try_cast("boolean")), lambda v: v.isNotNull())


def reasoning(answer: Column, answer_type: Column, correct: Column, steps: Column) -> Column:
    """{abstained, rightly, caught}: caught if a wrong answer was marked unsupported."""
    gone = (F.trim(F.coalesce(answer, F.lit(""))) != "") & mentions_any(answer, ABSTAIN_STAGE)
    wrong = F.coalesce(correct, F.lit(0.0)) < 1
    return F.struct(gone.alias("abstained"), (gone & (F.coalesce(enum_stem(answer_type), F.lit("")) == "unanswerable")).alias("rightly"), (wrong & (F.coalesce(F.get(verdicts(steps), 0), F.lit(True)) == F.lit(False))).alias("caught"))


def loop(telemetry: Column) -> Column:
    """{retries, ended, helped}: helped is null without a retry."""
    retries = F.coalesce(telemetry["retries_used"], F.lit(0))
    ended = F.when(telemetry["loop_terminated"].isin(*LOOP_ENDS), telemetry["loop_terminated"]).otherwise("no_loop")
    return F.struct(retries.alias("retries"), ended.alias("ended"), F.when(retries > 0, F.coalesce(telemetry["loop_retry_helped"], F.lit(False))).alias("helped"))


def is_tool(s: Column) -> Column:
    return s["tool"].isNotNull() | F.coalesce(s["action"] == "tool_call", F.lit(False))


def tools(steps: Column, reward: Column) -> Column:
    """{sequence, distinct, useful, irrelevant}: tools in order of use, and their number counted as useful if the answer earned a reward."""
    used = F.transform(F.filter(F.coalesce(steps, F.array()), is_tool), lambda s: F.coalesce(s["tool"], s["action"]))
    earned = F.coalesce(reward, F.lit(0.0)) > 0
    return F.struct(used.alias("sequence"), F.array_distinct(used).alias("distinct"), F.when(earned, F.size(used)).otherwise(0).alias("useful"), F.when(earned, 0).otherwise(F.size(used)).alias("irrelevant"))


def efficiency(records: DataFrame, key: str = "example_id") -> DataFrame:
    """key, stage, tokens, usd, latency_ms, tool_calls: sums over all steps of a stage, repeats in a retry loop included.

    Money is summed as decimals of twelve places, so a sum does not depend on the order of its steps.
    """
    s = records.select(key, F.explode("trace.steps").alias("s")).where(F.coalesce("s.stage", F.lit("")) != "")
    zero = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0))
    return s.groupBy(key, F.col("s.stage").alias("stage")).agg(F.sum(zero("tokens_in") + zero("tokens_out")).alias("tokens"), F.sum(zero("usd").cast("decimal(24,12)")).cast("double").alias("usd"), F.sum(zero("latency_ms")).alias("latency_ms"), F.count_if(is_tool(F.col("s"))).alias("tool_calls"))


def stage_metrics(records: DataFrame) -> DataFrame:
    """records (RECORD_SCHEMA with gold_pages and answer_type) with routing, reasoning, loop and tools."""
    steps = F.col("trace.steps")
    return records.withColumns({
        "routing": routing(steps, F.col("gold_pages")), "reasoning": reasoning(F.col("answer_pred"), F.col("answer_type"), F.col("answer_correct"), steps),
        "loop": loop(F.col("telemetry")), "tools": tools(steps, F.col("evidence_reward")),
    })


def aggregate(metrics: DataFrame, *by: str) -> DataFrame:
    """Means that skip nulls for routing, rates for the rest, by any keys."""
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"routing.{c}").alias(c) for c in ("hit_1", "hit_3", "hit_5", "precision_5")], F.avg("routing.pages").alias("pages_mean"),
        rate("reasoning.abstained").alias("abstention_rate"), rate("reasoning.rightly").alias("correct_abstention_rate"), rate("reasoning.caught").alias("caught_rate"),
        F.avg("loop.retries").alias("retries_mean"), F.avg(F.col("loop.helped").cast("int")).alias("retry_helped_rate"),
        *[F.avg((F.col("loop.ended") == e).cast("int")).alias(f"ended_{e}") for e in LOOP_ENDS],
    )
