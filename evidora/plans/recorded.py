"""Plans over recorded model outputs: parsed with fallbacks, prompts put together, and retries as a bounded loop over what is open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import structured as st


def parsed(requests: DataFrame, recorded: DataFrame, parse: Callable[[Column], Column], key: str = "key", text: str = "text", out: str = "parsed") -> DataFrame:
    """Requests with their recorded response parsed; a request without one gets what the parser makes of no text, and `recorded` false."""
    j = requests.join(recorded.select(key, F.col(text).alias("_text")), key, "left")
    return j.withColumns({out: parse(F.coalesce("_text", F.lit(""))), "recorded": F.col("_text").isNotNull()}).drop("_text")


def planned(requests: DataFrame, recorded: DataFrame, key: str = "key") -> DataFrame:
    """Question plans from recorded responses, with deterministic defaults for what is missing or invalid."""
    return parsed(requests, recorded, st.plan, key, out="plan")


def prompts(packets: DataFrame, by: list[str], order: str, text: str = "text", limit: int = 600) -> DataFrame:
    """by, n_packets, prompt: the numbered texts of each group's packets in order, each once and cut at the limit."""
    first = packets.where(F.coalesce(F.trim(text), F.lit("")) != "").groupBy(*by, F.substring(F.trim(text), 1, limit).alias("_t")).agg(F.min(order).alias("_o"))
    rows = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_p"))  # the packets of one question
    return rows.select(*by, F.size("_p").alias("n_packets"), F.array_join(F.transform("_p", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p["_t"])), "\n").alias("prompt"))


def resolve(open_: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], budget: int, key: str, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key, tries, status, and the columns of the last attempt, once all are accepted or the budget is used.

    attempt(open, n) gives key, supported and any columns for the n-th try (from 0) of all that are open; only what it does not support
    is tried again. The loop is over rounds, not rows. checkpoint: writes a round's result (a table in shared storage), so that later
    rounds do not repeat it.
    """
    keep = checkpoint or (lambda df: df)
    done: list[DataFrame] = []
    for n in range(budget):
        tried = keep(attempt(open_, n).withColumn("tries", F.lit(n + 1)))
        ok = F.coalesce(F.col("supported"), F.lit(False))
        last = n + 1 == budget
        status = F.when(ok, "accepted").otherwise("exhausted")
        done.append((tried if last else tried.where(ok)).withColumn("status", status))
        open_ = open_.join(tried.where(~ok).select(key), key, "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def deterministic_override(records: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Records (key, answer, supported) with a computed answer in place of an unsupported one, and whether it was."""
    j = records.join(computed.select(key, F.col("answer").alias("_answer")), key, "left")
    use = ~F.coalesce("supported", F.lit(False)) & F.col("_answer").isNotNull()
    return j.withColumns({"answer": F.when(use, F.col("_answer")).otherwise(F.col("answer")), "overridden": use}).drop("_answer")
