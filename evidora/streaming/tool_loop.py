"""Bounded tool loops over recorded turns: the same reading of a turn for a table and for a stream.

A loop's agent turns come one after the other. A turn calls a tool, or it is final: an object with `final_answer`, an object that is no
call, or plain text. A loop ends with its first final turn, or when `budget` turns are used; then, as for a loop that is still
open, its answer is the last turn's text, or 'Unanswerable' where there is none.

- `read_turns` reads turns one by one with column functions, in batch and stream alike.
- `loops` folds a table of turns: at most `budget` turns of a conversation are kept before they are brought together.
- `loop_updates` folds a stream: the state of a conversation is what its turns so far come to, never the turns themselves. Each
  micro-batch puts out the conversations that it changed; the last row of each is what `loops` gives for all turns. A conversation
  that waits for longer than `patience` ends as `timeout` and its state goes.

Defined results: null and empty texts are final turns with an empty answer; a turn number that was already counted is a repeat and
changes nothing; in a table repeated rows of a turn count once; turns of a stream come in order within a conversation; a name that is no
known tool is an error that uses a turn; conversations without an agent turn give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.structured import json_part

# Turns of a loop, and the answer of a loop that says nothing.
BUDGET, SILENT = 6, "Unanswerable"
FULL_PAGE = (0.0, 0.0, 1.0, 1.0)
CITATIONS = "array<struct<page:int,bbox:array<double>>>"
LOOP = "n_turns int, n_tool_calls int, n_errors int, tools string, ended string, answer string, n_citations int"


def citations(raw: Column) -> Column:
    """[{page, bbox}] of a JSON list: entries that are no objects go, pages are 0 and boxes the full page where they cannot be read."""
    objects = F.filter(F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{"))

    def one(x: Column) -> Column:
        numbers = F.transform(F.coalesce(F.from_json(F.get_json_object(x, "$.bbox"), "array<string>"), F.array().cast("array<string>")), lambda v: v.try_cast("double"))
        whole = (F.size(numbers) == 4) & F.forall(numbers, lambda v: v.isNotNull())
        box = F.when(F.coalesce(whole, F.lit(False)), numbers).otherwise(F.array(*[F.lit(v) for v in FULL_PAGE]))
        return F.struct(F.coalesce(F.get_json_object(x, "$.page").try_cast("int"), F.lit(0)).alias("page"), box.alias("bbox"))

    return F.transform(objects, one)


def turn(text: Column) -> Column:
    """{tool, input, answer, citations}: answer is null exactly for a tool call."""
    said = F.trim(F.coalesce(text, F.lit("")))
    obj = F.from_json(json_part(said), "map<string,string>")
    final = F.map_contains_key(obj, F.lit("final_answer"))
    call = F.coalesce(~final & obj["action"].isNotNull(), F.lit(False))
    answer = F.when(call, None).when(F.coalesce(final, F.lit(False)), F.coalesce(obj["final_answer"], F.lit(""))).otherwise(said)
    cited = F.when(F.coalesce(final, F.lit(False)), citations(obj["citations"]))
    return F.struct(F.when(call, obj["action"]).alias("tool"), F.when(call, obj["action_input"]).alias("input"), answer.alias("answer"), F.coalesce(cited, F.array().cast(CITATIONS)).alias("citations"))


def read_turns(turns: DataFrame, tools: list[str], conv: str = "conv_id", number: str = "turn", text: str = "text") -> DataFrame:
    """conv, number, said, tool, error, answer, n_citations: agent turns as a loop takes them."""
    t = turns.select(F.col(conv).alias("conv"), F.col(number).cast("long").alias("number"), F.trim(F.coalesce(text, F.lit(""))).alias("said"), turn(F.col(text)).alias("t"))
    known = F.coalesce(F.col("t.tool").isin(*tools), F.lit(False))
    return t.select("conv", "number", "said", "t.tool", (F.col("t.tool").isNotNull() & ~known).alias("error"), "t.answer", F.size("t.citations").alias("n_citations"))


def loops(turns: DataFrame, tools: list[str], budget: int = BUDGET, conv: str = "conv_id", number: str = "turn", text: str = "text") -> DataFrame:
    """conv, n_turns, n_tool_calls, n_errors, tools, ended (final, budget or open), answer, n_citations: one row a conversation."""
    rows = turns.select(conv, number, text).where(F.col(number).isNotNull()).groupBy(conv, number).agg(F.min(F.coalesce(text, F.lit(""))).alias(text))
    w = Window.partitionBy(conv).orderBy(number)
    head = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget).drop("_r")  # cut before anything is read
    read = read_turns(head, tools, conv, number, text)
    of = read.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("number", "said", "tool", "error", "answer", "n_citations"))).alias("a"))
    closing = F.array_position(F.transform("a", lambda x: x["answer"].isNotNull()), F.lit(True)).cast("int")
    of = of.withColumn("f", closing).withColumn("a", F.when(F.col("f") > 0, F.slice("a", 1, F.col("f"))).otherwise(F.col("a")))
    last, used = F.element_at("a", -1), F.size("a")
    called = F.filter("a", lambda x: x["tool"].isNotNull())
    text_left = F.when(last["said"] == "", SILENT).otherwise(last["said"])
    return of.select(
        F.col("conv").alias(conv), used.alias("n_turns"), F.size(F.filter(called, lambda x: ~x["error"])).alias("n_tool_calls"), F.size(F.filter(called, lambda x: x["error"])).alias("n_errors"),
        F.array_join(F.transform(called, lambda x: x["tool"]), ",").alias("tools"), F.when(F.col("f") > 0, "final").when(used >= budget, "budget").otherwise("open").alias("ended"),
        F.when(F.col("f") > 0, last["answer"]).otherwise(text_left).alias("answer"), F.when(F.col("f") > 0, last["n_citations"]).otherwise(0).alias("n_citations"),
    )


def loop_updates(turns: DataFrame, tools: list[str], budget: int = BUDGET, patience: str | None = None, conv: str = "conv_id", number: str = "turn", text: str = "text") -> DataFrame:
    """The columns of `loops` for a stream, in update mode: a row for each conversation that a micro-batch changes.

    patience: how long a conversation may wait for its next turn, in processing time. Such a query waits for what may time out, also
    where its trigger is availableNow, and is stopped by its caller.
    """
    wait = None if patience is None else int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, n, calls, errors, used, ended, answer, cited = state.get if state.exists else (-1, 0, 0, 0, "", "open", SILENT, 0)
        if state.hasTimedOut:
            state.remove()
            if ended == "open":
                yield pd.DataFrame([(key[0], n, calls, errors, used, "timeout", answer, 0)], columns=[conv, *names])
            return
        before = done
        rows = sorted(((r.number, r.said, r.tool, r.error, r.answer, r.n_citations) for b in batches for r in b.itertuples()), key=lambda r: (r[0], r[1]))
        for at, said, tool, error, final, found in rows:
            if at <= done or ended != "open":
                continue
            done, n = int(at), n + 1
            if final is not None:
                ended, answer, cited = "final", final, int(found)
                continue
            calls, errors, used = calls + (not error), errors + bool(error), f"{used},{tool}" if used else tool
            answer = said or SILENT
            if n >= budget:
                ended = "budget"
        state.update((done, n, calls, errors, used, ended, answer, cited))
        if wait is not None:
            state.setTimeoutDuration(wait)
        if done != before:
            yield pd.DataFrame([(key[0], n, calls, errors, used, ended, answer, cited)], columns=[conv, *names])

    names = [f.split()[0] for f in LOOP.split(", ")]
    read = read_turns(turns.where(F.col(number).isNotNull()), tools, conv, number, text)
    kind = dict(turns.dtypes)[conv]
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return read.groupBy("conv").applyInPandasWithState(step, f"{conv} {kind}, {LOOP}", f"done long, {LOOP}", "update", timeout)
