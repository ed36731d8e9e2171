"""Tool loops: the reading of a turn, the fold of a table, and the same result from a stream in any split into micro-batches."""

import json
import time

from pyspark.sql import functions as F

from evidora import tracebook as tb
from evidora.streaming import tool_loop as tl

SF = "/root/testdata/sf0.01"
TOOLS = ["zoom", "ocr"]


def test_reading_of_turns(spark):
    call = json.dumps({"action": "zoom", "action_input": {"page": 2}})
    final = json.dumps({"final_answer": "42", "citations": [{"page": 3, "bbox": [0, 0.5, "1", 1]}, {"page": "2", "bbox": [1, 2]}, 5, {"bbox": None}, {"page": 1, "bbox": [0, 0, 1, "x"]}]})
    texts = [call, f"I think.\n```json\n{call}\n```", final, f"so {final}", "plain words", None, "", '{"action": "zoom", "final_answer": "both"}', '{"note": 1}', '{"final_answer": null}', '{"final_answer": "a", "citations": "none"}', "[1, 2]", '{"action": "zoom"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tl.turn(F.col("text")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    assert [got[i].tool for i in range(len(texts))] == ["zoom", "zoom", *[None] * 11]
    assert json.loads(got[0].input) == {"page": 2}
    assert [got[i].answer for i in range(2, len(texts))] == ["42", "42", "plain words", "", "", "both", '{"note": 1}', "", "a", "[1, 2]", '{"action": "zoom"']
    full = list(tl.FULL_PAGE)
    assert [(c.page, c.bbox) for c in got[2].citations] == [(3, [0.0, 0.5, 1.0, 1.0]), (2, full), (0, full), (1, full)]
    assert got[0].citations == got[4].citations == got[10].citations == []


def turn(tool=None, answer=None):
    return json.dumps({"action": tool} if tool else {"final_answer": answer, "citations": [{"page": 1}]})


CONVERSATIONS = [
    (1, 0, turn("zoom")), (1, 2, turn("nosuch")), (1, 4, turn(answer="5 V")), (1, 6, turn("ocr")),  # what follows the final turn does not count
    (2, 1, turn("ocr")), (2, 1, turn("ocr")), (2, 3, turn("zoom")), (2, 5, turn("zoom")), (2, 7, turn(answer="too late")),  # the budget of three is used, a repeat is not
    (3, 0, turn("zoom")), (3, 1, None),
    (4, 0, turn("zoom")),
    (None, 3, turn("ocr")), (None, 4, "so be it"), (5, None, "lost"),
]
WANT = {
    (1, 3, 1, 1, "zoom,nosuch", "final", "5 V", 1), (2, 3, 3, 0, "ocr,zoom,zoom", "budget", turn("zoom"), 0), (3, 2, 1, 0, "zoom", "final", "", 0), (4, 1, 1, 0, "zoom", "open", turn("zoom"), 0), (None, 2, 1, 0, "ocr", "final", "so be it", 0),
}


def test_table(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, text string").withColumns({"said": F.lit(1), "answer": F.lit("x")})
    assert {tuple(r) for r in tl.loops(df, TOOLS, 3).collect()} == WANT
    assert tl.loops(df.where("false"), TOOLS).collect() == []


def streamed(spark, tmp_path, frames, tools, budget, until=None, **more):
    """The last row of each conversation after a stream over one file for each frame; until: stops a stream that would wait on."""
    source, schema = tmp_path / "in", frames[0].schema
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(source / f"b{i:02d}"))
        time.sleep(0.02)
    seen = []
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    query = tl.loop_updates(turns, tools, budget, **more).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda df, n: seen.extend((n, tuple(r)) for r in df.collect()))
    query = (query if until else query.trigger(availableNow=True)).start()
    try:
        if until:
            end = time.monotonic() + 60
            while not until(seen) and time.monotonic() < end:
                time.sleep(0.2)
        else:
            assert query.awaitTermination(120)
        assert query.exception() is None
    finally:
        query.stop()
    return {r[0]: r for _, r in seen}, seen


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    turns = tb.recorded_turns(spark, SF).orderBy("conv_id").cache()
    want = {r.conv_id: tuple(r) for r in tl.loops(turns, tb.LOOP_TOOLS).collect()}
    parts = [turns.where(f"turn >= {a} and turn < {b}") for a, b in ((0, 2), (2, 3), (3, 7), (7, 1000))]
    got, seen = streamed(spark, tmp_path, parts, tb.LOOP_TOOLS, tl.BUDGET)
    assert got == want and len(seen) > len(want)


def test_stream_of_awkward_turns(spark, tmp_path):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, text string")
    late = df.where("turn >= 3")
    got, _ = streamed(spark, tmp_path, [df.where("turn < 3"), late, late, df.where("turn is null")], TOOLS, 3)
    assert set(got.values()) == WANT


def test_a_silent_conversation_times_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, turn("zoom")), (2, 0, "done")], "conv_id long, turn long, text string")
    got, seen = streamed(spark, tmp_path, [df], TOOLS, 3, until=lambda seen: any(r[5] == "timeout" for _, r in seen), patience="1ms")
    assert got[1][5:7] == ("timeout", turn("zoom")) and got[2][5:7] == ("final", "done")
