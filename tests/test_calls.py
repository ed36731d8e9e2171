"""Calls with retries and a log, run records, and paged reading, with functions that fail on purpose and count themselves in files."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from evidora.sources import calls, paged


def mark(folder, what):
    open(os.path.join(folder, f"{what}~{uuid.uuid4().hex}"), "w").close()


def marks(folder):
    out = {}
    for f in os.listdir(folder):
        what = f.split("~")[0]
        out[what] = out.get(what, 0) + 1
    return out


def test_canonical_json(spark):
    same = ['{"b": [1, {"y": 1.00004, "x": null}], "a": {"d": true, "c": "é \\n"}}', ' {"a":{"c":"é \\n","d":true},"b":[1,{"x":null,"y":1.0}]}']
    other = ['{"b": [{"y": 1.0, "x": null}, 1], "a": {}}', '{"a": "1"}', '{"a": 1}', '{"a": 1.0001}', '{"a": 1.0}', '{"a": -0.00001}', "[]", "broken", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(same + other)], "i int, t string").select("i", calls.canonical_json_text("t").alias("c"), calls.request_key(F.col("t")).alias("k"))
    got = {r.i: (r.c, r.k) for r in rows.collect()}
    assert got[0] == got[1] and got[0][0] == '{"a":{"c":"é \\n","d":true},"b":[1,{"x":null,"y":1.0}]}'
    assert len({k for _, k in got.values()}) == 9 and got[9] == got[10] == (None, None) and got[7][0] == '{"a":0.0}'


def test_calls_are_retried_logged_and_resumed(spark, tmp_path):
    seen, log = str(tmp_path / "seen"), str(tmp_path / "log")
    os.mkdir(seen)

    def call(body):
        n = json.loads(body)["n"]
        mark(seen, n)
        tries = marks(seen)[str(n)]
        if n == 1 and tries < 3:
            raise RuntimeError("503 unavailable")
        if n == 2:
            raise ValueError("no such page")
        if n == 3:
            raise RuntimeError("429 current quota used")
        if n == 4:
            raise TimeoutError("timed out")
        return f"r{n}"

    rows = [(f"k{n % 6}", json.dumps({"n": n % 6}), i) for i, n in enumerate([0, 1, 2, 3, 4, 5, 0, 1, 0])] + [(None, "{}", 99)]
    req = spark.createDataFrame(rows, "key string, body string, error_of int")
    retry = calls.Retry(attempts=3, first_wait=0.0)
    got = {r.key: (r.status, r.response, r.attempts) for r in calls.answered(req, call, log, retry, chunk=1, tasks=2).collect()}
    assert got == {"k0": ("ok", "r0", 1), "k1": ("ok", "r1", 3), "k2": ("dead", None, 1), "k3": ("dead", None, 1), "k4": ("dead", None, 3), "k5": ("ok", "r5", 1), None: (None, None, None)}
    assert marks(seen) == {"0": 1, "1": 3, "2": 1, "3": 1, "4": 3, "5": 1}
    more = req.union(spark.createDataFrame([("k7", '{"n": 7}', 1)], req.schema))
    out = calls.answered(more, call, log, retry, tasks=2)
    assert out.count() == 11 and {r.response for r in out.where("key = 'k7'").collect()} == {"r7"}
    assert marks(seen) == {"0": 1, "1": 3, "2": 1, "3": 1, "4": 3, "5": 1, "7": 1}  # nothing was asked twice
    calls.answered(req, lambda b: mark(seen, "again") or "late", log, retry, tasks=2, again=True)
    assert marks(seen)["again"] == 3 and calls.logged(spark, log).where("status = 'dead'").count() == 0
    assert calls.answered(req.where("false"), call, str(tmp_path / "none"), retry).count() == 0


def test_waits_double_and_calls_keep_their_distance():
    import pandas as pd

    slept = []

    def call(_):
        raise RuntimeError("timeout")

    list(calls._called(iter([pd.DataFrame({"key": ["a"], "body": ["x"]})]), call, calls.Retry(attempts=5, first_wait=1, longest_wait=3), slept.append))
    assert slept == [1, 2, 3, 3]
    slept.clear()
    list(calls._called(iter([pd.DataFrame({"key": ["a", "b"], "body": ["x", "y"]})]), str, calls.Retry(interval=10), slept.append))
    assert len(slept) == 1 and 9 < slept[0] <= 10


def test_records_are_written_once(spark, tmp_path):
    path = str(tmp_path / "run")
    df = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 1.0)], "example_id string, answer_correct double")
    assert calls.append_missing(df.where("example_id < 'c'"), path) == 2
    assert calls.append_missing(df, path) == 1 and calls.append_missing(df, path) == 0
    assert sorted(r.example_id for r in calls.run_records(spark, path).collect()) == ["a", "b", "c"]
    calls.consolidate(spark, path)
    calls.append_missing(df.withColumn("example_id", F.lit("z")), path)
    assert calls.run_records(spark, path).count() == 3  # the consolidated table is preferred


class FilePager:
    """Pages of a table as it lies in a folder; pages can be made to fail."""

    schema = "id long, name string"

    def __init__(self, folder, rows, fails=None, answers=None):
        self.folder, self.rows, self.fails, self.answers = folder, rows, fails or {}, answers

    def size(self, revision):
        return self.rows

    def page(self, revision, first, n):
        mark(self.folder, first // 10)
        if marks(self.folder)[str(first // 10)] <= self.fails.get(first // 10, 0):
            raise OSError("503")
        return self.answers or revision, [(i, f"{revision}-{i}") for i in range(first, first + n)]


def test_pages_are_retried_and_only_missing_ones_read_again(spark, tmp_path):
    seen, log = str(tmp_path / "seen"), str(tmp_path / "pages")
    os.mkdir(seen)
    read = lambda pager, revision="r1": paged.read_pages(spark, pager, revision, log, 10, wave=2, tries=2, first_wait=0.0, name=f"paged{uuid.uuid4().hex[:6]}")
    with pytest.raises(Exception, match="503"):
        read(FilePager(seen, 57, {1: 1, 5: 99}))
    assert marks(seen)["1"] == 2  # tried again within the run
    before = marks(seen)
    out = read(FilePager(seen, 57))
    assert sorted(map(tuple, out.collect())) == [(i, f"r1-{i}") for i in range(57)]
    after = marks(seen)
    assert {k: after[k] - before.get(k, 0) for k in after if after[k] != before.get(k, 0)}.keys() <= {"4", "5"}
    assert read(FilePager(seen, 57)).count() == 57 and marks(seen) == after
    assert read(FilePager(seen, 12), "r2").count() == 12
    with pytest.raises(Exception, match="RevisionChanged"):
        read(FilePager(seen, 12, answers="r9"), "r3")
    assert read(FilePager(seen, 0), "r4").collect() == []
