"""Calls to a caller's function as a stage: each distinct request once, retried with growing waits, failures kept as rows, resumed from a log.

The log is a table of the requests that were answered: key, status ('ok' or 'dead'), response, error, attempts. A run asks
only for requests that it does not hold, in waves; each wave is written to the log before the next begins, and results are read from
the log alone. A run that is stopped goes on where the log ends. A task that is lost repeats its own requests of one wave, at most
`chunk` of them.

Defined results: equal keys are one request (the least body of them is sent); null keys are answered by nothing and stay without a status;
permanent failures are `dead` at once, others after `attempts` tries; dead requests are asked again only by `again`; an empty table
calls nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .staging import stage, table_or_none

LOG = "key string, status string, response string, error string, attempts int"
# What marks an error that may pass, and one that waiting does not mend.
PASSING = ("429", "rate limit", "resource_exhausted", "timeout", "timed out", "temporarily", "unavailable", "connection", "500", "502", "503", "504")
LASTING = ("quota exceeded", "current quota", "free_tier", "requests per day")


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    first_wait: float = 1.0
    longest_wait: float = 60.0
    #: Seconds between the starts of two calls of one task.
    interval: float = 0.0

    def passes(self, error: str) -> bool:
        """Whether a later try may succeed."""
        low = error.lower()
        return any(m in low for m in PASSING) and not any(m in low for m in LASTING)


def _spelled(x):
    if isinstance(x, dict):
        return {k: _spelled(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_spelled(v) for v in x]
    return round(x, 4) + 0.0 if isinstance(x, float) else x


@F.pandas_udf(StringType())
def canonical_json_text(texts: pd.Series) -> pd.Series:
    """JSON of any depth with sorted keys, no blanks and numbers with a point at four places; null where it cannot be read."""

    def one(t):
        try:
            return None if t is None else json.dumps(_spelled(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def request_key(body: Column) -> Column:
    """The content key of a JSON request: one for all spellings of it."""
    return F.sha2(canonical_json_text(body), 256)


def _called(frames: Iterator[pd.DataFrame], call: Callable[[str], str], retry: Retry, sleep: Callable[[float], None]) -> Iterator[pd.DataFrame]:
    started = 0.0
    for f in frames:
        out = []
        for key, body in zip(f["key"], f["body"]):
            wait = retry.first_wait
            for attempt in range(1, retry.attempts + 1):
                if (pause := started + retry.interval - time.monotonic()) > 0 and started:
                    sleep(pause)
                started = time.monotonic()
                try:
                    out.append((key, "ok", call(body), None, attempt))
                    break
                except Exception as e:  # a caller's function may raise anything; it becomes a row
                    said = f"{type(e).__name__}: {e}"
                    if attempt == retry.attempts or not retry.passes(said):
                        out.append((key, "dead", None, said, attempt))
                        break
                    sleep(min(wait, retry.longest_wait))
                    wait *= 2
        yield pd.DataFrame(out, columns=["key", "status", "response", "error", "attempts"])


def logged(spark, path: str) -> DataFrame:
    """One row a key of the log: an answer before a failure, then the least."""
    log = table_or_none(spark, path, LOG)
    if log is None:
        return spark.createDataFrame([], LOG)
    best = log.groupBy("key").agg(F.min(F.struct((F.col("status") != "ok").alias("o"), "status", "response", "error", "attempts")).alias("b"))
    return best.select("key", "b.status", "b.response", "b.error", "b.attempts")


def answered(requests: DataFrame, call: Callable[[str], str], log: str, retry: Retry = Retry(), key: str = "key", body: str = "body", chunk: int = 64, tasks: int = 32, again: bool = False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests with status, response, error and attempts; what the log at `log` does not hold is asked first.

    A wave is tasks * chunk requests. tasks bounds how many calls run at once.
    """
    spark = requests.sparkSession
    held = logged(spark, log)
    known = held.where("status = 'ok'") if again else held
    wanted = requests.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(body).alias("body"))
    open_ = stage(wanted.join(known.select("key"), "key", "left_anti"), "requests")
    waves = -(-open_.count() // (tasks * chunk))
    dealt = stage(open_.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(max(1, waves)))), "waves")
    for wave in range(waves):
        mine = dealt.where(F.col("wave") == wave).select("key", "body").repartition(tasks, "key")
        mine.mapInPandas(lambda f: _called(f, call, retry, sleep), LOG).write.mode("append").parquet(log)
    out = logged(spark, log).withColumnRenamed("key", "_key")
    return requests.join(out, requests[key] == out["_key"], "left").drop("_key")


# ---- records of a run


def append_missing(records: DataFrame, path: str, key: str = "example_id") -> int:
    """Append the records whose key the run at path does not hold yet, each key once; how many there were. A second call writes nothing."""
    spark = records.sparkSession
    part = f"{path}/predictions"
    once = records.groupBy(key).agg(F.min_by(F.struct(*records.columns), F.to_json(F.struct(*records.columns))).alias("r")).select("r.*")
    held = table_or_none(spark, part)
    new = stage(once if held is None else once.join(held.select(key), key, "left_anti"), "records")
    if n := new.count():
        new.write.mode("append").parquet(part)
    return n


def consolidate(spark, path: str) -> None:
    """Write the records of a run as its one table of examples."""
    spark.read.parquet(f"{path}/predictions").write.mode("overwrite").parquet(f"{path}/per_example")


def run_records(spark, path: str) -> DataFrame:
    """The run's table of examples, or where there is none its records so far."""
    whole = table_or_none(spark, f"{path}/per_example")
    return spark.read.parquet(f"{path}/predictions") if whole is None else whole
