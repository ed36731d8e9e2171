"""Incremental diagnosis of runs in flight (an extension): file streams of records and steps, windows and state with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_windows(steps: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and summed latency by stage in tumbling windows; the same expression serves a batch and a stream."""
    src = steps.withWatermark("ts", late) if steps.isStreaming else steps
    out = src.groupBy(F.window("ts", length), "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("latency").alias("latency"), F.count("tool").alias("tool_calls"))
    return out.select(F.col("window.start").alias("window_start"), "stage", "n", "latency", "tool_calls")


def sliding_windows(steps: DataFrame, length: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    src = steps.withWatermark("ts", late) if steps.isStreaming else steps
    out = src.groupBy(F.window("ts", length, slide), "stage").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "stage", "n")


def sessions(steps: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of one trace: steps less than gap apart."""
    src = steps.withWatermark("ts", late) if steps.isStreaming else steps
    out = src.groupBy(F.session_window("ts", gap), "trace").agg(F.count(F.lit(1)).alias("n"))
    return out.select("trace", F.col("session_window.start").alias("session_start"), "n")


def first_seen(steps: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; a stream drops repeats within the watermark only, so its state stays bounded."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if steps.isStreaming else steps.dropDuplicates(keys)


def record_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_totals(records: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the totals of each run at path; each batch replaces the table, so a repeated batch changes nothing."""
    totals = records.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("answer_correct").alias("correct"))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return totals.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
