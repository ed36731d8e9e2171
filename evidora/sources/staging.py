"""Tables in the folder that all executors share: cut lineage, keep what later calls read again, and name files by what they hold."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. In plain local mode, as in tests, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evidora-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: a lost executor repeats nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at path, or None where there is none yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        df = reader.parquet(path)
        df.isEmpty()  # a given schema is not held against the path before a job runs
        return df
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def files_key(df: DataFrame, *more: str) -> str:
    """Names the files that df reads by path, length and time of change, without reading them, together with its columns and more."""
    files = sorted(df.inputFiles())
    if not files:
        raise ValueError("only tables that are read from files have a key of files")
    seen = df.sparkSession.read.format("binaryFile").load(files).select("path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    digest = seen.select(F.sha2(F.concat_ws("\x1f", *seen.columns), 256).alias("h")).agg(F.sort_array(F.collect_list("h")).alias("h")).first().h  # one row a file
    return hashlib.sha256("\x1f".join([*digest, *df.columns, *more]).encode()).hexdigest()[:32]
