"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch for whole-text operators: 128 texts of 120 KB are 15 MB.
TEXT_BATCH_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder. In local mode, as in tests, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evidora-"))
    return sc.getCheckpointDir()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it again.

    The table survives lost executors and is read column by column; it is compressed, unlike an RDD checkpoint.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._evidora_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_evidora_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small_text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound what one Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> Iterator[None]:
    """The same bound for the jobs that run inside the block only: the caller's setting is put back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def row_key(*cols: str):
    """A 128-bit content key as two longs; equal keys are taken as equal content."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))
