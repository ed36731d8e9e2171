"""Token counts by an exact length histogram: documents by encoded length, and suffix sums over the histogram.

A document's length is its number of ids plus `added` (1 for an end-of-text id). Documents are counted by length on the
map side, so the shuffle carries at most one row for each task and length. All later work is on the histogram, whose rows
are bounded by the longest document, not by the number of documents: suffix sums in two levels (within blocks of lengths,
then over the few blocks) answer, for every context limit at once, how many documents are longer, how many tokens there
are, how many remain if each document is cut at the limit, and quantiles.

Defined results: null and empty texts have length `added`; a text of any length counts whole; repeated rows count each, and equal
lengths are one row; an empty table gives no rows; extra columns are ignored, whatever their names. The histogram is written once,
so the corpus is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_text_batches, stage
from .tokens import default_path, encoder

#: Lengths in one block of the two-level sums.
BLOCK = 4096


def token_lengths(docs: DataFrame, text: str = "text", tokenizer: str | None = None, added: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of keep and n_tokens, one row a document."""
    small_text_batches(docs.sparkSession)
    path = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [len(encode(t)) + added if t else added for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    shape = docs.select(*keep, F.lit(0).cast("long").alias("n_tokens")).schema
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(count, shape)


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The histogram with, for each length L as a limit: docs_longer (> L), tokens_total, tokens_within (documents of at
    most L, whole), tokens_truncated (all documents cut at L), docs_total and quantile (share of documents of at most L)."""
    h = stage(histogram, "lengths").withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = h.groupBy(*by, "_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_tokens").alias("_bt"))
    after = Window.partitionBy(*by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    blocks = blocks.select(
        *by, "_block",
        F.coalesce(F.sum("_bd").over(after), F.lit(0)).alias("_da"), F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_ta"),
        F.sum("_bd").over(all_).alias("docs_total"), F.sum("_bt").over(all_).alias("tokens_total"),
    )
    longer = Window.partitionBy(*by, "_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, [*by, "_block"])
    docs_longer = F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("_da")
    tokens_longer = F.coalesce(F.sum("_tokens").over(longer), F.lit(0)) + F.col("_ta")
    out = out.select(*by, "n_tokens", "n_docs", docs_longer.alias("docs_longer"), tokens_longer.alias("_longer"), "docs_total", "tokens_total")
    return out.select(
        *by, "n_tokens", "n_docs", "docs_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("_longer")).alias("tokens_within"),
        (F.col("tokens_total") - F.col("_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_truncated"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def truncated_totals(sums: DataFrame, limits: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Answers for any limits, also between lengths: by, limit, docs_longer, tokens_truncated."""
    parts = []
    for limit in limits:
        cut = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
        parts.append(sums.groupBy(*by).agg(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias("docs_longer"), F.sum(cut).alias("tokens_truncated")).withColumn("limit", F.lit(limit)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantile(sums: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The smallest length that at least a share q of the documents does not exceed."""
    return sums.where(F.col("quantile") >= q).groupBy(*by).agg(F.min("n_tokens").alias("n_tokens"))
