"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's rows as
Parquet to the shared folder and reads them again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm import decontaminate, near_dedup, packing, pii, toxicity
from evidora.llm.common import fresh, stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Labels are learned only where they may be.

    Null and empty texts score low and stay; repeated rows go or stay alike; without labels of both classes nothing can be told
    apart, and all documents stay. Columns, also one named score, are as they were.
    """
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    if model.constant is not None:
        return docs
    score = fresh(docs, "score")
    return toxicity.score_documents(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the least id, one row of it. Documents without a word (null and empty ones) all stay."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null and empty texts hold none and stay; repeated rows go or stay alike."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; n_chars follows the new text. Null texts stay null; repeated rows change alike."""
    out = pii.replace_pii(docs, pii.Surrogates(pii.session_key(spark)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 1024 tokens; null and empty texts are one end-of-text id."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, sketches and packing have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
