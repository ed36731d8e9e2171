"""A stored page index: postings with their scores, block maxima for each term, and BM25 search that skips blocks.

Build (once for a corpus; texts are read and split once):

- `counts`: how often each page has each term, and each page's length, counted within each row and so without a shuffle. Stems are made
  of the distinct words only. It goes when the postings are written.
- `postings`: term, doc, block, page, part: the page's whole BM25 share for the term, laid out by document and term (one shuffle). A block holds some BLOCK pages
  of one document and of like length, so that a term's shares within it are alike.
- `blocks`: term, doc, block, top: the largest share of the term in the block.
- `manifest`: written last; names the tables of the first build that ended. A build that died leaves no manifest, and two builds at
  once do no harm.

Search: a block's bound for a question is the sum of its terms' tops. The two blocks of the highest bounds are scored first; the k-th
score there is a floor, and of the other blocks only those whose bound reaches it are read. So the result is that of scoring all.

Defined results: a document's pages have ids of their own; null and empty pages count as pages without terms; questions without terms find nothing; a page without any of a
question's terms is left out; equal scores (to nine places) go to the lesser page; repeated questions are one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shapes import bind
from ..sources.staging import files_key, stage, table_or_none
from . import retrieval as rt

#: Changes with the layout of the tables: an index of another version is not read.
VERSION = 2
BLOCK = 64
#: Classes of page length: four for each doubling.
PER_DOUBLING = 4
#: Rows of counted tables (documents, their classes of length) up to which they go to all tasks.
FEW = 1 << 16
#: Scores are compared to nine places.
SLACK = 1e-8


@dataclass(frozen=True)
class Analysis:
    """What makes terms: words of a page, the terms of each distinct word (None: the word itself), and the terms of a question."""

    name: str
    words: Callable[[Column], Column]
    terms: Callable[[DataFrame], DataFrame] | None
    asked: Callable[[Column], Column]


PLAIN = Analysis("plain", rt.tokens, None, rt.query_terms)
PORTER = Analysis(
    "porter",
    lambda text: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1)),
    lambda words: words.select("word", F.explode(rt.porter_terms("word")).alias("term")),
    lambda question: F.array_distinct(rt.porter_terms(question)),
)


def counted_words(words: Column) -> Column:
    """[{term, tf}] of a page's words, and one with a null term first: runs of the sorted words."""
    starts = lambda s: F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))).otherwise(F.array().cast("array<int>"))
    runs = lambda s, at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("long").alias("tf")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("tf")))
    return F.concat(own, bind(F.sort_array(words), lambda s: bind(starts(s), lambda at: runs(s, at))))


def counts(pages: DataFrame, analysis: Analysis = PLAIN, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """doc, page, dl, term, tf; each page has also one row with a null term, which counts it."""
    words = analysis.words(F.col(text))
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), words.alias("_w"))
    rows = rows.select("doc", "page", F.size("_w").cast("long").alias("dl"), F.explode(counted_words(F.col("_w"))).alias("_t")).select("doc", "page", "dl", "_t.term", "_t.tf")
    if analysis.terms is None:
        return rows
    raw = stage(rows.select("doc", "page", F.col("term").alias("word"), F.col("tf").alias("n")), "words")
    terms = stage(analysis.terms(raw.select("word").where("word is not null").distinct()), "terms")
    met = raw.join(_few(terms), "word", "left").where("term is not null or word is null")
    tf = met.repartition("doc", "page").groupBy("doc", "page", "term").agg(F.sum("n").alias("tf"))
    own = Window.partitionBy("doc", "page")  # the terms of one page
    return tf.withColumn("dl", F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("tf"))).over(own), F.lit(0))).select("doc", "page", "dl", "term", "tf")


def _few(table: DataFrame) -> DataFrame:
    """A written table, sent to all tasks where it is counted to be small."""
    return F.broadcast(table) if table.count() <= FEW else table


@dataclass(frozen=True)
class PageIndex:
    postings: DataFrame
    blocks: DataFrame
    totals: DataFrame
    analysis: Analysis

    def asked(self, questions: DataFrame, question_id: str = "question_id", question: str = "question") -> DataFrame:
        by_doc = ["doc"] if "doc" in questions.columns else []
        return questions.select(F.col(question_id).alias("question_id"), *by_doc, F.explode(self.analysis.asked(F.col(question))).alias("term")).distinct()

    def visits(self, questions: DataFrame, k: int = 5, question_id: str = "question_id", question: str = "question") -> tuple[DataFrame, DataFrame]:
        """((question_id, doc, page, score) of what was read, (question_id, doc, block, bound, step)). step: first, rest, or null for a skipped block."""
        terms = _few(stage(self.asked(questions, question_id, question), "asked"))
        keys = [c for c in ("doc", "term") if c in terms.columns]
        words = _few(stage(terms.select(keys).distinct(), "words"))
        # a block's rows come together before they meet the questions, so one row is shuffled however many questions ask for it
        own = self.blocks.join(words, keys, "left_semi").repartition("doc", "block")
        bounds = own.join(terms, keys).groupBy("question_id", "doc", "block").agg(F.sum("top").alias("bound"))
        order = Window.partitionBy("question_id", "doc").orderBy(F.desc("bound"), "block")
        bounds = stage(bounds, "bounds")
        first = stage(bounds.withColumn("_r", F.row_number().over(order)).where("_r <= 2").select("question_id", "doc", "block"), "first")

        def scored(blocks: DataFrame) -> DataFrame:
            wanted = _few(stage(blocks.groupBy("doc", "block").agg(F.collect_set("question_id").alias("_q")), "wanted"))
            own = self.postings.join(words, keys, "left_semi").join(wanted, ["doc", "block"])
            met = own.join(terms, keys).where(F.array_contains("_q", F.col("question_id")))
            return met.groupBy("question_id", "doc", "block", "page").agg(F.sum("part").alias("score")).drop("block")

        found = stage(scored(first), "found")
        best = Window.partitionBy("question_id", "doc").orderBy(F.desc("score"))
        top = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        floors = top.groupBy("question_id", "doc").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        steps = bounds.join(floors, ["question_id", "doc"], "left").join(first.withColumn("_f", F.lit(True)), ["question_id", "doc", "block"], "left")
        reach = F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)
        steps = stage(steps.select("question_id", "doc", "block", "bound", F.when(F.col("_f"), "first").when(reach, "rest").alias("step")), "steps")
        rest = scored(steps.where("step = 'rest'").select("question_id", "doc", "block"))
        return found.union(rest), steps

    def search(self, questions: DataFrame, k: int = 5, question_id: str = "question_id", question: str = "question") -> DataFrame:
        """question_id, doc, page, score, rank: the k best pages of each document for each question (of its document, if questions name one)."""
        scored, _ = self.visits(questions, k, question_id, question)
        w = Window.partitionBy("question_id", "doc").orderBy(F.round("score", 9).desc(), "page")
        out = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return out.select(F.col("question_id").alias(question_id), "doc", "page", "score", "rank")

    def report(self, questions: DataFrame, k: int = 5, question_id: str = "question_id", question: str = "question") -> DataFrame:
        """question_id, doc, blocks, read, skipped."""
        _, steps = self.visits(questions, k, question_id, question)
        return steps.groupBy("question_id", "doc").agg(F.count(F.lit(1)).alias("blocks"), F.count("step").alias("read"), F.count_if(F.col("step").isNull()).alias("skipped"))


def build(pages: DataFrame, path: str, analysis: Analysis = PLAIN, doc: str = "doc", page: str = "page", text: str = "text") -> None:
    """Write the index of pages at path; the manifest comes last."""
    spark = pages.sparkSession
    at = f"{path}/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    table = kept(counts(pages, analysis, doc, page, text), "counts")
    length = F.floor(F.log2(F.col("dl") + 1) * PER_DOUBLING).cast("int")
    per_page = table.where("term is null")
    totals = _few(kept(per_page.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("dl").alias("n_terms"), F.avg("dl").alias("avgdl")), "totals"))
    sizes = _few(kept(per_page.groupBy("doc", length.alias("cls")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n")), "sizes"))
    real = table.where("term is not null")
    n = F.col("n_pages").cast("double")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(rt.IDF_FLOOR))
    weight = real.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("df")).join(totals, "doc").select("doc", "term", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (rt.K1 + 1) / (F.col("tf") + rt.K1 * (1 - rt.B + rt.B * F.col("dl") / F.col("avgdl")))
    block = F.col("cls").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("page"), F.col("n"))
    rows = real.withColumn("cls", length).join(sizes, ["doc", "cls"]).select("term", "doc", block.alias("block"), "page", "tf", "dl")
    parts = rows.join(weight.hint("merge"), ["doc", "term"]).select("term", "doc", "block", "page", part.alias("part"))
    postings = kept(parts.sortWithinPartitions("term", "doc", "block", "page"), "postings")
    _deleted(spark, f"{at}/counts")
    kept(postings.groupBy("term", "doc", "block").agg(F.max("part").alias("top")).sortWithinPartitions("term", "doc", "block"), "blocks")
    spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def opened(spark: SparkSession, path: str, analysis: Analysis = PLAIN) -> PageIndex | None:
    """The index at path, or None where no build has ended."""
    manifest = table_or_none(spark, f"{path}/manifest", "at string")
    at = manifest.agg(F.min("at")).first()[0] if manifest else None
    return PageIndex(*[spark.read.parquet(f"{at}/{t}") for t in ("postings", "blocks", "totals")], analysis) if at else None


def stored(pages: DataFrame, folder: str, analysis: Analysis = PLAIN, key: str | None = None, doc: str = "doc", page: str = "page", text: str = "text") -> PageIndex:
    """The index of pages, built where there is none yet. key names the corpus; by default the files that pages read, so a second call reads no text."""
    path = f"{folder}/{key or files_key(pages, doc, page, text, str(pages.semanticHash()))}-{analysis.name}-{VERSION}"
    spark = pages.sparkSession
    if (index := opened(spark, path, analysis)) is None:
        build(pages, path, analysis, doc, page, text)
        index = opened(spark, path, analysis)
    return index
