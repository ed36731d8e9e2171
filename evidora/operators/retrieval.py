"""Page routing by BM25: tokens -> postings -> ranked pages, padded to a fixed number."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.stemming import fold, stem

# BM25 constants and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1))


def query_terms(question: Column) -> Column:
    """Words with everything but letters and digits dropped inside them, once each."""
    words = F.transform(F.split(question, r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


@F.pandas_udf(ArrayType(StringType()))
def porter_terms(texts: pd.Series) -> pd.Series:
    """Terms as a full-text index has them: letters and digits, lower case, diacritics folded, Porter stems; null texts have none."""
    return texts.map(lambda t: [stem(w) for w in fold(t)] if t else [])


def statistics(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", analyse=tokens) -> DataFrame:
    """doc, page, dl: the number of terms of each page."""
    return pages.select(doc, page, F.size(analyse(F.col(text))).cast("long").alias("dl"))


def bm25(pages: DataFrame, questions: DataFrame, k: int = 5, doc: str = "doc", page: str = "page", text: str = "text", question_id: str = "question_id", question: str = "question", analyse=None) -> DataFrame:
    """question_id, doc, page, score, rank: the k best pages of each document for each question; pages without a term are left out.

    analyse: what makes terms of pages and questions (porter_terms); by default plain tokens. If questions has a column doc, each is
    asked of that document only. A page's terms are met with the distinct terms of all questions before anything is grouped, so only
    postings that a question needs are shuffled, and they carry their page's length; the totals of a document are a second pass that
    shuffles one row a task and document. Question terms come from a bounded set of questions; the join is by term.
    """
    terms_of, asked_terms = (tokens, query_terms) if analyse is None else (analyse, lambda c: F.array_distinct(analyse(c)))
    by_doc = [doc] if doc in questions.columns else []
    terms = questions.select(question_id, *by_doc, F.explode(asked_terms(F.col(question))).alias("term"))
    wanted = terms.select("term").distinct()
    totals = statistics(pages, doc, page, text, terms_of).groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), F.avg("dl").alias("avgdl"))
    found = pages.select(doc, page, terms_of(F.col(text)).alias("_t")).select(doc, page, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term")).join(wanted, "term", "left_semi")
    tf = found.groupBy(doc, page, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n_pages").cast("double")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weight = df.join(totals, doc).select(doc, "term", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    postings = tf.join(weight, [doc, "term"]).select(doc, page, "term", part.alias("part"))
    scored = postings.join(terms, [*by_doc, "term"]).groupBy(question_id, doc, page).agg(F.sum("part").alias("score"))
    w = Window.partitionBy(question_id, doc).orderBy(F.round("score", 9).desc(), page)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def route(pages: DataFrame, hits: DataFrame, questions: DataFrame, k: int = 5, doc: str = "doc", page: str = "page", question_id: str = "question_id") -> DataFrame:
    """Hits first, then pages in their order up to k, with a reason: hit or pad. hits: bm25 with at least k.

    questions: question_id and the document that each is asked of; pages and questions meet by document, never all with all. Only the
    first 2k pages of a document can be padding.
    """
    head = pages.select(doc, page).withColumn("_o", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("_o") <= 2 * k).drop("_o")
    asked = questions.select(question_id, doc).distinct()
    own = hits.select(question_id, doc, page, "score").join(asked, [question_id, doc], "left_semi")
    all_ = asked.join(head, doc).join(own, [question_id, doc, page], "full")
    w = Window.partitionBy(question_id, doc).orderBy(F.col("score").isNull(), F.round("score", 9).desc(), page)
    out = all_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(question_id, doc, page, F.coalesce("score", F.lit(0.0)).alias("score"), "rank", F.when(F.col("score").isNull(), "pad").otherwise("hit").alias("reason"))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k vectors nearest to one query by cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(embedding, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.select(key, F.try_divide(dot, norm(F.col(embedding)) * norm(q)).alias("score")).orderBy(F.desc("score"), key).limit(k)
