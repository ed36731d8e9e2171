"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence s has the logistic score p(s) of its hashed features (words, word beginnings and
word pairs); a document is toxic with probability 1 - prod(1 - p(s)). Only documents are labelled: the gradient of the noisy-or
likelihood reaches every sentence in proportion to its share of the blame, so the same weights afterwards locate the offending
sentences. The classifier is fitted by one task on a bounded sample of labelled documents (Sample), in numpy, so neither texts nor
features reach the driver; scoring is one pass over the corpus without a shuffle. A part of the sample that the fit does not see sets the scale of the scores, weighted
to the class shares of all labels.

Defined results: null and empty texts have no sentences and score as low as the model can; a text of any length is scored whole;
without labels of both classes the score is the share of positive labels (0 without labels) and nothing can be told apart
(Model.constant is set); a document labelled twice counts as toxic if either label says so; labels without a document are ignored;
rows of one id and different texts are each scored, and each may be fitted on; equal rows are fitted on once; of equally toxic
sentences the first is told; an empty table gives no rows; a column that has an output's name is replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_text_batches
from .textvec import mix, words

#: Bytes of word beginnings that are features.
PREFIXES = (5, 7)
BITS = 20
THRESHOLD = 0.3


@dataclass(frozen=True)
class Sample:
    """At most so many labelled documents of each class, and characters of text, are fitted on."""

    positives: int = 3000
    negatives: int = 4000
    characters: int = 60_000_000
    held_out_share: float = 0.25


@dataclass
class Model:
    """weights over 2**BITS hashed features, the bias of a sentence, and the scale and shift of a document's log-odds."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def features(texts: list[str | None], spans: bool = False):
    """(feature numbers, sentence of each, text of each sentence); sentences without words do not occur.

    spans: also (first byte, byte after the last word) of each sentence.
    """
    w = words(texts, PREFIXES)
    if not len(w.h):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros((4, 0), dtype=np.int32), none, none, *([(none, none)] if spans else [])
    key = w.sentence
    start = np.concatenate([[True], (key[1:] != key[:-1]) | (w.doc[1:] != w.doc[:-1])])
    sentence = np.cumsum(start) - 1
    with np.errstate(over="ignore"):
        before = np.concatenate([[np.uint64(0)], w.h[:-1]])
        pair = mix(np.where(start, np.uint64(1), before) * np.uint64(0x9E3779B97F4A7C15) + w.h)
        kinds = [w.h, *[mix(p + np.uint64(k)) for k, p in zip(PREFIXES, w.prefixes)], pair]
    first = np.flatnonzero(start)
    where = [(w.spans[0][first], w.spans[1][np.concatenate([first[1:], [len(start)]]) - 1])] if spans else []
    return np.stack([(x >> np.uint64(64 - BITS)).astype(np.int32) for x in kinds]), sentence, w.doc[start], *where


def sentence_logits(model: Model, x: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    total = model.weights[x].sum(axis=0) if x.shape[1] else np.zeros(0)
    return np.bincount(sentence, weights=total, minlength=n) + model.bias


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def document_odds(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the noisy-or over each document's sentences; -30 without any."""
    s = np.bincount(doc, weights=softplus(z), minlength=n)  # -log of the chance that no sentence is toxic
    return np.clip(np.log(np.expm1(np.clip(s, 1e-13, 50))), -30, 50)


def fit(texts: list[str], labels: np.ndarray, share: float, held_out_share: float = 0.25, steps: int = 60, rate: float = 0.1, decay: float = 0.1, evidence: float = 20.0, seed: int = 7) -> Model:
    """Adam on the mean noisy-or loss. share: of positives among all labels, to which the scores are scaled.

    Texts are featurised a chunk at a time, and only telling features are kept, so that little is held besides the texts.
    """
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, dtype=np.float32), 0.0, constant=float(share))
    aside = np.random.default_rng(seed).random(len(texts)) < held_out_share
    if any(len(set(labels[m].tolist())) < 2 for m in (aside, ~aside)):
        aside[:] = False
    y = labels[~aside].astype(float)
    own = [t for t, m in zip(texts, aside) if not m]
    # only features whose documents differ between the classes beyond chance are weighted
    often = telling(own, y) >= evidence
    used, number = np.flatnonzero(often), np.cumsum(often).astype(np.int32) - 1
    xs, sentences, docs, n_sent, n_doc = [], [], [], 0, 0
    for part in chunks(own):
        x, sentence, doc = features(part)
        for kind in x:
            at = np.flatnonzero(often[kind])
            xs.append(number[kind[at]])
            sentences.append(sentence[at] + n_sent)
        docs.append(doc + n_doc)
        n_sent, n_doc = n_sent + len(doc), n_doc + len(part)
    x, sentence, doc = np.concatenate(xs), np.concatenate(sentences), np.concatenate(docs)
    w, m1, m2 = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    bias, b1, b2 = -5.0, 0.0, 0.0
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, steps + 1):
        z = np.bincount(sentence, weights=w[x], minlength=n_sent) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        s = np.clip(np.bincount(doc, weights=softplus(z), minlength=len(y)), 1e-9, 50)
        blame = np.where(y > 0, -1 / np.expm1(s), 1.0) * cost
        g_sentence = p * blame[doc]
        g = np.bincount(x, weights=g_sentence[sentence], minlength=len(used)) + decay * w / len(y)
        gb = g_sentence.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        step = rate / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
        w -= step * m1 / (np.sqrt(m2) + 1e-8)
        bias -= step * b1 / (np.sqrt(b2) + 1e-8)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[used] = w
    model = Model(weights, float(bias))
    rest = [t for t, m in zip(texts, aside) if m] if aside.any() else own
    odds = np.concatenate([text_odds(model, part) for part in chunks(rest)])
    model.scale, model.shift = scale_scores(odds, labels[aside].astype(float) if aside.any() else y, share)
    return model


def chunks(texts: list, size: int = 128):
    for i in range(0, len(texts), size):
        yield texts[i : i + size]


def telling(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Chi-square of each hashed feature's documents by class."""
    d = np.zeros((2, 1 << BITS))
    n_doc = 0
    for part in chunks(texts):
        x, sentence, doc = features(part)
        own = doc[sentence] if len(sentence) else sentence
        label = y[n_doc : n_doc + len(part)].astype(int)
        seen = np.unique(np.concatenate([kind.astype(np.int64) * len(part) + own for kind in x]))
        for c in (0, 1):
            d[c] += np.bincount(seen[label[seen % len(part)] == c] // len(part), minlength=1 << BITS)
        n_doc += len(part)
    n1, n0 = y.sum(), (1 - y).sum()
    n, both = n1 + n0, d[0] + d[1]
    return n * (d[1] * (n0 - d[0]) - d[0] * (n1 - d[1])) ** 2 / np.maximum(both * (n - both) * n1 * n0, 1e-9)


def scale_scores(odds: np.ndarray, y: np.ndarray, share: float, steps: int = 200) -> tuple[float, float]:
    """Logistic fit of labels on log-odds with classes weighted to share; Newton steps, lightly damped."""
    weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y == 0).sum()))
    x = np.stack([np.clip(odds, -20, 20), np.ones_like(odds)], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-4 * (beta - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.05)), float(beta[1])


def text_odds(model: Model, texts: list[str | None]) -> np.ndarray:
    x, sentence, doc = features(texts)
    return document_odds(sentence_logits(model, x, sentence, len(doc)), doc, len(texts))


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return probability(model, text_odds(model, texts))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def probability(model: Model, odds: np.ndarray) -> np.ndarray:
    """A document's score from its log-odds."""
    return sigmoid(np.clip(np.clip(odds, -20, 20) * model.scale + model.shift, -30, 30))


def training_rows(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2)


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample. labels must hold only rows that may be learned from.

    The sample's ids are the least hashes of each class; they are few by construction, so they are broadcast and no text is shuffled.
    """
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("_label"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    pick = lambda c, n: rows.where(F.col("_label") == c).orderBy(F.xxhash64(doc_id), doc_id).limit(n)
    chosen = pick(1, sample.positives).union(pick(0, sample.negatives))
    own = docs.select(F.col(doc_id), F.col(text).alias("_text")).join(F.broadcast(chosen), doc_id).where("_text is not null").withColumn("_h", F.xxhash64("_text"))
    # first lengths only, of distinct rows: what fits the bounds is known before any text moves
    light = own.groupBy(doc_id, "_h").agg(F.max(F.length("_text")).alias("_n")).orderBy(F.xxhash64(doc_id), doc_id, "_h").limit(sample.positives + sample.negatives).collect()
    size, fits = 0, []
    for r in light:  # a text that would pass the bound is left out
        if size + r["_n"] <= sample.characters:
            size += r["_n"]
            fits.append((r[doc_id], r["_h"]))
    if not fits:
        return fit([], np.zeros(0, dtype=int), share, sample.held_out_share)
    wanted = docs.sparkSession.createDataFrame(fits, f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, _h long")
    got = own.join(F.broadcast(wanted), [doc_id, "_h"]).dropDuplicates([doc_id, "_h"]).select(F.xxhash64(doc_id).alias("_o"), doc_id, "_h", "_text", "_label")
    small_text_batches(docs.sparkSession)
    fitted = got.select("_o", "_h", "_text", "_label").repartition(1).mapInArrow(lambda x: _fit_rows(x, share, sample.held_out_share), "weights binary, bias double, scale double, shift double, constant double")
    r = fitted.first()  # one row: the weights are 4 MB
    return Model(np.frombuffer(r["weights"], "<f4"), r["bias"], r["scale"], r["shift"], r["constant"])


def _fit_rows(batches: Iterator[pa.RecordBatch], share: float, held_out_share: float) -> Iterator[pa.RecordBatch]:
    """(order, hash, text, label) of at most a sample -> its model as one row."""
    rows = sorted((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])), key=lambda r: r[:2])
    m = fit([r[2] for r in rows], np.array([r[3] for r in rows], dtype=int), share, held_out_share)
    cols = [pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), *[pa.array([x], pa.float64()) for x in (m.bias, m.scale, m.shift, m.constant)]]
    yield pa.RecordBatch.from_arrays(cols, names=["weights", "bias", "scale", "shift", "constant"])


def worst_sentences(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of each text, first byte and byte after its most toxic sentence, that sentence's probability); -1, -1, 0 without sentences."""
    x, sentence, doc, spans = features(texts, spans=True)
    z = sentence_logits(model, x, sentence, len(doc))
    start, end, worst = np.full(len(texts), -1), np.full(len(texts), -1), np.zeros(len(texts))
    if len(doc):
        order = np.lexsort((-np.arange(len(z)), z, doc))
        last = order[np.concatenate([np.flatnonzero(np.diff(doc[order])), [len(doc) - 1]])]
        start[doc[last]], end[doc[last]], worst[doc[last]] = spans[0][last], spans[1][last], sigmoid(z[last])
    return document_odds(z, doc, len(texts)), start, end, worst


def score_documents(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", score: str = "score", locate: bool = False) -> DataFrame:
    """keep (default: all columns) plus score; columns of the new names are replaced.

    locate: also worst_start, worst_end (bytes of the UTF-8 text) and worst_probability of the most toxic sentence; nulls without sentences.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    new = [score, *(["worst_start", "worst_end", "worst_probability"] if locate else [])]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    src = docs.select(*keep, F.col(text).alias(fresh(docs, "text")))
    zero, none = F.lit(0.0), F.lit(None)
    shape = docs.select(*keep, zero.alias(score), *([none.cast("int").alias("worst_start"), none.cast("int").alias("worst_end"), none.cast("double").alias("worst_probability")] if locate else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            cols = []
            if locate:
                odds, start, end, worst = worst_sentences(m, texts)
                none = start < 0
                cols = [pa.array(start, pa.int32(), mask=none), pa.array(end, pa.int32(), mask=none), pa.array(worst, pa.float64(), mask=none)]
                s = np.full(len(texts), m.constant) if m.constant is not None else probability(m, odds)
            else:
                s = score_texts(m, texts)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(s, pa.float64()), *cols], names=[*keep, *new])

    return src.mapInArrow(run, shape)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (bytes of the UTF-8 text), probability: the sentences that score at least threshold."""
    spark = docs.sparkSession
    small_text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    shape = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, start int, end int, probability double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, sentence, doc, spans = features(b.column(1).to_pylist(), spans=True)
            p = sigmoid(sentence_logits(shared.value, x, sentence, len(doc)))
            hit = np.flatnonzero(p >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[hit])), pa.array(spans[0][hit], pa.int32()), pa.array(spans[1][hit], pa.int32()), pa.array(p[hit])], names=[doc_id, "start", "end", "probability"])

    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(run, shape)
