"""The registered queries against SQL, and each pipeline stage against a plain version of it on its own input."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidora.llm import decontaminate, near_dedup, queries, toxicity
from evidora.llm.common import stage, table
from evidora.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    cur = con.execute(queries.SQL[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got == Counter(tuple(r[i] for i in at) for r in cur.fetchall())


FORMS = [r"[\w.+%-]+@(?:[\w-]+\.)+[A-Za-z]{2,}", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}", r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b", r"\b\d{13,19}\b"]


def personal(text):
    """What a reader would call personal data in the driver's documents, found without the operator."""
    from .test_operators import luhn

    found = [m for p in FORMS for m in re.findall(p, text or "")]
    return [m for m in found if not re.fullmatch(r"\d{13,19}", m) or luhn(m)]


def test_stages_and_run(spark):
    from tokenizers import Tokenizer

    from .test_operators import check_packing, distance

    spark.conf.set("spark.evidora.pii.key", "a test's key")
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    steps = dict(corpus_pipeline.STAGES)

    kept = stage(steps["toxicity"](spark, docs, SF), "t")
    assert kept.columns == columns
    model = toxicity.train(docs, toxicity.training_rows(table(spark, SF, "labels")))
    want = {i for i, s in zip(rows, toxicity.score_texts(model, list(rows.values()))) if s < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    rows = {i: rows[i] for i in want}

    near = stage(steps["near_duplicates"](spark, kept, SF), "n")
    assert near.columns == columns
    words = {i: near_dedup.words([t]).h.tolist() for i, t in rows.items()}
    gone = set(rows) - {r.doc_id for r in near.select("doc_id").collect()}
    left = {r.doc_id: r.text for r in near.collect()}
    for i in gone:  # whatever goes is like something of a smaller id, often through others
        assert words[i]
        assert any(distance(words[i], words[j]) <= 0.2 * max(len(words[i]), len(words[j])) for j in rows if j < i)
    hashes = {i: np.array(words[i], dtype=np.uint64) for i in left}
    for i in left:  # and no two that stay are alike, by edit similarity alone
        for j in left:
            if j < i and words[i] and words[j]:
                most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
                assert near_dedup.bag_distance(hashes[i], hashes[j]) > most or near_dedup.banded_distance(hashes[i], hashes[j], most) > most

    clean = stage(steps["decontamination"](spark, near, SF), "d")
    assert clean.columns == columns
    items = [decontaminate.normal_words(r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = {i for i, t in left.items() if any(decontaminate.myers(w, decontaminate.normal_words(t))[0] <= int(len(w) * 0.2 + 1e-9) for w in items)}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == set(left) - hit

    private = stage(steps["personal_data"](spark, clean, SF), "p")
    assert private.columns == columns
    out = {r.doc_id: r for r in private.collect()}
    assert set(out) == set(left) - hit
    known = {i: set(personal(left[i])) for i in out}
    gone_now = {e for es in known.values() for e in es}
    assert gone_now and all(e not in r.text for r in out.values() for e in gone_now)
    assert all(r.text == left[i] for i, r in out.items() if not known[i])

    t = Tokenizer.from_file(default_path())
    packed = steps["packing"](spark, private, SF).collect()
    check_packing(packed, {i: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for i, r in out.items()}, 1024)
    assert Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == Counter((r.doc_id, r.piece, r.length) for r in packed)


def test_the_driver_fits_nothing(spark, monkeypatch):
    """Texts and features stay with a task: the driver gets the same model from there, without its own fit."""
    docs, labels = table(spark, SF, "documents"), toxicity.training_rows(table(spark, SF, "labels"))
    rows = docs.join(labels, "doc_id").where("text is not null").select(F.xxhash64("doc_id").alias("o"), F.xxhash64("text").alias("h"), "text", "toxic").collect()
    rows = sorted({tuple(r) for r in rows}, key=lambda r: r[:2])
    share = labels.where("toxic = 1").count() / labels.where("toxic is not null").count()
    want = toxicity.fit([r[2] for r in rows], np.array([r[3] for r in rows]), share, toxicity.Sample().held_out_share)
    monkeypatch.setattr(toxicity, "fit", None)
    got = toxicity.train(docs, labels)
    assert np.array_equal(got.weights, want.weights) and (got.bias, got.scale, got.shift, got.constant) == (want.bias, want.scale, want.shift, None)
