"""Ranked search against a plain ranking, and the bounds of the tree."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from evidora.llm import lexical, queries
from evidora.llm.common import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=10):
    counted = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [lexical.Params(), lexical.Params(shard=37, leaf=2, fan=2), lexical.Params(k=3, shard=8, leaf=8, fan=3)])
def test_documents_and_benchmark(spark, sf_small, params):
    docs, items = table(spark, sf_small, "documents"), table(spark, sf_small, "benchmark")
    got = lexical.rank_documents(docs, items, params)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain_ranking([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], params.k)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_sql_agrees(spark, sf_small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    want = con.sql(queries.SQL["op12_ranked_search"]).fetchall()
    assert sorted(map(tuple, queries.op12_ranked_search(spark, sf_small).collect())) == sorted(want)


@pytest.mark.parametrize("bounds", [{}, {"vocabulary_bytes": 40, "query_terms": 3}])
def test_awkward_rows(spark, bounds):
    """Ties by id, repeated rows, nulls, very long texts, names that clash, and items in many blocks."""
    rng = random.Random(2)
    words = "alpha beta gamma delta Ωmega naïve x1 42".split()
    long = " ".join(rng.choice(words) for _ in range(250_000))
    docs = [(5, "alpha beta"), (3, "ALPHA, beta!"), (3, "alpha beta"), (None, "alpha beta"), (9, None), (10, ""), (11, "?!"), (12, long), (13, "Ωmega_naïve"), *[(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(60)]]
    items = [(1, "Alpha beta"), (1, "Alpha beta"), (2, "nothing here"), (3, None), (4, "!!"), (None, "gamma"), (6, "42 x1 x1 ωmega Ωmega"), (6, "delta")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, item int")
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, terms int")
    got = lexical.rank_documents(d, q, lexical.Params(shard=16, leaf=4, fan=2), **bounds)
    want = plain_ranking(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    same = [r.doc_id for r in got.where("item_id = 6").orderBy("rank").collect()]
    assert len(same) > 10 and None not in same[:1]
    tied = lexical.rank_documents(d.where("doc_id is null or doc_id < 12"), q).where("item_id = 1")
    assert [r.doc_id for r in tied.orderBy("rank").collect()] == [3, 3, 5, None]  # equal scores by id, null last
    assert lexical.rank_documents(d.where("false"), q).collect() == [] and lexical.rank_documents(d, q.where("false")).collect() == []


def test_equal_bounds_are_opened(spark):
    """Hundreds of documents tie; the lesser ids stand in ranges that sort last."""
    docs = spark.createDataFrame([(1000 - i, "same words here" if i % 2 else "filler text only") for i in range(800)], "doc_id long, text string")
    items = spark.createDataFrame([(0, "same words")], "item_id long, text string")
    got = lexical.rank_documents(docs, items, lexical.Params(shard=50, leaf=4, fan=2)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == sorted(1000 - i for i in range(800) if i % 2)[:10]
    assert len({r.score for r in got}) == 1


def test_bounds_hold_and_save_work(spark):
    """No posting is above its range's maximum, and a rare term leaves most ranges closed."""
    rng = np.random.default_rng(4)
    term, doc = rng.integers(0, 30, 4000), np.sort(rng.integers(0, 700, 4000))
    impact = rng.integers(1, 1000, 4000)
    p = lexical.Params(leaf=8, fan=4)
    levels = lexical.tree(term, doc, impact, 700, p)
    assert levels[-1].width == 1
    for at, level in enumerate(levels):
        place = doc // (p.leaf * p.fan**at)
        for t in range(30):
            bound = level.bounds(np.array([t]))
            for i in np.unique(place[term == t]):
                assert bound[i] == impact[(term == t) & (place == i)].max()
    docs = spark.createDataFrame([(i, "common words " * (1 + i % 7) + (f"rare rare{i}" if i % 97 == 0 else "")) for i in range(2000)], "doc_id long, text string")
    vocabulary = [b"common", b"rare", b"rare97"]
    shards = lexical.index(lexical.counted(docs, vocabulary), vocabulary, lexical.Params(shard=256, leaf=8, fan=4))
    ranked, work = lexical.search(shards, [np.array([1, 2])], 3, lexical.Params(shard=256, leaf=8, fan=4, k=3))
    assert ranked.orderBy("rank").first().id == 97
    assert work.first().opened < 2000 / 8 / 2
