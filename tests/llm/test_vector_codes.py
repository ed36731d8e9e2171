"""Vector codes against plain assignment to every entry, the SQL, and on awkward vectors."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from evidora.llm import queries
from evidora.llm import vector_codes as vc
from evidora.llm.common import table


def plain(rows, parts=16, entries=64, rounds=2):
    """[(id, code, error, label_error, sha)] of rows (id, vector, label) in Python integers."""
    kept = [(i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return []
    w = len(kept[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(best(c[p], books[p])[1], []).append(c[p])
            for e, xs in of.items():
                books[p][e] = [sum(x) // len(xs) for x in zip(*xs)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    got = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in g) for g in got]
    label = {}
    for r, e in zip(kept, error):
        label[r[1]] = label.get(r[1], 0) + e
    return [(r[0], "".join(f"{i:02x}" for _, i in g), e, label[r[1]], sha) for r, g, e in zip(kept, got, error)]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_embeddings(spark, sf_small):
    v = table(spark, sf_small, "embeddings")
    same(queries.op13_vector_codes(spark, sf_small).collect(), plain([(r.vec_id, r.embedding, r.label) for r in v.collect()]))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_small}/embeddings.parquet'")
    same(queries.op13_vector_codes(spark, sf_small).collect(), con.sql(queries.SQL["op13_vector_codes"]).fetchall())


def test_awkward_vectors(spark):
    """Nulls, no components, other lengths, ties, repeated rows and ids, null labels, unused entries, few vectors, names that clash."""
    rng = random.Random(1)
    grid = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.001, 0.5]) for _ in range(32)]  # noqa: E731  many equal distances
    rows = [(i, grid(), rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(7, rows[7][1], 1), (7, grid(), None), (None, grid(), 2), (200, None, 1), (201, [], 1), (202, [None] * 32, 1), (203, [float("nan")] * 32, 1), (204, [float("-inf")] * 32, 1), (205, [0.5] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<float>, label int, x int, code string")
    same(vc.code_table(df).collect(), plain(rows))
    few = rows[:5]
    same(vc.code_table(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")).collect(), plain(few))
    p = vc.Params(parts=4, entries=9, rounds=3)
    same(vc.code_table(df, p).collect(), plain(rows, 4, 9, 3))
    assert vc.code_table(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        vc.code_table(df.where("vec_id = 205"), vc.Params(parts=3))
    huge = spark.createDataFrame([(1, [1e30] * 32, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(PySparkException):
        vc.code_table(huge)


def test_search_scans_a_part_and_misses_nothing():
    rng = np.random.default_rng(2)
    entries = rng.integers(-90, 90, (64, 4))
    entries[10] = entries[3]  # a tie by index
    book = vc.Codebook.of(entries)
    x = rng.integers(-90, 90, (5000, 4))
    x[:64] = entries
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    far, near = rng.integers(0, 64, 5000), d.argmin(1)
    for start in (far, near, np.zeros(5000, np.int64), np.where(rng.random(5000) < 0.5, 10, 3)):
        code, best, _ = book.nearest(x, start)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    _, _, done = book.nearest(x, near)
    assert done < 0.6 * d.size


def test_decode(spark, sf_small):
    """What the codes stand for is as far from the vectors as their errors say."""
    codes, books = vc.compress(table(spark, sf_small, "embeddings"))
    for r in vc.decode(codes, books).limit(50).collect():
        assert sum((a - b) ** 2 for a, b in zip(r.x, r.y)) == r.error
