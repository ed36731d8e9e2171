"""SimHash components against all pairs, on real and awkward texts and for every division of the bits."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidora.llm import simhash
from evidora.llm.common import table


def plain_fingerprint(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64(x, seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """id -> least id reachable, from (id, fingerprint) rows."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        least[find(i)] = min([x for x in (least.get(find(i)), k) if x is not None], default=None)
    return [(k, f"{fp:016x}", least[find(i)]) for i, (k, fp) in enumerate(prints)]


def key(r):
    return tuple((x is None, x) for x in r)


def test_documents(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == sorted(plain_components(rows))


def test_awkward_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(300_000))  # over one MiB
    base = rng.choices(words, k=400)
    near = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(0, 60, 3)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "ONE", "one  two", "one\ttwo", "É è", "é è", "one two three", " a b", long, long + " end", *near, near[0]]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)] + [(4, "ONE", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key)
    assert got == sorted(want, key=key)
    by = dict((k, c) for k, _, c in got)
    assert by[0] == by[1] == by[2] == 0 and by[11] == by[12] and by[13] == by[len(texts) - 1]
    assert simhash.near_duplicates(docs.where("false")).collect() == []


@pytest.mark.parametrize("parts", [1, 2, 4, 8, None])
def test_every_division_finds_all_links(spark, parts):
    """Random fingerprints with neighbours of 0 to 5 differing bits, a group of thousands of links, and the ends 0 and all ones."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 7, 15, (1 << 64) - 1 - 7, 1 << 63}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
    hub = rng.getrandbits(64)
    fps |= {hub ^ 1 << i for i in range(64)}
    values = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.linked(df, simhash.Params(parts=parts, block=16)).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    root = {v: v for v in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = plain_components([(i, v) for i, v in enumerate(sorted(fps))])
    groups = {}
    for v, (_, _, c) in zip(sorted(fps), want):
        groups.setdefault(c, set()).add(find(v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    n_pairs = len(fps) ** 2
    assert len(links) < n_pairs / 4


def test_tiles_skip_only_what_is_too_far():
    """Fingerprints within the radius are always in tiles one step apart."""
    rng = np.random.default_rng(1)
    for parts in (1, 2, 4, 8):
        width = 64 // parts
        reach = set(simhash.steps(parts, 3))
        for _ in range(200):
            a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            b = a
            for bit in rng.choice(64, 3, replace=False).tolist():
                b ^= 1 << bit
            tile = lambda x: sum(((x >> (i * width)) & ((1 << width) - 1)).bit_count() << (7 * i) for i in range(parts))  # noqa: E731, B023
            assert tile(b) - tile(a) in reach or tile(a) - tile(b) in reach


def test_batch_setting_is_put_back(spark, sf_small):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "4321")
    try:
        simhash.near_duplicates(table(spark, sf_small, "documents").limit(5)).select(F.count(F.lit(1))).collect()
        assert spark.conf.get(name) == "4321"
    finally:
        spark.conf.unset(name)
