"""Ranked lexical search: branch and bound over a hierarchical tree of maxima for each term.

1. One pass over the texts counts the terms of every document and keeps those that some item asks for (the vocabulary, which the driver
   holds: at most VOCABULARY_BYTES; more items are searched in several blocks). Totals and document frequencies come from that table.
2. The counted documents are cut into shards of at most SHARD documents, in order of length. A shard is one row: its postings by
   document with their exact integer scores, and for each term a tree over ranges of its documents: the largest score of the term in each range of
   LEAF documents, then in FAN such ranges, and so on up to the shard.
3. A shard's bound for an item is the sum of its terms' maxima at the top. Each item first searches the shard of its highest bound; its
   k-th score there is a floor. Only shards whose bound reaches the floor (equal ones too, since ties go to the lesser id) are searched then.
4. Within a shard ranges wait in a heap by their summed bounds. The highest is opened: into its parts, or at the bottom into exact
   scores. The search ends when the highest bound is below the k-th score; ranges of an equal bound are opened.

No document is left out: what is not opened cannot reach the first k. Nothing is shuffled but counts, bounds and at most k rows an item
and shard; the driver holds the vocabulary and two numbers an item of one job (at most QUERY_TERMS terms).

Defined results: terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased; null and empty
texts have none and are neither counted nor found; an item without terms finds nothing; items of one id and one text are one item, of
one id and several texts are several; repeated rows of documents are documents of their own; equal scores go to the lesser id, null ids
last; texts of any length are whole texts; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stage, stage, text_batches

#: Distinct terms of one block of items, as bytes.
VOCABULARY_BYTES = 16 << 20
#: Terms of the items that are searched in one job.
QUERY_TERMS = 2_000_000
#: Fixed values of the score.
UNIT, SCALE, FLAT, SLOPE = 1_000_000_000, 1_000, 10, 90

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Params:
    k: int = 10
    shard: int = 8192
    leaf: int = 32
    fan: int = 8


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()


# ---- items and their terms


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(set(terms_of(t.as_py()))) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])


def items_table(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item, terms (distinct, in order of bytes): one row for each id and text, without items that have no term."""
    rows = items.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("_text")).distinct()
    with text_batches(items.sparkSession):
        return stage(rows.mapInArrow(_item_terms, f"item {dict(rows.dtypes)['item']}, terms array<binary>").where("size(terms) > 0"), "items")


def vocabularies(items: DataFrame, bound: int = VOCABULARY_BYTES, level: int = 0) -> Iterator[tuple[DataFrame, list[bytes]]]:
    """Blocks of items with their distinct terms, within the bound each: a block beyond it is halved by hash until it is one item."""
    terms = items.select(F.explode("terms").alias("t")).distinct()
    size = terms.agg(F.sum(F.length("t") + 8)).first()[0] or 0
    if size > bound and items.count() > 1 and level < 64:
        half = F.pmod(F.xxhash64("item", "terms", F.lit(level)), F.lit(2))
        for i in range(2):
            yield from vocabularies(items.where(half == i), bound, level + 1)
    elif size:
        yield items, sorted(bytes(r.t) for r in terms.toLocalIterator())


# ---- the index


def _count(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, number of terms, vocabulary numbers in order, their counts)."""
    number = {t: i for i, t in enumerate(vocabulary)}.get
    for b in batches:
        ids, n, t, f, ends = [], [], [], [], [0]
        for i, text in enumerate(b.column(1)):
            words = terms_of(text.as_py())
            if words:
                x, c = np.unique(np.array([v for v in map(number, words) if v is not None], np.int32), return_counts=True)
                ids.append(i)
                n.append(len(words))
                t.append(x)
                f.append(c)
                ends.append(ends[-1] + len(x))
        if ids:
            ends = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (t, f)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), pa.array(n, pa.int64()), *lists], names=["id", "n", "t", "f"])


def counted(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n, t, f: each document with a term, its length, and its terms of the vocabulary with their counts."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("_text"))
    with text_batches(docs.sparkSession):
        return stage(rows.mapInArrow(lambda x: _count(x, vocabulary), f"id {dict(rows.dtypes)['id']}, n long, t array<int>, f array<int>"), "counted")


def weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The exact score of each posting: its count, its document's length and its term's weight."""
    if 90 * n_docs * int(n.max(initial=0)) < 1 << 63:
        m = FLAT + (SLOPE * n * n_docs) // n_terms
    else:
        m = np.array([FLAT + SLOPE * int(x) * n_docs // n_terms for x in n], np.int64)
    return w * ((UNIT * tf) // (1000 * tf + 8 * m))


@dataclass
class Level:
    """The largest score of each term in each range of a level: sorted by term, then range."""

    width: int
    term: np.ndarray
    place: np.ndarray
    top: np.ndarray

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """The summed maxima of some terms in each range."""
        a, b = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        out = np.zeros(self.width, np.int64)
        for i, j in zip(a.tolist(), b.tolist()):
            out[self.place[i:j]] += self.top[i:j]
        return out


def tree(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, p: Params) -> list[Level]:
    """From the bottom to the single range at the top."""
    levels, place, width = [], doc // p.leaf, -(-n_docs // p.leaf)
    while True:
        by = np.lexsort((place, term))
        term, place, impact = term[by], place[by], impact[by]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (place[1:] != place[:-1])]))
        term, place, impact = term[first], place[first], np.maximum.reduceat(impact, first)
        levels.append(Level(width, term, place, impact))
        if width == 1:
            return levels
        place, width = place // p.fan, -(-width // p.fan)


SHARD_FIELDS = "shard long, ids array<{}>, ends binary, terms binary, scores binary, level_widths array<int>, level_terms array<binary>, level_places array<binary>, level_tops array<binary>, top_terms binary, top_scores binary"


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int, p: Params, schema: pa.Schema | None = None) -> Iterator[pa.RecordBatch]:
    task, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def build(t: pa.Table) -> pa.RecordBatch:
        nonlocal made
        t = t.sort_by("n").combine_chunks()
        n = t.column("n").to_numpy()
        term, tf = (t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("t", "f"))
        sizes = t.column("t").combine_chunks().value_lengths().to_numpy()
        doc = np.repeat(np.arange(len(n)), sizes)
        score = impacts(tf, n[doc], weights[term], n_docs, n_terms)
        levels = tree(term, doc, score, len(n), p)
        data = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
        top = levels[-1]
        kind = pa.list_(t.column("id").type)
        lists = lambda x: pa.array([[data(y, k) for y, k in x]], pa.list_(pa.binary()))
        binary = lambda x, k: pa.array([data(x, k)], pa.binary())
        made += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task << 32 | made], pa.int64()), pa.array([t.column("id").to_pylist()], kind), binary(np.concatenate([[0], np.cumsum(sizes)]), "<i4"), binary(term, "<i4"), binary(score, "<i8"),
                pa.array([[x.width for x in levels]], pa.list_(pa.int32())), lists([(x.term, "<i4") for x in levels]), lists([(x.place, "<i4") for x in levels]), lists([(x.top, "<i8") for x in levels]), binary(top.term, "<i4"), binary(top.top, "<i8"),
            ],
            names=[f.split()[0] for f in SHARD_FIELDS.split(", ")],
        )

    for b in batches:
        while b.num_rows:
            take = min(b.num_rows, p.shard - rows)
            held.append(b.slice(0, take))
            b, rows = b.slice(take), rows + take
            if rows == p.shard:
                yield build(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        yield build(pa.Table.from_batches(held))


def index(postings: DataFrame, vocabulary: list[bytes], params: Params = Params()) -> DataFrame:
    """The shards of counted documents, written once. Frequencies are counted over all of them; the driver holds one a vocabulary term."""
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r.t] = r.df
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    rows = postings.where("size(t) > 0")
    schema = SHARD_FIELDS.format(dict(rows.dtypes)["id"])
    return stage(rows.mapInArrow(lambda x: _shards(x, weights, n_docs, n_terms, params), schema), "shards")


# ---- the search


@dataclass
class Shard:
    ids: list
    ends: np.ndarray
    terms: np.ndarray
    scores: np.ndarray
    levels: list[Level]

    def best(self, terms: np.ndarray, asked: np.ndarray, k: int, floor: int, p: Params) -> tuple[list[tuple[int, int]], int]:
        """The first k (score, place) of scores from the floor on and above 0, and the number of bottom ranges opened. asked: marks the item's terms."""
        found: list[tuple] = []  # the worst first: (score, order of the id reversed by _Late, place)
        limit, opened = max(floor, 1), 0
        sums: dict[int, np.ndarray] = {}
        at = len(self.levels) - 1
        heap = [(-int(x), at, i) for i, x in enumerate(self.levels[at].bounds(terms))]
        while heap:
            bound, at, i = heapq.heappop(heap)
            if -bound < limit:
                break
            if at:
                below = at - 1
                if below not in sums:
                    sums[below] = self.levels[below].bounds(terms)
                for j, x in enumerate(sums[below][i * p.fan : (i + 1) * p.fan].tolist(), i * p.fan):
                    if x >= limit:
                        heapq.heappush(heap, (-x, below, j))
                continue
            opened += 1
            ends = self.ends[i * p.leaf : (i + 1) * p.leaf + 1]
            own = slice(int(ends[0]), int(ends[-1]))
            total = np.concatenate([[0], np.cumsum(self.scores[own] * asked[self.terms[own]])])
            score = np.diff(total[ends - ends[0]])
            for d in np.flatnonzero(score >= limit).tolist():
                entry = (int(score[d]), _Late(self.ids[i * p.leaf + d]), i * p.leaf + d)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif found[0][:2] < entry[:2]:
                    heapq.heapreplace(found, entry)
                if len(found) == k:
                    limit = max(limit, found[0][0])
        return [(x[0], x[2]) for x in found], opened


@dataclass(order=False)
class _Late:
    """Orders ids the other way round, null as the latest."""

    id: object

    def __lt__(self, other: _Late) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return other.id < self.id


def _sums(flat: np.ndarray, at: np.ndarray, n_vocabulary: int, top_terms: pa.Scalar, top_scores: pa.Scalar) -> np.ndarray:
    """The bound of a shard for each item."""
    top = np.zeros(n_vocabulary, np.int64)
    top[np.frombuffer(top_terms.as_buffer(), "<i4")] = np.frombuffer(top_scores.as_buffer(), "<i8")
    return np.add.reduceat(top[flat], at[:-1])


def _flat(terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(terms), np.concatenate([[0], np.cumsum([len(t) for t in terms])])


def _search(batches: Iterator[pa.RecordBatch], terms: list[np.ndarray], n_vocabulary: int, first: np.ndarray, floors: np.ndarray | None, kind: pa.DataType, p: Params) -> Iterator[pa.RecordBatch]:
    """Shards -> (item, id, score), and for each item and shard that was searched a row without a score that counts opened ranges.

    Without floors an item searches its first shard only; with them every other shard whose bound reaches its floor.
    """
    asked = np.zeros(n_vocabulary, np.int64)
    flat, at = _flat(terms)
    for b in batches:
        for r in range(b.num_rows):
            row = {c: b.column(c)[r] for c in b.schema.names}
            number = row["shard"].as_py()
            wanted = first == number
            if floors is not None:
                bound = _sums(flat, at, n_vocabulary, row["top_terms"], row["top_scores"])
                wanted = ~wanted & (bound > 0) & (bound >= floors)
            wanted = np.flatnonzero(wanted).tolist()
            if not wanted:
                continue
            array = lambda x, k: np.frombuffer(x.as_buffer(), k)
            parts = zip(row["level_widths"].as_py(), row["level_terms"].values, row["level_places"].values, row["level_tops"].values)
            levels = [Level(w, array(t, "<i4"), array(i, "<i4"), array(s, "<i8")) for w, t, i, s in parts]
            shard = Shard(row["ids"].as_py(), array(row["ends"], "<i4"), array(row["terms"], "<i4"), array(row["scores"], "<i8"), levels)
            items, ids, scores, opened = [], [], [], []
            for item in wanted:
                mine = terms[item]
                asked[mine] = 1
                got, n = shard.best(mine, asked, p.k, 0 if floors is None else int(floors[item]), p)
                asked[mine] = 0
                items += [item] * (len(got) + 1)
                ids += [shard.ids[x] for _, x in got] + [None]
                scores += [s for s, _ in got] + [None]
                opened += [0] * len(got) + [n]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64()), pa.array(opened, pa.int32())], names=["item", "id", "score", "opened"])


def _bounds(batches: Iterator[pa.RecordBatch], terms: list[np.ndarray], n_vocabulary: int) -> Iterator[pa.RecordBatch]:
    """Shards' tops -> (item, shard, bound) where the bound is above 0."""
    flat, at = _flat(terms)
    for b in batches:
        for shard, t, s in zip(b.column(0), b.column(1), b.column(2)):
            bound = _sums(flat, at, n_vocabulary, t, s)
            some = np.flatnonzero(bound)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([shard.as_py()] * len(some), pa.int64()), pa.array(bound[some])], names=["item", "shard", "bound"])


def search(shards: DataFrame, terms: list[np.ndarray], n_vocabulary: int, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(item, id, score, rank) for items as lists of vocabulary numbers, and (item, shards, searched, opened): what the bounds saved.

    Shards stay where they are written: two numbers an item (its first shard and its floor) go to the tasks that read them.
    """
    p = params
    spark = shards.sparkSession
    kind = dict(shards.dtypes)["ids"][6:-1]
    arrow_kind = pa.schema(spark.createDataFrame([], f"id {kind}").toArrow().schema).field("id").type
    first, floors = np.full(len(terms), -1, np.int64), np.zeros(len(terms), np.int64)
    per_shard = shards.select("shard", "top_terms", "top_scores").mapInArrow(lambda x: _bounds(x, terms, n_vocabulary), "item int, shard long, bound long")
    n_shards = np.zeros(len(terms), np.int64)
    for r in per_shard.groupBy("item").agg(F.max(F.struct("bound", "shard")).alias("b"), F.count(F.lit(1)).alias("n")).collect():  # a row an item
        first[r.item], n_shards[r.item] = r.b.shard, r.n

    def visit(rows: DataFrame, floors: np.ndarray | None) -> DataFrame:
        with text_batches(spark, 4):
            return stage(rows.mapInArrow(lambda x: _search(x, terms, n_vocabulary, first, floors, arrow_kind, p), f"item int, id {kind}, score long, opened int"), "found")

    found = visit(shards, None)
    for r in found.where("score is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():
        floors[r.item] = r.least if r.n >= p.k else 0
    both = found.union(visit(shards, floors))
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = both.where("score is not null").select("item", "id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k)
    totals = spark.createDataFrame([(i, n) for i, n in enumerate(n_shards.tolist()) if n], "item int, shards long")
    work = both.where("score is null").groupBy("item").agg(F.count(F.lit(1)).alias("searched"), F.sum("opened").alias("opened"))
    return ranked, totals.join(work, "item", "left")


def rank_documents(docs: DataFrame, items: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", vocabulary_bytes: int = VOCABULARY_BYTES, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, equal scores by id."""
    spark = docs.sparkSession
    asked = items_table(items, item_id, text)
    item_kind, id_kind = dict(asked.dtypes)["item"], dict(docs.dtypes)[doc_id]
    out = None
    for block, vocabulary in vocabularies(asked, vocabulary_bytes):
        postings = counted(docs, vocabulary, doc_id, text)
        shards = index(postings, vocabulary, params)
        drop_stage(postings)
        total = block.agg(F.sum(F.size("terms"))).first()[0]
        jobs = -(-total // query_terms)
        for job in range(jobs):
            mine = block.where(F.pmod(F.xxhash64("item", "terms"), F.lit(jobs)) == job).collect()
            if not mine:
                continue
            place = {t: i for i, t in enumerate(vocabulary)}
            terms = [np.array(sorted(place[bytes(t)] for t in r.terms), np.int64) for r in mine]
            ranked, _ = search(shards, terms, len(vocabulary), params)
            names = spark.createDataFrame([(i, r.item) for i, r in enumerate(mine)], f"item int, _name {item_kind}")
            part = stage(ranked.join(names, "item").select(F.col("_name").alias(item_id), "rank", F.col("id").alias(doc_id), "score"), "ranked")
            out = part if out is None else out.unionByName(part)
        drop_stage(shards)
    return spark.createDataFrame([], f"{item_id} {item_kind}, rank int, {doc_id} {id_kind}, score long") if out is None else out
