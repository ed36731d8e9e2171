"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of n words may differ from a passage by k = floor(n * error_rate) word edits. Cut into k + 1 pieces, at least one
piece must then stand in the passage unchanged. All pieces are sought in every whole text at once (an Aho-Corasick pass), and
around each hit Myers' bit-parallel algorithm gives the least edit distance of the item to any stretch of the text; a distance
of at most k is a match. No text is shuffled. Words are lower-cased runs of letters, digits and underscores, so case,
punctuation and spacing do not count.

The distinct item texts are read in blocks of bounded size by a hash, each a pass over the documents; usually there is one. Hits
carry the key of an item's text and get the ids of all items of that text by a join, so repeated items take no room in a block.

Defined results: null and empty texts and items match nothing; a text of any length is searched whole; repeated items and documents
match each; of several places of an item the first of the least distance is told; an item of one word or more always has k < n, so
it never matches the empty passage; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_text_batches

ERROR_RATE = 0.2
#: Characters of items in one pass, so that the automaton of a worker stays below about 1 GB.
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")

_built: dict[str, tuple] = {}


def normal_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def cut_pieces(words: list[str], k: int) -> list[tuple[int, list[str]]]:
    """k + 1 pieces of even length: (offset of its first word, words)."""
    n, parts = len(words), k + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:])]


def myers(pattern: list, text: list) -> tuple[int, int]:
    """The least edit distance of pattern to any stretch of text, and the index after the stretch's last element.

    Bit-parallel over the pattern: one machine-independent integer holds a column of vertical differences.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


def build(items: list[tuple[object, str]], error_rate: float):
    """(automaton over the pieces, words and budgets of the items)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    where: dict[str, list[tuple[int, int]]] = {}
    kept = []
    for item_id, text in items:
        w = normal_words(text)
        if not w:
            continue
        k = int(len(w) * error_rate + 1e-9)
        for offset, piece in cut_pieces(w, k):
            where.setdefault(f" {' '.join(piece)} ", []).append((len(kept), offset))
        kept.append((item_id, w, k))
    for p, at in where.items():
        auto.add_word(p, (len(p), at))
    auto.make_automaton()
    return auto if where else None, kept


def find_items(text: str | None, auto, kept) -> dict[int, tuple[int, int, int]]:
    """{item: (distance, first word about, word after)} of the items that stand in a text, the best place of each."""
    words = normal_words(text)
    if not words or auto is None:
        return {}
    hay = f" {' '.join(words)} "
    found: dict[int, tuple[int, int, int]] = {}
    tried: set[tuple[int, int]] = set()
    last_end, last_word = 0, 0
    for end, (size, at) in auto.iter(hay):
        first = end - size + 1
        if first >= last_end:
            last_word += hay.count(" ", last_end, first)
            last_end = first
            p = last_word
        else:
            p = last_word - hay.count(" ", first, last_end)
        for item, offset in at:
            start = p - offset
            if (item, start) in tried:
                continue
            tried.add((item, start))
            _, w, k = kept[item]
            low = max(0, start - k)
            distance, stop = myers(w, words[low : start + len(w) + k])
            if distance <= k and (item not in found or distance < found[item][0]):
                found[item] = (distance, max(0, low + stop - len(w)), low + stop)
    return found


def item_blocks(items: DataFrame, item_text: str, block_chars: int) -> Iterator[DataFrame]:
    """(key, text) of the distinct item texts, in blocks of about block_chars characters."""
    texts = items.where(F.col(item_text).isNotNull()).select(F.unhex(F.substring(F.sha2(F.col(item_text), 256), 1, 32)).alias("key"), F.col(item_text).alias("text")).distinct()
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        yield texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)


def _searcher(spark: SparkSession, block: DataFrame, error_rate: float):
    """A function that builds a block's automaton once in a worker."""
    rows = [(bytes(r[0]), r[1]) for r in block.collect()]  # at most about block_chars characters
    shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

    def built():
        if name not in _built:
            _built.clear()
            _built[name] = build(shared.value, error_rate)
        return _built[name]

    return built


def match_items(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, first_word, last_word (exclusive): one row for each item that stands in a document.

    If both ids have one name, the item's is prefixed by 'item_'.
    """
    spark = docs.sparkSession
    small_text_batches(spark)
    shape = f"_doc {docs.schema[doc_id].dataType.simpleString()}, _key binary, distance int, first_word int, last_word int"
    out = None
    for block in item_blocks(items, item_text, block_chars):
        built = _searcher(spark, block, error_rate)

        def scan(batches: Iterator[pa.RecordBatch], built=built) -> Iterator[pa.RecordBatch]:
            auto, kept = built()
            for b in batches:
                at, key, rows = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for k, place in sorted(find_items(t, auto, kept).items()):
                        at.append(i)
                        key.append(kept[k][0])
                        rows.append(place)
                ints = [pa.array([r[j] for r in rows], pa.int32()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(key, pa.binary()), *ints], names=["_doc", "_key", "distance", "first_word", "last_word"])

        one = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).mapInArrow(scan, shape)
        out = one if out is None else out.unionByName(one)
    keys = items.select(F.col(item_id).alias("_item"), F.unhex(F.substring(F.sha2(F.col(item_text), 256), 1, 32)).alias("_key"))
    name = item_id if item_id != doc_id else f"item_{item_id}"
    return out.join(keys, "_key").select(F.col("_doc").alias(doc_id), F.col("_item").alias(name), "distance", "first_word", "last_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, text: str = "text", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without those in which a test item stands. A filter inside the scan: no join on ids, so repeated ids are judged row by row."""
    spark = docs.sparkSession
    small_text_batches(spark)
    at = docs.columns.index(text)
    for block in item_blocks(items, item_text, block_chars):
        built = _searcher(spark, block, error_rate)

        def keep(batches: Iterator[pa.RecordBatch], built=built) -> Iterator[pa.RecordBatch]:
            auto, kept = built()
            for b in batches:
                yield b.filter(pa.array([not find_items(t, auto, kept) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
