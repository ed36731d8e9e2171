"""SimHash near-duplicates by tiled exact comparison.

1. Each text becomes one 64-bit fingerprint in the task that reads it: A-Z are lower-cased, words are runs of bytes other than ASCII
   white space, shingles are `width` neighbouring words joined by a space (repeats count; a text of fewer words is one shingle), and a
   bit is set where it is set in over half the XXH64 hashes (seed 42) of the shingles. Nothing is shuffled but 8 bytes a row.
2. Equal fingerprints are one row from here on, so exact copies cost nothing.
3. A fingerprint's tile is the tuple of its population counts over `parts` equal runs of bits. One differing bit changes one of the
   counts by one, so fingerprints within the radius are in tiles whose counts differ by at most the radius in sum: all other pairs of
   tiles are skipped. The number of parts follows the number of fingerprints (1, 2, 4 or 8), so tiles stay small as tables grow; what
   is found does not depend on it. A tile is kept as blocks of at most about `block` fingerprints.
4. Each pair of blocks of neighbouring tiles is compared in one task with numpy: exclusive-or and bit counts of all against all. Of its
   links a pair of blocks hands on a spanning forest only, so a group of n similar texts never becomes n * n rows.
5. Connected components over these forests; a component is named by the least id of all its rows.

All pairs within the radius are found: there are no candidates that hashing could miss.

Defined results: a text without words (null and empty ones too) has fingerprint zero and is linked like any other; repeated rows are
copies; null ids may occur (a component is named by its least id that is not null); texts of any length are whole texts; equal
fingerprints of different texts are linked (distance zero); there are no ties to decide, since all links within the radius count; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import drop_stage, stage, text_batches
from .near_dedup import components

SEED = 42
#: Hashes whose bits are unpacked at once.
CHUNK = 1 << 16
#: Rows of a block that are compared with another block at once: some 64 * block * 8 bytes stay in the processor's cache.
ROWS = 64
#: Distinct tiles that random fingerprints fill, for each number of parts: 2 to the entropy of the population counts.
USUAL_TILES = {1: 17, 2: 137, 4: 4_700, 8: 1_400_000}


@dataclass(frozen=True)
class Params:
    width: int = 3
    radius: int = 3
    block: int = 2048
    #: None: the finest division that leaves a usual tile at least half a block.
    parts: int | None = None


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    runs = zip(*(itertools.islice(words, i, None) for i in range(width))) if len(words) > width else [words]
    return np.fromiter((xxh64_intdigest(b" ".join(x), SEED) for x in runs), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8", copy=False)
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * count > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(shingle_hashes(t.as_py() or b"", width)) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long): one row a document, written once."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("_text"))
    kind = dict(rows.dtypes)["id"]
    with text_batches(docs.sparkSession):
        return stage(rows.mapInArrow(lambda x: _fingerprints(x, params.width), f"id {kind}, fp long"), "fingerprints")


def division(n: int, p: Params) -> int:
    """Into how many parts the bits are divided for n fingerprints."""
    if p.parts:
        return p.parts
    return max(k for k, tiles in USUAL_TILES.items() if k == 1 or n >= tiles * p.block // 2)


def tile_of(fp: Column, parts: int) -> Column:
    """The population counts of the parts as one long: seven bits each."""
    width = 64 // parts
    mask = (1 << width) - 1 if width < 64 else -1
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask))).cast("long") * F.lit(1 << (7 * i)) for i in range(parts)]
    out = counts[0]
    for c in counts[1:]:
        out = out + c
    return out


def steps(parts: int, radius: int) -> list[int]:
    """From a tile to each tile that it must be compared with, each unordered pair of tiles once and the tile itself as 0.

    A step takes counts apart by at most the radius in sum. A count is at most 64, so a step below zero borrows from the next
    seven bits and gives a number that no tile has.
    """

    def vectors(k: int, left: int) -> Iterator[tuple[int, ...]]:
        if not k:
            yield ()
            return
        for d in range(-left, left + 1):
            for rest in vectors(k - 1, left - abs(d)):
                yield (d, *rest)

    half = [v for v in vectors(parts, radius) if next((x for x in v if x), 1) > 0]
    return [sum(d << (7 * i) for i, d in enumerate(v)) for v in half]


def links_between(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links between two arrays of fingerprints; for a block with itself a is b."""
    own = a is b
    values = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    root = np.arange(len(values))
    for at in range(0, len(a), ROWS):
        near = np.bitwise_count(a[at : at + ROWS, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + shift
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:  # to the roots
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    child = np.flatnonzero(root != np.arange(len(values)))
    return values[child], values[root[child]]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(is one block, fingerprints a, fingerprints b) -> (a, b) of a forest."""
    for batch in batches:
        for one, x, y in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a = np.frombuffer(x, "<u8")
            child, root = links_between(a, a if one else np.frombuffer(y, "<u8"), radius)
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], names=["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, block, list of fingerprints) -> (tile, block, their bytes)."""
    for b in batches:
        packed = [np.asarray(x.values.to_numpy(), "<i8").tobytes() for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["tile", "block", "fps"])


def linked(distinct: DataFrame, params: Params = Params(), n: int | None = None) -> DataFrame:
    """a, b: links between fingerprints (column fp, each once) that connect all that are within the radius of each other.

    n: the number of fingerprints, if it is known. Blocks are dealt by hash; a tile with more rows has more blocks. Tiles are joined by
    their keys, which are unique, and pairs of blocks are made and dealt to tasks before the blocks' bytes are fetched.
    """
    p = params
    spark = distinct.sparkSession
    parts = division(distinct.count() if n is None else n, p)
    rows = distinct.select("fp", tile_of(F.col("fp"), parts).alias("tile"))
    sizes = stage(rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / p.block).cast("int").alias("blocks")), "tiles")
    dealt = rows.join(sizes, "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"), "fp")
    blocks = stage(dealt.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")).mapInArrow(_blocks, "tile long, block int, fps binary"), "blocks")
    to = sizes.select(F.col("tile").alias("ta"), F.col("blocks").alias("na"), F.explode(F.array(*[F.lit(s).cast("long") for s in steps(parts, p.radius)])).alias("step"))
    met = to.withColumn("tb", F.col("ta") + F.col("step")).join(sizes.toDF("tb", "nb"), "tb")
    number = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pairs = met.select("ta", "tb", "nb", F.explode(number("na")).alias("ba")).select("ta", "tb", "ba", F.explode(number("nb")).alias("bb"))
    pairs = pairs.where("ta <> tb or ba <= bb")
    both = pairs.join(blocks.toDF("ta", "ba", "xa"), ["ta", "ba"]).join(blocks.toDF("tb", "bb", "xb"), ["tb", "bb"])
    work = both.select(((F.col("ta") == F.col("tb")) & (F.col("ba") == F.col("bb"))).alias("one"), "xa", "xb")
    with text_batches(spark):
        out = stage(work.mapInArrow(lambda x: _compare(x, p.radius), "a long, b long"), "links")
    drop_stage(blocks)
    drop_stage(sizes)
    return out


def near_duplicates(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least id that links of at most `radius` bits lead to."""
    prints = fingerprints(docs, params, doc_id, text)
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = linked(distinct, params)
    roots = stage(components(links), "roots")
    joined = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(joined.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    names = stage(joined.join(named, "root").select("fp", "component_id"), "names")
    out = prints.join(names, "fp")
    return out.select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
