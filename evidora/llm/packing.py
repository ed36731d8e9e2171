"""Packing of documents into sequences by vector best-fit.

Bins have three residual capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces of one length
are interchangeable, so the search runs over the histogram of lengths (at most max_tokens entries, whatever the size of the
corpus): a bin opens with the longest piece left and is filled, under every constraint, with the length that scores best by
weighted dot product of residuals and demands, or that leaves the smallest weighted residual norm, looking one piece ahead.
A filling is repeated as often as the counts allow, so the plan has a few thousand rows. Pieces get a running number within
their length, from counts in salted groups and never from one sort of a hot length; a binary search in the plan then turns
(length, number) into a sequence and an offset.

Defined results: null and empty texts are the end id alone; a document longer than a sequence is cut so that all its pieces
but the first are full; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_text_batches, stage
from .tokens import default_path, encoder

END_ID = 2
#: Pieces numbered in one task's group, about.
GROUP_PIECES = 50_000


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. weights: of tokens, documents and attention cost in the scores; rule: 'norm' or 'dot'."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)
    rule: str = "norm"


def pieces(docs: DataFrame, max_tokens: int = 1024, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): one row for each piece of each document."""
    small_text_batches(docs.sparkSession)
    path = tokenizer or default_path()
    id_type = docs.schema[doc_id].dataType
    schema = f"{doc_id} {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            at, piece, start, length, crc, held = [], [], [], [], [], []
            seen: dict[str, np.ndarray] = {}
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                ids = seen.get(t)
                if ids is None:
                    ids = np.array([*encode(t), END_ID], dtype="<u4")
                    seen[t] = ids
                n = len(ids)
                first = n % max_tokens or max_tokens
                edges = [0, *range(first, n + 1, max_tokens)]
                for k, (a, z) in enumerate(zip(edges, edges[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[a:z].tobytes()))
                    if with_ids:
                        held.append(ids[a:z].astype(np.int32))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [doc_id, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(cut, schema)


def fill_plan(counts: np.ndarray, cap: Capacity) -> list[tuple[list[tuple[int, int]], int]]:
    """counts[l]: pieces of length l. [( [(length, how many)], times )]: fillings, longest piece first."""
    left = counts.astype(np.int64).copy()
    sizes = np.arange(len(left))
    limits = np.array([cap.tokens, cap.documents, cap.attention], dtype=float)
    w = np.array(cap.weights) / limits
    demand = np.stack([sizes, np.ones_like(sizes), sizes.astype(np.int64) ** 2]).astype(float)
    if any(left[s] and not np.all(demand[:, s] <= limits) for s in np.flatnonzero(left)):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    plan = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return plan
        filling: dict[int, int] = {}
        residual = limits.copy()
        free = left.copy()
        pick = int(have[-1])
        while pick > 0:
            filling[pick] = filling.get(pick, 0) + 1
            free[pick] -= 1
            residual -= demand[:, pick]
            fits = np.flatnonzero((free > 0) & np.all(demand <= residual[:, None], axis=0))
            if not len(fits):
                break
            if cap.rule == "dot":
                score = (w[:, None] ** 2 * residual[:, None] * demand[:, fits]).sum(axis=0)
                pick = int(fits[np.argmax(score)])
                continue
            # after a piece, the largest next one that fits is the best completion: score what both leave
            after = residual[:, None] - demand[:, fits]
            room = np.minimum(after[0], np.sqrt(np.maximum(after[2], 0)))
            room[after[1] < 1] = 0
            at = np.searchsorted(fits, room, side="right") - 1
            second = np.where(at >= 0, fits[np.maximum(at, 0)], 0)
            again = (second == fits) & (free[fits] < 2)
            lower = np.where(at >= 1, fits[np.maximum(at - 1, 0)], 0)
            second = np.where(again, lower, second)
            rest = after - demand[:, second] * (second > 0)
            norm = ((w[:, None] * rest) ** 2).sum(axis=0)
            pick = int(fits[len(norm) - 1 - np.argmin(norm[::-1])])
        times = min(int(left[s]) // n for s, n in filling.items())
        for s, n in filling.items():
            left[s] -= n * times
        plan.append((sorted(filling.items(), reverse=True), times))


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, times, offset): number r of a row is in sequence first + r - first number."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for size, n in filling:
            for _ in range(n):
                out.setdefault(size, []).append((used.get(size, 0), sequence, times, offset))
                used[size] = used.get(size, 0) + times
                offset += size
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(cut: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Pieces (with a column length) plus sequence_id and offset.

    The histogram of lengths and the plan made of it, both bounded by the capacity in tokens, are all that the driver holds.
    """
    cut = stage(cut, "pieces")
    order = [F.col(c) for c in cut.columns if c != "ids"]
    n = cut.count()
    salts = max(1, -(-n // GROUP_PIECES))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    groups = cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = np.zeros(cap.tokens + 1, dtype=np.int64)
    for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most cap.tokens rows
        counts[r["length"]] = r["n"]
    plan = slots(fill_plan(counts, cap))
    numbered = cut.withColumn("_number", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    numbered = numbered.join(bases, ["length", "_salt"]).withColumn("_number", F.col("_number") + F.col("_base")).drop("_salt", "_base")
    numbered = numbered.select(*[c for c in cut.columns if c != "_salt"], F.col("_number").cast("long").alias("_number"))
    shape = numbered.drop("_number").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, number = b.column("length").to_numpy(zero_copy_only=False), b.column("_number").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                own, rows = size == s, plan[int(s)]
                at = np.searchsorted(rows[:, 0], number[own], side="right") - 1
                seq[own] = rows[at, 1] + number[own] - rows[at, 0]
                off[own] = rows[at, 3]
            kept = [b.column(c) for c in b.schema.names if c != "_number"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*[c for c in b.schema.names if c != "_number"], "sequence_id", "offset"])

    return numbered.mapInArrow(place, shape)


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, cap.tokens, doc_id, text, tokenizer, with_ids), cap)
