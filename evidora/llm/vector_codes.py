"""Vector code compression: product codes whose entries are found by Exponion search, in exact integers.

1. A vector's components become integers floor(256 * x); it is cut into `parts` equal parts. Each part position has a codebook of
   `entries` entries, at first that part of the vectors of the least ids.
2. A round gives every part the nearest entry of its codebook, then moves each entry to the componentwise floored mean of its parts.
   Entries without parts stay. After the rounds parts are assigned once more.
3. A part starts at its previous entry (the first entry at first), at squared distance u. Whatever is as near or nearer lies within
   twice that distance of the previous entry (triangle inequality), so only the head of that entry's list of neighbours is scanned: the
   neighbours sorted by distance, up to squared distance 4u, ends included. Parts of one previous entry are compared together, in groups
   whose heads have like lengths. Distances are whole numbers, and equal ones go to the lower index, so every run gives one result.

Vectors are kept with their codes in a table of the shared folder, which a round reads and writes anew; of the vectors, only sums
and counts of each entry reach the driver: parts * entries rows from each task, added up by Spark, whatever the table's size.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part and give no row; so do vectors whose
length is not that of the first kept one (the least id). A length that cannot be cut into the parts, or components beyond +-2**17 (whose
squared distances could leave 64 bits on summing), raise ValueError. Fewer vectors than entries make that many entries. Ids may repeat or be null
(last; equal ids in the order of their integers); repeated rows have equal codes and each its row; labels may be null or any type that
groups; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage

#: Rows that are assigned together.
ROWS = 32_768
#: Largest integer component.
LARGEST = 1 << 25


@dataclass(frozen=True)
class Params:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


@dataclass(frozen=True)
class Codebook:
    """One part position's entries, the lists of their neighbours by distance (then index), and these squared distances."""

    entries: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(apart, axis=1, kind="stable")
        return cls(entries, order, np.take_along_axis(apart, order, axis=1))

    def nearest(self, x: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row and its squared distance, and how many distances were computed."""
        code, best = previous.astype(np.int64), ((x - self.entries[previous]) ** 2).sum(axis=1)
        done = len(x)
        by = np.argsort(previous, kind="stable")
        cuts = np.flatnonzero(np.diff(previous[by])) + 1
        for rows in np.split(by, cuts):
            if not len(rows):
                continue
            own = int(previous[rows[0]])
            head = np.searchsorted(self.apart[own], 4 * best[rows], side="right")
            # groups of heads up to 2, 4, 8 ... entries: at most twice the entries that the radius asks for
            level = np.ceil(np.log2(np.maximum(head, 1))).astype(int)
            for g in np.unique(level[head > 1]).tolist():
                of = rows[(level == g) & (head > 1)]
                near = self.order[own, : min(1 << g, len(self.entries))]
                d = ((x[of, None, :] - self.entries[near][None, :, :]) ** 2).sum(axis=2)
                done += d.size
                least = d.min(axis=1)
                code[of] = np.where(d == least[:, None], near[None, :], len(self.entries)).min(axis=1)
                best[of] = least
        return code, best, done


def assign(x: np.ndarray, codes: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, int]:
    """New codes, summed squared distances, and distances computed, for rows of integers with their previous codes."""
    width = x.shape[1] // len(books)
    out, error, done = np.empty_like(codes), np.zeros(len(x), np.int64), 0
    for i, book in enumerate(books):
        code, best, n = book.nearest(x[:, i * width : (i + 1) * width], codes[:, i])
        out[:, i] = code
        error += best
        done += n
    return out, error, done


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to ROWS rows or so."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy().astype(np.int64).reshape(t.num_rows, -1)


def _codes(t: pa.Table, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("code").to_pylist()), "<u2").reshape(t.num_rows, parts).astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    books = [Codebook.of(e) for e in entries]
    for t in _gathered(batches):
        codes, error, _ = assign(_matrix(t, "x"), _codes(t, len(books)), books)
        t = t.set_column(t.schema.get_field_index("code"), "code", pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary()))
        yield from t.set_column(t.schema.get_field_index("error"), "error", pa.array(error)).to_batches()


def _sums(batches: Iterator[pa.RecordBatch], parts: int, entries: int) -> Iterator[pa.RecordBatch]:
    """Rows with codes -> for each part position and entry that this task met: how many parts, and their sums."""
    count, total = np.zeros((parts, entries), np.int64), None
    for t in _gathered(batches):
        x, codes = _matrix(t, "x"), _codes(t, parts)
        width = x.shape[1] // parts
        if total is None:
            total = np.zeros((parts, entries, width), np.int64)
        for i in range(parts):
            count[i] += np.bincount(codes[:, i], minlength=entries)
            np.add.at(total[i], codes[:, i], x[:, i * width : (i + 1) * width])
    if total is not None:
        part, entry = np.nonzero(count)
        flat = total[part, entry]
        ends = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=["part", "entry", "n", "s"])


def integers(vectors: DataFrame, p: Params, vec_id: str, embedding: str, label: str | None) -> DataFrame:
    """id, label, x, code, error of the vectors that take part, with code zero."""
    value = F.col(embedding)
    fit = value.isNotNull() & (F.size(value) > 0) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(fit).select(F.col(vec_id).alias("id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), F.transform(value, lambda v: v.cast("double") * p.scale).alias("v"))
    small = F.forall("v", lambda v: (v >= -LARGEST) & (v < LARGEST))
    whole = F.transform("v", lambda v: F.floor(F.when(small, v).otherwise(F.raise_error(F.lit("ValueError: a component is too large for exact 64-bit distances")))).cast("int"))
    return rows.select("id", "label", whole.alias("x"), F.lit(b"\x00\x00" * p.parts).alias("code"), F.lit(0).cast("long").alias("error"))


def compress(vectors: DataFrame, params: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, x, code, error), the final codebooks). code: one byte pair a part, little-endian."""
    p = params
    if p.entries > 1 << 16:
        raise ValueError("at most 65536 entries")
    now = stage(integers(vectors, p, vec_id, embedding, label), "points")
    first = now.orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(1).collect()
    if not first:
        return now, []
    size = len(first[0].x)
    if size % p.parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {p.parts} equal parts")
    start = now.where(F.size("x") == size).orderBy(F.col("id").asc_nulls_last(), "x").select("x").limit(p.entries).collect()
    books = list(np.array([r.x for r in start], np.int64).reshape(len(start), p.parts, size // p.parts).transpose(1, 0, 2).copy())
    now_rows = now.where(F.size("x") == size)
    for r in range(p.rounds + 1):
        after = stage(now_rows.mapInArrow(lambda b, books=books: _assign(b, books), now.schema), "codes")
        drop_stage(now)
        now = now_rows = after
        if r == p.rounds:
            break
        sums = now.mapInArrow(lambda b: _sums(b, p.parts, len(start)), "part int, entry int, n long, s array<long>")
        of = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size // p.parts)])
        books = [b.copy() for b in books]
        for row in of.collect():  # parts * entries rows at most
            books[row.part][row.entry] = np.array([v // row.n for v in row[3:]], np.int64)
    return now, books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """codes with y: the integers that the code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books])
    number = lambda i: F.conv(F.hex(F.concat(F.substring("code", 2 * i + 2, 1), F.substring("code", 2 * i + 1, 1))), 16, 10).cast("int")
    return codes.withColumn("y", F.flatten(F.array(*[table[i][number(i)] for i in range(len(books))])))


def code_table(vectors: DataFrame, params: Params = Params(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels), codebooks_sha256."""
    codes, books = compress(vectors, params, vec_id, embedding, label)
    by_label = stage(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    joined = codes.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    low = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(params.parts - 1)), lambda i: F.hex(F.col("code").substr(2 * i + 1, F.lit(1)))), "")
    return joined.select(F.col("id").alias(vec_id), F.lower(low).alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
