"""Resampling with the draws of a sequential program, made by many tasks.

A group's draws are one sequence of Python's generator: n draws for the first resample, n for the second, and so on. The
generator's outputs are cut into blocks of one length; a task jumps to its block's start. A draw of n values rejects outputs that are too
large, so how many draws a block holds is only known once they are made: a first pass counts them, the driver adds the counts up
(two numbers a block), and the second pass knows which resamples each block's draws belong to.

The values are sorted once by all tasks and written in pieces, as codes of a byte where there are few distinct ones. A task of the second
pass gets a run of blocks and the pieces of one chunk of its group (CHUNK_BYTES), by a shuffle; the driver sees sizes only. A group of
several chunks has its draws made once a chunk. The work is that of the draws, a thousand times as many as values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import twister
from ..sources.staging import stage

#: Values of all groups together: a draw takes one output of 32 bits.
MOST_VALUES = (1 << 32) - 1
#: Values that one task holds: 8 million doubles, or 64 million codes.
CHUNK_BYTES = 1 << 26
#: Outputs that a task makes at least, where there are so many.
LEAST_OUTPUTS = 1 << 27
#: Distinct values up to which a value is a code of one byte.
CODES = 256
#: Outputs of the generator in one block.
BLOCK = 1 << 22


def _blocks_for(n: int, resamples: int, block: int) -> int:
    """Blocks that hold n * resamples draws below n, but for one chance in very many; a shortfall is seen and met with more."""
    outputs = n * resamples * (1 << n.bit_length()) / n
    return int(outputs + 12 * outputs**0.5 + WORDS_SPARE) // block + 1


WORDS_SPARE = 1024


def _draws(n: int, first: int, blocks: int, state: np.ndarray, strides: list[int], block: int) -> Iterator[np.ndarray]:
    """The draws below n of each block of a run, which begins with one jump."""
    generator = twister.generator(twister.block_state(state, first, strides))
    for _ in range(blocks):
        yield twister.below(n, twister.following(generator, block))


def _counted(batches: Iterator[pa.RecordBatch], sizes: list[int], state: np.ndarray, strides: list[int], block: int) -> Iterator[pa.RecordBatch]:
    """(group, first, blocks) -> (group, block, draws)."""
    for b in batches:
        for g, first, blocks in zip(*[c.to_pylist() for c in b.columns]):
            n = [len(d) for d in _draws(sizes[g], first, blocks, state, strides, block)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(blocks, g), pa.int32()), pa.array(np.arange(first, first + blocks), pa.int32()), pa.array(n, pa.int64())], names=["group", "block", "n"])


def _packed(batches: Iterator[pa.RecordBatch], codes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Sorted (group, value) of a partition -> (part, group, place of the first value among the group's in this partition, n, bytes)."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        g, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        data = v if codes is None else np.searchsorted(codes, v).astype(np.uint8)
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
        for i, j in zip(cuts, cuts[1:]):
            last, seen = (last, seen) if g[i] == last else (int(g[i]), 0)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last], pa.int32()), pa.array([seen], pa.int64()), pa.array([j - i], pa.int64()), pa.array([data[i:j].tobytes()], pa.binary())], names=["part", "group", "at", "n", "data"])
            seen += j - i


def _summed(pieces: pa.Table, runs: pa.Table, codes: np.ndarray | None, chunk: int, sizes: list[int], resamples: int, state: np.ndarray, strides: list[int], block: int) -> pa.Table:
    """The pieces of one chunk and a run of blocks -> (group, resample, sum of the chunk's values that the run draws for it)."""
    run = runs.to_pylist()[0]
    g, low, start, n = run["group"], run["chunk"] * chunk, run["start"], sizes[run["group"]]
    held = np.empty(min(chunk, n - low), np.float64 if codes is None else np.uint8)
    for pos, data in zip(pieces.column("pos").to_pylist(), pieces.column("data")):
        piece = np.frombuffer(data.as_buffer(), held.dtype)[max(0, low - pos) :]
        at = max(0, pos - low)
        held[at : at + len(piece)] = piece[: len(held) - at]
    total: dict[int, float] = {}
    for draws in _draws(n, run["first"], run["blocks"], state, strides, block):
        draws, begun = draws[: max(0, n * resamples - start)], start
        start += len(draws)
        if not len(draws):
            continue
        if len(held) < n:
            place = draws - np.uint32(low)  # below low: wraps to more than any place
            mine = place < len(held)
            values = np.zeros(len(draws))
            found = held[place[mine]]
            values[mine] = found if codes is None else codes[found]
        else:
            values = held[draws] if codes is None else codes[held[draws]]
        first, last = begun // n, (start - 1) // n
        cuts = np.concatenate([[0], np.arange(first + 1, last + 1) * n - begun])
        for k, x in enumerate(np.add.reduceat(values, cuts).tolist(), first):
            total[k] = total.get(k, 0.0) + x
    return pa.table({"group": pa.array([g] * len(total), pa.int32()), "b": pa.array(list(total), pa.int32()), "s": pa.array(list(total.values()), pa.float64())})


def sequential_bootstrap(df: DataFrame, by: list[str], order: list[str], value: str, resamples: int = 1000, seed: int = 42, confidence: float = 0.95, block: int = BLOCK) -> DataFrame:
    """by, n, lo, hi: the interval of a group's mean that `random.Random(seed).randrange` gives over its rows in order (rows of equal order by value).

    Null values are 0; a group of one row has the interval (0, 0). Sums of whole numbers are exact; of others they may differ from a
    sequential sum in the last places.
    """
    spark = df.sparkSession
    rows = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct("_v").alias("_d")).collect()  # a row a group
    found = [r for r in found if r["_n"]]
    lengths, total = [r["_n"] for r in found], sum(r["_n"] for r in found)
    if total > MOST_VALUES:
        raise ValueError(f"{total} values: sequential draws are made for at most {MOST_VALUES}; use bootstrap_mean_large")
    kinds = dict(df.dtypes)
    names = spark.createDataFrame([(g, r["_n"], *[r[c] for c in by]) for g, r in enumerate(found)], ", ".join(["_g int", "n long", *[f"{c} {kinds[c]}" for c in by]]))
    large = [g for g, n in enumerate(lengths) if n > 1]
    if not large:
        return names.select(*by, "n", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    codes = None
    if max(r["_d"] for r in found) <= CODES // 2:
        few = rows.select("_v").distinct().limit(CODES + 1).collect()
        codes = np.unique([r["_v"] for r in few]) if len(few) <= CODES else None
    chunk = CHUNK_BYTES // (8 if codes is None else 1)
    state, blocks = twister.seeded(seed), {g: _blocks_for(lengths[g], resamples, block) for g in large}
    strides = twister.doublings(block, (2 * max(blocks.values())).bit_length())
    most = 4 * spark.sparkContext.defaultParallelism

    def cut(g: int, first: int, n: int) -> list[tuple[int, int, int]]:
        """A group's blocks in runs: no more of them than keep all tasks busy, and of LEAST_OUTPUTS at least."""
        step = max(-(-n // most), LEAST_OUTPUTS // block, 1)
        return [(g, k, min(step, first + n - k)) for k in range(first, first + n, step)]

    def dealt(rows: list[tuple], schema: str, *key: str) -> DataFrame:
        return spark.createDataFrame(rows, schema).repartition(2 * len(rows), *key)

    runs: list[tuple[int, int, int]] = []
    held: dict[int, dict[int, int]] = {g: {} for g in large}
    todo = [r for g in large for r in cut(g, 0, blocks[g])]
    while todo:
        runs += todo
        counted = dealt(todo, "group int, first int, blocks int", "group", "first").mapInArrow(lambda x: _counted(x, lengths, state, strides, block), "group int, block int, n long")
        for r in counted.collect():  # a number a block
            held[r.group][r.block] = r.n
        todo = [(g, len(held[g]), 1) for g in large if sum(held[g].values()) < lengths[g] * resamples]

    match = [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    keys = names.select("_g", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    numbered = rows.join(F.broadcast(keys), match) if by else rows.withColumn("_g", F.lit(0))  # a row a group, as counted
    numbered = numbered.select("_g", "_v", *[f"_o{i}" for i in range(len(order))]).orderBy("_g", *[f"_o{i}" for i in range(len(order))], "_v").select("_g", "_v")
    pieces = stage(numbered.mapInArrow(lambda x: _packed(x, codes), "part int, group int, at long, n long, data binary"), "values")
    bases, so_far = [], [0] * len(lengths)
    for r in sorted(pieces.groupBy("part", "group").agg(F.sum("n").alias("n")).collect()):  # a number a partition and group
        bases.append((r.part, r.group, so_far[r.group]))
        so_far[r.group] += r.n
    pos = F.col("base") + F.col("at")
    placed = pieces.join(F.broadcast(spark.createDataFrame(bases, "part int, group int, base long")), ["part", "group"])  # as collected
    placed = placed.select("group", pos.alias("pos"), "data", F.explode(F.sequence(F.floor(pos / chunk).cast("int"), F.floor((pos + F.col("n") - 1) / chunk).cast("int"))).alias("chunk"))
    starts = {g: np.concatenate([[0], np.cumsum([held[g][k] for k in range(len(held[g]))])]).tolist() for g in large}
    work = [(i, g, c, first, n, starts[g][first]) for i, (g, c, first, n) in enumerate((g, c, first, n) for g, first, n in runs for c in range(-(-lengths[g] // chunk)))]
    tasks = dealt(work, "task int, group int, chunk int, first int, blocks int, start long", "task")
    given = placed.join(F.broadcast(spark.createDataFrame([w[:3] for w in work], "task int, group int, chunk int")), ["group", "chunk"]).select("task", "pos", "data").repartition(2 * len(work), "task")
    sums = given.groupBy("task").cogroup(tasks.groupBy("task")).applyInArrow(lambda a, b: _summed(a, b, codes, chunk, lengths, resamples, state, strides, block), "group int, b int, s double")
    means = sums.groupBy(F.col("group").alias("_g"), "b").agg(F.sum("s").alias("s")).join(names.select("_g", "n"), "_g").withColumn("m", F.col("s") / F.col("n"))
    tail = (1 - confidence) / 2
    lo, hi = max(0, int(tail * resamples)), min(resamples - 1, int((1 - tail) * resamples))
    ends = means.groupBy("_g").agg(F.array_sort(F.collect_list("m")).alias("a")).select("_g", F.element_at("a", lo + 1).alias("lo"), F.element_at("a", hi + 1).alias("hi"))  # one number a resample
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return names.join(ends, "_g", "left").select(*by, "n", zero("lo"), zero("hi"))
