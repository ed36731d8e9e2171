"""Exact substring deduplication: a hash-compared suffix sort over winnowed anchors.

Every byte that lies in a string of `length` bytes which also starts anywhere else in the corpus is removed.

1. Winnowing: of the `gram`-byte hashes in each `length`-byte window the least (the leftmost on ties) is its anchor. Equal
   windows have equal anchors at equal offsets, so windows need comparing only where anchors are equal, about one in 170
   positions. The windows of one anchor are consecutive; their union is its context.
2. Anchors that occur once are dropped. Contexts that occur twice or more, counted by a cryptographic digest (BLAKE2b, 128 bits) on
   the map side, are covered whole: equal digests are equal bytes, as for whole texts.
3. The distinct contexts of an anchor are suffix sorted in both directions from it, by mergesort. Two suffixes are compared by
   prefix polynomial hashes: binary search finds how far they agree, so a comparison takes logarithmic time. The common
   extensions of neighbours are verified byte by byte; on a collision the suffixes are sorted by their bytes instead. A window
   with d bytes left of the anchor is repeated if another context agrees on d bytes to the left and length - d to the right.
4. An anchor with more than `hot` distinct contexts is not gathered in a task: its windows are counted one by one, by the same
   digest, with map-side sums; the result is that of the suffix sort.

Whole copies of a document never enter steps 2 to 4 more than once: texts are counted by their SHA-256 first.

Joins on an anchor or a context are inner or semi joins whose larger side Spark's adaptive execution splits where one key is hot.

Defined results: a null text is the empty one; texts shorter than `length` bytes are kept; a text of any length is one text, scanned
in overlapping slices of 1 MiB; repeated rows (also of one doc_id) are copies of each other; a tie of hashes in a window goes to the
leftmost; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_text_batches, stage
from .textvec import SLICE, mix, powers, prefix_sums

POS_BITS, SIDE_BITS = 43, 10


@dataclass(frozen=True)
class Params:
    """length: bytes of a repeated string. gram: bytes of an anchor. hot: contexts of one anchor in a task. chunk: contexts sorted at once."""

    length: int = 400
    gram: int = 64
    hot: int = 20_000
    chunk: int = 16_384


def _pack(pos, left, right):
    return (pos << (2 * SIDE_BITS)) | (left << SIDE_BITS) | right


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = (1 << SIDE_BITS) - 1
    return packed >> (2 * SIDE_BITS), (packed >> SIDE_BITS) & m, packed & m


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least key in each window of width (van Herk: prefix and suffix minima of blocks)."""
    n = len(key) - width + 1
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, ends: np.ndarray, p: Params):
    """Anchors of texts joined in buf (at most SLICE bytes): (hash, position, first window, last window, text) arrays.

    ends: where each text ends in buf. A window lies within one text.
    """
    none = (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 4)
    if len(buf) < p.length:
        return none
    with np.errstate(over="ignore"):
        sums = prefix_sums(buf)
        n = len(buf) - p.gram + 1
        _, down = powers()
        h = mix((sums[p.gram :] - sums[:n]) * down[:n])
        low = np.uint64(SLICE * 2 - 1)
        key = (h & ~low) | np.arange(n, dtype=np.uint64)
        at = (_least(key, p.length - p.gram + 1) & low).astype(np.int64)
    window = np.arange(len(at))
    text = np.searchsorted(ends, window, side="right")
    good = window + p.length <= ends[text]
    window, at, text = window[good], at[good], text[good]
    if not len(window):
        return none
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return h[at[first]], at[first], window[first], window[last], text[first]


def _scan(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(key, text as bytes) -> (h, u, key, packed); u: digest of the context."""

    def emit(keys, rows):
        h, u, src, packed = (np.concatenate([r[i] for r in rows]) for i in range(4))
        return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(u, pa.binary()), keys.take(pa.array(src)), pa.array(packed)], names=["h", "u", "key", "packed"])

    def work(raw: bytes, ends: np.ndarray, src: np.ndarray, base: np.ndarray):
        h, at, first, last, text = anchors(np.frombuffer(raw, np.uint8), ends, p)
        view = memoryview(raw)
        u = np.empty(len(first), dtype=object)
        u[:] = [hashlib.blake2b(view[a : b + p.length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist())]
        starts = np.concatenate([[0], ends[:-1]])
        return h, u, src[text], _pack(at - starts[text] + base[text], at - first, at - last)

    for b in batches:
        keys, texts = b.column(0), b.column(1).to_pylist()
        rows, held, src, size = [], [], [], 0

        def flush():
            nonlocal held, src, size
            if held:
                rows.append(work(b"".join(held), np.cumsum([len(x) for x in held]), np.array(src), np.zeros(len(held), dtype=np.int64)))
            held, src, size = [], [], 0

        for i, t in enumerate(texts):
            if t is None or len(t) < p.length:
                continue
            if len(t) > SLICE:
                step = SLICE - p.length + 1
                for at in range(0, len(t) - p.length + 1, step):
                    part = bytes(t[at : at + SLICE])
                    rows.append(work(part, np.array([len(part)]), np.array([i]), np.array([at])))
                continue
            if size + len(t) > SLICE:
                flush()
            held.append(t)
            src.append(i)
            size += len(t)
        flush()
        if rows:
            yield emit(keys, rows)


# ---- suffix sort ---------------------------------------------------------------------------------------------------------


class Suffixes:
    """Byte strings of at most width as a padded matrix with prefix polynomial hashes."""

    def __init__(self, parts: list[bytes], width: int):
        self.n = np.array([len(x) for x in parts], dtype=np.int64)
        self.bytes = np.zeros((len(parts), width + 1), dtype=np.uint8)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        inside = np.arange(width + 1)[None, :] < self.n[:, None]
        self.bytes[inside] = flat
        up, _ = powers()
        self.sums = np.zeros((len(parts), width + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.bytes[:, :width].astype(np.uint64) + np.uint64(1)) * up[:width], axis=1, out=self.sums[:, 1:])
        self.width = width

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b agree on, by binary search over prefix hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.n[a], self.n[b])
        for _ in range(int(self.width).bit_length()):
            mid = (low + high + 1) // 2
            same = self.sums[a, mid] == self.sums[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a sorts before b (a shorter string before its extensions; equal: false)."""
        k = self.common(a, b)
        end_a, end_b = k >= self.n[a], k >= self.n[b]
        return np.where(end_a | end_b, end_a & ~end_b, self.bytes[a, k] < self.bytes[b, k])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order within each group (numbers that ascend); bottom-up mergesort of all groups at once."""
        order = np.arange(len(group))
        start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else np.array([0])
        size = np.diff(start)
        begin, count = np.repeat(start[:-1], size), np.repeat(size, size)
        local = np.arange(len(group)) - begin
        width = 1
        while width < (size.max() if len(size) else 0):
            run = local // width
            mate = begin + (run ^ 1) * width
            mate_end = np.minimum(mate + width, begin + count)
            live = np.flatnonzero(mate < begin + count)
            me, odd = order[live], (run[live] & 1).astype(bool)
            low, high = mate[live].copy(), mate_end[live].copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                other = order[mid]
                # how many of the mate run come before me: a left run's equals come first
                before = np.where(odd[open_], ~self.less(me[open_], other), self.less(other, me[open_]))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            rank = low - mate[live]
            to = begin[live] + (run[live] & ~1) * width + local[live] % width + rank
            merged = order.copy()
            merged[to] = me
            order = merged
            width *= 2
        return order

    def neighbours(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, bytes in common with the one before; -1 at the start of a group), verified on the bytes themselves."""
        order = self.sort(group)
        own = np.full(len(group), -1, dtype=np.int64)
        if len(group) > 1:
            a, b = order[:-1], order[1:]
            claimed, true = self.common(a, b), self._agree(a, b)
            if (claimed != true).any() or not self._ascending(order, group, true):
                raw = [bytes(r[:n]) for r, n in zip(self.bytes, self.n)]
                order = np.array(sorted(range(len(group)), key=lambda i: (group[i], raw[i])))
                true = self._agree(order[:-1], order[1:])
            same = group[order[1:]] == group[order[:-1]]
            own[1:] = np.where(same, true, -1)
        return order, own

    def _agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differs = self.bytes[a] != self.bytes[b]
        differs[:, -1] = True
        return np.minimum(np.argmax(differs, axis=1), np.minimum(self.n[a], self.n[b]))

    def _ascending(self, order: np.ndarray, group: np.ndarray, k: np.ndarray) -> bool:
        a, b = order[:-1], order[1:]
        end_a, end_b = k >= self.n[a], k >= self.n[b]
        good = np.where(end_a | end_b, end_a | ~end_b, self.bytes[a, k] < self.bytes[b, k])
        return bool((good | (group[a] != group[b])).all())


def repeated_windows(group: np.ndarray, contexts: list[bytes], left: np.ndarray, right: np.ndarray, p: Params) -> np.ndarray:
    """covered[i, d]: the window of context i with d bytes left of the anchor equals one of another context of its group.

    group ascends; left and right: the largest and smallest d of each context.
    """
    span = p.length - p.gram + 1
    ahead = Suffixes([c[le:] for c, le in zip(contexts, left.tolist())], p.length)
    back = Suffixes([c[:le][::-1] for c, le in zip(contexts, left.tolist())], span)
    ord_r, lcp_r = ahead.neighbours(group)
    ord_l, lcp_l = back.neighbours(group)
    covered = np.zeros((len(contexts), span), dtype=bool)
    cls_r, cls_l = np.empty(len(contexts), dtype=np.int64), np.empty(len(contexts), dtype=np.int64)
    for d in range(span):
        here = np.flatnonzero((right <= d) & (d <= left))
        if len(here) < 2:
            continue
        cls_r[ord_r] = np.cumsum(lcp_r < p.length - d)
        cls_l[ord_l] = np.cumsum(lcp_l < d)
        _, inverse, count = np.unique(cls_r[here] * (len(contexts) + 1) + cls_l[here], return_inverse=True, return_counts=True)
        covered[here, d] = count[inverse] > 1
    return covered


def _intervals(covered: np.ndarray, pos: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, end) of the bytes that runs of covered windows take."""
    edge = np.zeros((covered.shape[0], covered.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = covered
    step = np.diff(edge, axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    return row, pos[row] - (high - 1), pos[row] - low + p.length


def _sort_groups(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (h, n, key, packed, context) that come sorted by h -> (key, start, end)."""

    def work(h, n, keys, packed, contexts):
        pos, left, right = _unpack(packed)
        group = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
        covered = repeated_windows(group, contexts, left, right, p)
        covered[n > 1] = False  # covered whole already
        row, start, end = _intervals(covered, pos, p)
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in row], pa.binary()), pa.array(start), pa.array(end)], names=["key", "start", "end"])

    held: list[pa.RecordBatch] = []
    rows = 0

    def merged():
        t = pa.Table.from_batches(held)
        return t.column("h").to_numpy(), t.column("n").to_numpy(), t.column("key").to_pylist(), t.column("packed").to_numpy(), t.column("context").to_pylist()

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= p.chunk:
            h, n, keys, packed, contexts = merged()
            cut = int(np.searchsorted(h, h[-1], side="left"))  # the last group may go on
            if cut:
                yield work(h[:cut], n[:cut], keys[:cut], packed[:cut], contexts[:cut])
                rest = pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()
                held, rows = rest, sum(x.num_rows for x in rest)
    if rows:
        yield work(*merged())


def _cut_contexts(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(key, text, at: [(h, n, packed, hot)]) -> (h, n, key, packed, hot, context)."""
    for b in batches:
        texts, offsets, flat = b.column(1), b.column(2).offsets.to_numpy(), b.column(2).flatten()
        h, n, packed, hot = (flat.field(i) for i in range(4))
        src = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        pos, left, right = _unpack(packed.to_numpy())
        raw = [t.as_buffer() if t.is_valid else b"" for t in texts]
        contexts = [bytes(memoryview(raw[i])[s:e]) for i, s, e in zip(src.tolist(), (pos - left).tolist(), (pos - right + p.length).tolist())]
        yield pa.RecordBatch.from_arrays([h, n, b.column(0).take(pa.array(src)), packed, hot, pa.array(contexts, pa.binary())], names=["h", "n", "key", "packed", "hot", "context"])


def _each_window(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (h, n, key, packed, context) -> (w, start, n, key): every window of a context by its digest and place."""
    for b in batches:
        pos, left, right = _unpack(b.column("packed").to_numpy())
        w, start, src = [], [], []
        for i, c in enumerate(b.column("context").to_pylist()):
            view = memoryview(c)
            for d in range(int(right[i]), int(left[i]) + 1):
                o = int(left[i]) - d
                w.append(hashlib.blake2b(view[o : o + p.length], digest_size=16, salt=d.to_bytes(4, "little")).digest())
                start.append(int(pos[i]) - d)
                src.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(start, pa.int64()), b.column("n").take(pa.array(src, pa.int64())), b.column("key").take(pa.array(src, pa.int64()))], names=["w", "start", "n", "key"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans) -> (key, n_removed, n_spans, kept_sha256, removed: the merged spans)."""
    for b in batches:
        n_removed, n_spans, digest, merged_all = [], [], [], []
        for text, spans in zip(b.column(1), b.column(2)):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans.as_py()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            sha, at = hashlib.sha256(), 0
            for s, e in merged:
                sha.update(raw[at:s])
                at = e
            sha.update(raw[at:])
            n_removed.append(sum(e - s for s, e in merged))
            n_spans.append(len(merged))
            digest.append(sha.hexdigest())
            merged_all.append([{"start": s, "end": e} for s, e in merged])
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(merged_all, spans_type)], names=["key", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the spans): one row for each document."""
    p = params
    if p.gram >= p.length or p.length - p.gram >= 1 << SIDE_BITS:
        raise ValueError("gram must be shorter than length, by less than 1024")
    spark = docs.sparkSession
    small_text_batches(spark)
    run = lambda f: lambda batches: f(batches, p)
    raw = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    raw = raw.withColumn("_sha", F.sha2("_text", 256)).withColumn("key", F.unhex(F.substring("_sha", 1, 32)))
    light = raw.select("_id", "key", "_sha", F.octet_length("_text").cast("long").alias("n_bytes"))
    copies = light.groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("_id").alias("_rep"))

    found = stage(raw.where(F.octet_length("_text") >= p.length).select("key", F.col("_text").cast("binary").alias("t")).mapInArrow(run(_scan), "h long, u binary, key binary, packed long"), "anchors")
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    found = stage(found.join(again, "h", "left_semi").distinct(), "repeated")
    contexts = found.groupBy("h", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "packed")).alias("one"))
    contexts = stage(contexts, "contexts")
    whole = found.join(contexts.where("n > 1").select("h", "u"), ["h", "u"], "left_semi")
    side = (1 << SIDE_BITS) - 1
    pos, right = F.shiftright("packed", 2 * SIDE_BITS), F.col("packed").bitwiseAND(side)
    left = F.shiftright("packed", SIDE_BITS).bitwiseAND(side)
    whole = whole.select("key", (pos - left).alias("start"), (pos - right + p.length).alias("end"))

    several = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    edges = contexts.join(several, "h").select(F.col("one.key").alias("key"), F.struct("h", "n", F.col("one.packed").alias("packed"), (F.col("m") > p.hot).alias("hot")).alias("at"))
    edges = edges.groupBy("key").agg(F.collect_list("at").alias("at")).join(copies.select("key", "_rep"), "key")  # at most one for 64 bytes of a text
    # one row of each text: where copies share an id too, their contexts are made distinct below
    texts = raw.select("key", "_id", F.col("_text").cast("binary").alias("t"))
    one = texts.join(edges, (texts["key"] == edges["key"]) & texts["_id"].eqNullSafe(edges["_rep"])).select(texts["key"], "t", "at")
    cut = one.mapInArrow(run(_cut_contexts), "h long, n long, key binary, packed long, hot boolean, context binary")
    cut = stage(cut, "cut").dropDuplicates(["h", "key", "packed"])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = cut.where(~F.col("hot")).drop("hot").repartition(parts, "h").sortWithinPartitions("h")
    near = sorted_.mapInArrow(run(_sort_groups), "key binary, start long, end long")
    each = cut.where("hot").drop("hot").mapInArrow(run(_each_window), "w binary, start long, n long, key binary")
    twice = each.groupBy("w").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    hot = each.where("n = 1").join(twice, "w", "left_semi").select("key", "start", (F.col("start") + p.length).alias("end"))

    spans = whole.unionByName(near).unionByName(hot).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # a text with copies goes whole; only others need their bytes again
    spans = spans.join(copies.where("n_copies = 1").select("key", "_rep"), "key")
    again = texts.join(spans, (texts["key"] == spans["key"]) & texts["_id"].eqNullSafe(spans["_rep"])).select(texts["key"], "t", "spans")
    done = again.mapInArrow(_remove, "key binary, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    verdict = copies.select("key", "n_copies").join(done, "key", "left")
    out = light.join(verdict, "key", "left")
    gone = (F.col("n_copies") > 1) & (F.col("n_bytes") >= p.length)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("_id").alias(doc_id), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("removed", F.array().cast("array<struct<start:long,end:long>>"))).alias("removed"),
    )
