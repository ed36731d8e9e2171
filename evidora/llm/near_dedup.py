"""Near-duplicate detection by Order MinHash, verified by banded alignment.

1. Each distinct text (by SHA-256) gets `sketches` entries. For entry j the `picked` least of its occurrence-labelled word k-mers
   are found, in a random order given by j, and kept in the order in which they stand in the text: two texts share an entry
   only where they share these k-mers and their order, so the chance follows edit similarity and not the set of k-mers alone.
   A task sketches a text once however many copies it meets; copies in other tasks are merged by key.
2. Texts that share an entry form a bucket. Each member is paired with the bucket's least key (its pivot), never with all others.
   Of its pivots the one that it shares most buckets with is aligned first, over words, within the band that the threshold allows;
   then those that are not yet in its component.
3. Connected components over the verified links (large-star and small-star steps on tables; nothing is collected).
4. Buckets whose members are not all of one component go on: every member outside the bucket's largest component is compared with
   all members of other components by three exact bounds (component, length, and the set of their hashed word pairs, repeats
   counted: an edit changes at most two), in blocks of bounded size. Members of whose length no other component has any stay out before
   sets are moved; in large buckets only classes of like length meet. No row is made for a pair: the members that have some pair left
   meet again in smaller blocks, now with their words. There a pair belongs to the first bucket that it shares, the sets of words and
   of word pairs are compared more finely, and what is left is aligned. Links alone leave the task.
   So any two members of a bucket end up in one class, or were aligned, or were ruled out exactly.

Similarity is 1 - distance / max(words), 0.8 or more by default. Scattered edits of one word in five leave few long k-mers whole
(a resemblance of 0.2 for five words, of 0.47 for two), so k-mers are of two words: the README gives the measured share of pairs
that meet.

Defined results: texts without a word (null and empty ones too) are alone in their class, whatever others there are; equal texts
share a class also without any k-mer in common with others; repeated rows are copies; null ids may occur: a class's id is the
least id that is not null; a text of any length is one text, hashed in slices of 1 MiB that are cut between words; an empty table
gives no rows; extra columns are ignored, whatever their names, and keep_one returns them as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, fresh, small_text_batches, stage
from .textvec import mix, words

#: Hashed word pairs fall on 16 to 32 places a word, as powers of two within these bounds.
PLACE_BITS = (6, 16)
#: Texts of more words than this keep their places as a bitmap, others as gaps of one byte.
GAPS = 8192
#: Members of a bucket, or pairs of one pivot, in one block.
BLOCK = 1024
#: Members on each side of a block that is aligned, and the words of one side.
ALIGNED, ALIGNED_WORDS = 256, 1 << 22
#: So many times more places, as a power of two, have sets that are compared before texts are aligned.
FINER = 3
#: Distinct texts that a task remembers having sketched.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Params:
    k: int = 2
    picked: int = 2
    sketches: int = 24
    similarity: float = 0.8


def _labelled(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of each text's hashes and their occurrence in it, so that repeats differ."""
    by = np.lexsort((np.arange(len(h)), h, doc))
    new = np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])])[: len(h)]
    run = np.flatnonzero(new)
    occurrence = np.empty(len(h), dtype=np.uint64)
    occurrence[by] = (np.arange(len(h)) - np.repeat(run, np.diff(np.concatenate([run, [len(h)]])))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(h + occurrence * np.uint64(0xD6E8FEB86659FD93))


def order_min_hash(texts: list[str | None], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, entries as one row a text); rows of texts without words are zero."""
    w = words(texts)
    at = w.bounds()
    n = np.diff(at)
    out = np.zeros((len(texts), p.sketches), dtype=np.uint64)
    if not len(w.h):
        return n, out
    with np.errstate(over="ignore"):
        # k-mers: one for each place with k words ahead in its text; a shorter text is a single one
        first = np.arange(len(w.h))
        full = first + p.k <= at[w.doc + 1]
        kmer = np.zeros(len(w.h), dtype=np.uint64)
        for t in range(p.k):
            inside = first + t < at[w.doc + 1]
            kmer = kmer * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, w.h[np.minimum(first + t, len(w.h) - 1)], np.uint64(0))
        use = full | ((n[w.doc] < p.k) & (first == at[w.doc]))
        kmer, doc = mix(kmer[use]), w.doc[use]
        labelled = _labelled(kmer, doc)
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        owner = doc[starts]
        length = np.diff(np.concatenate([starts, [len(doc)]]))
        # the low bits of a rank make room for its place, so that a minimum names its place as well
        top, low = np.iinfo(np.uint64).max, np.uint64((1 << len(kmer).bit_length()) - 1)
        place = np.arange(len(kmer), dtype=np.uint64)
        for j in range(p.sketches):
            salt = (0xA24BAED4963EE407 * (2 * j + 1)) % (1 << 64)
            rank = (labelled ^ np.uint64(salt)) * np.uint64(salt | 1)
            rank = (rank & ~low) | place
            places = []
            for i in range(p.picked):
                pos = (np.minimum.reduceat(rank, starts) & low).astype(np.int64)
                gone = length <= i
                places.append(np.where(gone, -1, pos))
                rank[pos[~gone]] = top
            places = np.sort(np.stack(places), axis=0)
            entry = np.full(len(starts), np.uint64(j + 1))
            for row in places:
                entry = mix(entry * np.uint64(0x9E3779B97F4A7C15) + np.where(row < 0, np.uint64(0), labelled[np.maximum(row, 0)]))
            out[owner, j] = entry
    return n, out


def banded_distance(a: np.ndarray, b: np.ndarray, k: int, least: int = 0) -> int:
    """Edit distance of two arrays if at most k, else k + 1: Myers' bit vectors over a band of 2k + 1 diagonals.

    What the arrays share at both ends is cut off first. Row by row, the band's window over a moves on by one; bits that
    enter it below start as +1 steps, and what lies outside counts as further away than k. least: a known lower bound.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return k + 1
    m = len(a)
    if m:
        d = np.flatnonzero(a != b[:m])
        head = int(d[0]) if len(d) else m
        a, b = a[head:], b[head:]
        m = len(a)
        if m:
            d = np.flatnonzero(a[::-1] != b[::-1][:m])
            tail = int(d[0]) if len(d) else m
            a, b = a[: m - tail], b[: len(b) - tail]
    m, n = len(a), len(b)
    if not m:
        return n if n <= k else k + 1
    k_now = min(max(8, 2 * least), k)
    while True:  # a narrow band first: most copies differ in a few places
        got = _band(a.tolist(), b.tolist(), k_now) if k_now >= n - m else k_now + 1
        if got <= k_now or k_now >= k:
            return got if got <= k else k + 1
        k_now = min(k, k_now * 4)


def _band(a: list, b: list, k: int) -> int:
    """Distance of a (bits) and b (rows) if at most k, else more than k.

    Row j holds the vertical differences of cells j - k to j + k only. Cells outside are taken as one further away than their
    neighbours inside: an upper bound, exact for every path of cost at most k, since such a path stays in the band.
    """
    m = len(a)
    peq: dict = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    low, high = 0, min(m, k)
    pv, mv, score = (1 << high) - 1, 0, high  # score: of the band's uppermost cell
    for j, c in enumerate(b, 1):
        if high < m and high < j + k:
            pv |= 1 << (high - low)
            high += 1
            score += 1
        if j - k - 1 > low:
            low += 1
            pv >>= 1
            mv >>= 1
        width = high - low
        mask = (1 << width) - 1
        eq = peq.get(c, 0) >> low & mask
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & mask
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        score += (ph >> (width - 1) & 1) - (mh >> (width - 1) & 1)
        ph = (ph << 1 | 1) & mask
        mh = mh << 1 & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
    return score


def _blob(texts: list[str | None]) -> list[bytes]:
    """Word hashes of each text, four bytes a word."""
    w = words(texts)
    at = w.bounds()
    h = (w.h >> np.uint64(32)).astype("<u4")
    return [h[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def place_bits(n_words: np.ndarray) -> np.ndarray:
    """The binary logarithm of the number of places that texts of so many words use."""
    return np.clip(np.ceil(np.log2(np.maximum(n_words, 1))).astype(np.int64) + 4, *PLACE_BITS)


def pair_sets(texts: list[str | None]) -> list[bytes]:
    """The places of each text's pairs of neighbouring words, repeats apart: a byte for each gap less one (255 carries on), or a bitmap."""
    w = words(texts)
    n = np.diff(w.bounds())
    bits = place_bits(n)
    with np.errstate(over="ignore"):
        same = w.doc[1:] == w.doc[:-1]
        doc = w.doc[1:][same]
        pair = _labelled(mix(w.h[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.h[1:])[same], doc)
    place = (pair >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64)
    marked = np.unique(doc << PLACE_BITS[1] | place)
    doc, place = marked >> PLACE_BITS[1], marked & (1 << PLACE_BITS[1]) - 1
    first = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    gap = place - np.where(first, -1, np.concatenate([[0], place[:-1]])[: len(doc)]) - 1
    ends = np.cumsum(gap // 255 + 1)
    code = np.full(int(ends[-1]) if len(ends) else 0, 255, dtype=np.uint8)
    code[ends - 1] = gap % 255
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    cut = np.concatenate([[0], ends])[at].tolist()
    out = []
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if n[i] > GAPS:
            on = np.zeros(1 << PLACE_BITS[1], dtype=np.uint8)
            on[place[a:b]] = 1
            out.append(np.packbits(on, bitorder="little").tobytes())
        else:
            out.append(code[cut[i] : cut[i + 1]].tobytes())
    return out


class Sets:
    """Sets of places (of row i: place[at[i]:at[i + 1]], ascending, below 2**bits[i]), to be compared by row numbers."""

    def __init__(self, place: np.ndarray, at: np.ndarray, bits: np.ndarray, an_edit: int):
        self.place, self.at, self.bits, self.an_edit = place, at, bits, an_edit

    def _maps(self, rows: np.ndarray, bits: int) -> np.ndarray:
        """Bitmaps of 2**bits places, as 64-bit words, of rows that have at least so many."""
        size = self.at[rows + 1] - self.at[rows]
        own = np.repeat(np.arange(len(rows)), size)
        place = self.place[np.repeat(self.at[rows] - np.cumsum(size) + size, size) + np.arange(len(own))] >> (self.bits[rows] - bits)[own]
        out = np.zeros((len(rows), 1 << bits - 6), dtype=np.uint64)
        if len(own):
            word = (own << bits - 6) + (place >> 6)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out.reshape(-1)[word[start]] = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), start)
        return out

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Never more than the edit distance of rows x[i] and y[i]: an edit takes at most an_edit members and brings as many."""
        out = np.zeros(len(x), dtype=np.int64)
        level = np.minimum(self.bits[x], self.bits[y])
        for bits in np.unique(level).tolist():
            at = np.flatnonzero(level == bits)
            rows, number = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            maps = self._maps(rows, bits)
            count = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
            u, v = number[: len(at)], number[len(at) :]
            step = 1 << max(0, 20 - (bits - 6))  # 8 MB of each side
            for i in range(0, len(at), step):
                a, b = u[i : i + step], v[i : i + step]
                common = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
                out[at[i : i + step]] = (np.maximum(count[a], count[b]) - common + self.an_edit - 1) // self.an_edit
        return out


class PairSets(Sets):
    """Sets of pair_sets."""

    def __init__(self, sets: list[bytes], n_words: np.ndarray):
        gaps = n_words <= GAPS
        size = np.where(gaps, [len(x) for x in sets], 0).astype(np.int64)
        code = np.frombuffer(b"".join(x for x, g in zip(sets, gaps.tolist()) if g), np.uint8)
        step = np.cumsum(np.where(code == 255, 255, code.astype(np.int64) + 1))
        row = np.repeat(np.arange(len(sets)), size)
        before = np.concatenate([[0], step])[np.cumsum(size) - size]
        mark = code != 255
        rows, places = [row[mark]], [(step - before[row] - 1)[mark]]
        for i in np.flatnonzero(~gaps).tolist():
            on = np.flatnonzero(np.unpackbits(np.frombuffer(sets[i], np.uint8), bitorder="little"))
            rows.append(np.full(len(on), i))
            places.append(on)
        row, place = np.concatenate(rows), np.concatenate(places)
        by = np.argsort(row, kind="stable")
        super().__init__(place[by], np.searchsorted(row[by], np.arange(len(sets) + 1)), place_bits(n_words), 2)


def word_sets(blobs: list[bytes], run: int) -> Sets:
    """Sets of the words (run 1), or of the pairs of neighbouring words (run 2), of texts that are given as word hashes; repeats apart."""
    n = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
    bits = place_bits(n) + FINER
    h, doc = np.frombuffer(b"".join(blobs), "<u4").astype(np.uint64), np.repeat(np.arange(len(blobs)), n)
    with np.errstate(over="ignore"):
        if run == 2:
            same = doc[1:] == doc[:-1]
            h, doc = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same], doc[1:][same]
        place = _labelled(mix(h), doc) >> (64 - bits[doc]).astype(np.uint64)
    marked = np.unique(doc << 32 | place.astype(np.int64))
    return Sets(marked & 0xFFFFFFFF, np.searchsorted(marked >> 32, np.arange(len(blobs) + 1)), bits, run)


def _sketch(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(key, text) -> the sketch of each text that this task has not met before."""
    seen: set[bytes] = set()
    for b in batches:
        new = []
        for i, key in enumerate(b.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if len(seen) > REMEMBERED:
            seen.clear()
        if not new:
            continue
        b = b.take(pa.array(new))
        texts = b.column(1).to_pylist()
        n, entries = order_min_hash(texts, p)
        maps = pa.array(pair_sets(texts), pa.binary())
        flat = pa.array(entries.ravel().astype(np.int64))
        offsets = pa.array(np.arange(0, len(flat) + 1, p.sketches, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.ListArray.from_arrays(offsets, flat), maps], names=["key", "n_words", "v", "pairs"])


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, text) -> (key, node, word hashes)."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_blob(b.column(2).to_pylist()), pa.binary())], names=["key", "node", "w"])


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """max(words) less the words in common, with repeats: never more than the edit distance."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(n[i], m[j]).sum())


def _similar(s: np.ndarray, t: np.ndarray, p: Params) -> bool:
    most = int((1 - p.similarity) * max(len(s), len(t)) + 1e-9)
    return abs(len(s) - len(t)) <= most and (least := bag_distance(s, t)) <= most and banded_distance(s, t, most, least) <= most


def _align(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """(node a, node b, words a, words b) -> the pairs (a, b) that are similar."""
    for b in batches:
        good = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            good.append(_similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), p))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _only(keys: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of the tables that some key needs, as tables of their own: few, once most links are known.

    Keys go by a hash of half their size, so that twice as many are broadcast before the words are shuffled for them; a row too many does no harm.
    """
    keys = stage(keys.select(F.xxhash64("key").alias("_h")).distinct(), "keys")
    return [stage(t.join(keys, F.xxhash64("key") == F.col("_h"), "left_semi"), "few") for t in tables]


def _verify(pairs: DataFrame, blobs: DataFrame, p: Params) -> DataFrame:
    """Links (a, b as nodes) of pairs (a, b, salt as keys). A pivot's text is sent once for each of its salts, so no key is hot."""
    sent = pairs.select("a", "salt").distinct().join(blobs.select(F.col("key").alias("a"), F.col("node").alias("na"), F.col("w").alias("wa")), "a")
    both = pairs.join(sent, ["a", "salt"]).join(blobs.select(F.col("key").alias("b"), F.col("node").alias("nb"), F.col("w").alias("wb")), "b")
    node = dict(blobs.dtypes)["node"]
    return both.select("na", "nb", "wa", "wb").mapInArrow(lambda x: _align(x, p), f"a {node}, b {node}")


def _checksum(pairs: DataFrame) -> tuple:
    """The number of distinct rows and two sums of their hashes: two tables of one checksum are taken as equal."""
    row = pairs.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)")) for seed in (1, 2)]).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the connected component of each node in edges (a, b), of any type that has an order.

    Large-star and small-star steps (Kiveris et al., 2014): each is a group-by with a minimum and a join, both of which can split
    a hot node; the number of rounds is logarithmic, and they go on until nothing changes. Superseded tables are deleted.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    after = _checksum(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = stage(small, "star")
        before, after = after, _checksum(small)
        drop_stage(now)
        drop_stage(large)
        now = small
        if before == after:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _most(a: str, b: str, p: Params):
    """The edits that two texts of so many words may differ by."""
    return F.floor(F.lit(1 - p.similarity) * F.greatest(a, b) + F.lit(1e-9)).cast("int")


def _group_pairs(group: np.ndarray, left: np.ndarray, right: np.ndarray, most: int):
    """Index pairs (left row, right row) of rows in order of group, about most at a time."""
    edge = np.flatnonzero(np.diff(group)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(group)]])
    lefts = np.flatnonzero(left)
    own = np.searchsorted(start, lefts, side="right") - 1  # the group of each left row
    size = end[own] - start[own]
    until = np.cumsum(size)
    at = 0
    while at < len(lefts):
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + most, side="right")))
        n = size[at:to]
        x = np.repeat(lefts[at:to], n)
        y = np.repeat(start[own[at:to]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keep = right[y]
        yield x[keep], y[keep]
        at = to


def _ranks(keys: list[bytes]) -> np.ndarray:
    """Numbers of keys of 16 bytes, in their order; equal keys have one number."""
    halves = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2).astype(np.uint64)
    by = np.lexsort((halves[:, 1], halves[:, 0]))
    out = np.empty(len(by), dtype=np.int64)
    out[by] = np.cumsum(np.concatenate([[False], (halves[by][1:] != halves[by][:-1]).any(axis=1)])[: len(by)])
    return out


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in order of group as tables of whole groups, of about so many rows or 32 MB."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows >= most or size >= 1 << 25:
            t = pa.Table.from_batches(held)
            group = t.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1], side="left"))  # the last group may go on
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                rows, size = t.num_rows - cut, sum(x.nbytes for x in held)
    if rows:
        yield pa.Table.from_batches(held)


def _candidates(t: pa.Table, left: np.ndarray, right: np.ndarray, sets: list[Sets], p: Params):
    """Index pairs of a left and a right row of one group that no bound rules out.

    Where the rows have their entries (v), a pair is kept in the first of the buckets that its texts share.
    """
    col = lambda c: t.column(c).combine_chunks()
    n, rank = col("n_words").to_numpy().astype(np.int64), _ranks(col("key").to_pylist())
    root = col("root").dictionary_encode().indices.to_numpy()  # as small numbers
    major = np.asarray(col("major").to_numpy(zero_copy_only=False), bool)
    entries, bucket = (col("v").flatten().to_numpy().reshape(len(n), -1) if "v" in t.column_names else None), col("bucket").to_numpy()
    for x, y in _group_pairs(col("group").to_numpy(), left, right, 1 << 18):
        most = np.floor((1 - p.similarity) * np.maximum(n[x], n[y]) + 1e-9).astype(np.int64)
        # two members outside the largest component meet twice: once is enough
        ok = (root[x] != root[y]) & (np.abs(n[x] - n[y]) <= most) & (major[y] | (rank[x] < rank[y]))
        x, y, most = x[ok], y[ok], most[ok]
        if entries is not None:
            first = (entries[x] == entries[y]).argmax(axis=1)
            ok = entries[x, first] == bucket[x]
            x, y, most = x[ok], y[ok], most[ok]
        for s in sets:
            near = s.distance(x, y) <= most
            x, y, most = x[near], y[near], most[near]
        yield x, y


def _meet(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (group, left, right, bucket, major, key, root, n_words, pairs) in order of group -> those of them that have a pair which no bound rules out, once for each side."""
    for t in _groups(batches, 8 * BLOCK):
        left, right = (np.asarray(t.column(c).combine_chunks().to_numpy(zero_copy_only=False), bool) for c in ("left", "right"))
        met = np.zeros((2, t.num_rows), dtype=bool)
        for x, y in _candidates(t, left, right, [PairSets(t.column("pairs").to_pylist(), t.column("n_words").to_numpy().astype(np.int64))], p):
            met[0, x] = met[1, y] = True
        for side in (True, False):
            out = t.filter(pa.array(met[0 if side else 1])).select(["group", "bucket", "major", "key", "root", "n_words"])
            yield from out.append_column("left", pa.array([side] * out.num_rows, pa.bool_())).to_batches()


def _link(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (group, left, bucket, major, key, root, n_words, v, node, w) in order of group -> the pairs (a, b) of nodes that are similar."""
    for t in _groups(batches, 8 * ALIGNED):
        blobs, node = t.column("w").to_pylist(), t.column("node").combine_chunks()
        left = np.asarray(t.column("left").combine_chunks().to_numpy(zero_copy_only=False), bool)
        for x, y in _candidates(t, left, ~left, [word_sets(blobs, 1), word_sets(blobs, 2)], p):
            good = np.array([_similar(np.frombuffer(blobs[i], "<u4"), np.frombuffer(blobs[j], "<u4"), p) for i, j in zip(x.tolist(), y.tolist())], dtype=bool)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(x[good])), node.take(pa.array(y[good]))], names=["a", "b"])


def _across(shared: DataFrame, texts: DataFrame, blobs: DataFrame, roots: DataFrame, p: Params) -> DataFrame:
    """Links (a, b as nodes): all pairs of similar members of one bucket which are in different components.

    Members of the bucket's largest component are compared with the others only. Texts of lengths that the threshold allows are in
    the same class of length or the next, so members stay out where none outside the largest component, or nobody else, has
    such a length. A bucket of at most BLOCK members is one group. In a larger one each class has its right rows, all members of the
    class, and its left rows, the members outside the largest component of this class and the two next to it; both are dealt to
    as many blocks as the class needs. Members of a block that have a pair left are dealt to blocks of at most about ALIGNED rows a side.
    """
    known = roots.select(F.col("node.key").alias("key"), F.col("root.key").alias("root"))
    split = stage(shared.join(known, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"), "n_words"), "split")
    of_root = split.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = of_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("roots"))
    mixed = mixed.where("roots > 1").select("bucket", F.col("top.root").alias("top"), (F.col("size") <= BLOCK).alias("small"))
    width = -math.log(p.similarity) * 1.01 if p.similarity < 1 else 1e-6  # a little over, for rounding
    rows = split.join(mixed, "bucket").select("bucket", F.floor(F.log("n_words") / F.lit(width)).cast("int").alias("cls"), "small", (F.col("root") == F.col("top")).alias("major"), "key", "root", "n_words")
    rows = stage(rows, "mixed")
    drop_stage(split)
    sizes = rows.groupBy("bucket", "cls").agg(F.count(F.lit(1)).alias("r"), F.count_if(~F.col("major")).alias("l"))
    sizes = sizes.select("bucket", "r", "l", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"), F.col("cls").alias("c"))
    sizes = sizes.groupBy("bucket", (F.col("c") + F.col("d")).alias("cls")).agg(F.sum("l").alias("l"), F.sum("r").alias("around"), F.sum(F.when(F.col("d") == 0, F.col("r")).otherwise(0)).alias("r"))
    sizes = sizes.where("l > 0 and r > 0 and around > 1").select("bucket", "cls", F.ceil(F.col("r") / BLOCK).cast("int").alias("nr"), F.ceil(F.col("l") / BLOCK).cast("int").alias("nl"))
    sizes = stage(sizes, "sizes")
    no, yes = F.lit(False), F.lit(True)
    dealt = lambda seed, c: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(c)).cast("int")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = ["bucket", "cls", "lb", "rb", "left", "right", "major", "key", "root", "n_words"]
    members = rows.join(sizes, ["bucket", "cls"])
    small = members.where("small").withColumns({"cls": F.lit(0), "lb": F.lit(0), "rb": F.lit(0), "left": ~F.col("major"), "right": yes}).select(*own)
    right = members.where("not small").withColumns({"left": no, "right": yes, "rb": dealt(1, "nr")}).withColumn("lb", up_to("nl")).select(*own)
    left = rows.where("not small and not major").withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    left = left.join(sizes, ["bucket", "cls"]).withColumns({"left": yes, "right": no, "lb": dealt(2, "nl")}).withColumn("rb", up_to("nr")).select(*own)
    parts = max(1, int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    all_ = small.unionByName(right).unionByName(left).select(F.xxhash64("bucket", "cls", "lb", "rb").alias("group"), "left", "right", "bucket", "major", "key", "root", "n_words")
    all_ = all_.join(texts.select("key", "pairs"), "key").select("group", "left", "right", "bucket", "major", "key", "root", "n_words", "pairs")
    met = all_.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(lambda x: _meet(x, p), "group long, bucket long, major boolean, key binary, root binary, n_words int, left boolean")
    met = stage(met, "met")
    drop_stage(rows)
    drop_stage(sizes)
    side = lambda c: F.greatest(F.ceil(F.count_if(c) / ALIGNED), F.ceil(F.sum(F.when(c, F.col("n_words"))) / ALIGNED_WORDS)).cast("int")
    blocks = met.groupBy("group").agg(side(F.col("left")).alias("nl"), side(~F.col("left")).alias("nr"))
    cut = met.join(blocks, "group").withColumn("own", F.when(F.col("left"), dealt(3, "nl")).otherwise(dealt(4, "nr"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("nr")).otherwise(F.col("nl")) - 1)))
    words_of, entries = _only(met.select("key"), blobs, texts.select("key", "v"))
    own = F.xxhash64("group", F.when(F.col("left"), F.col("own")).otherwise(F.col("other")), F.when(F.col("left"), F.col("other")).otherwise(F.col("own")))
    cut = cut.select(own.alias("group"), "left", "bucket", "major", "key", "root", "n_words").join(words_of, "key").join(entries, "key")
    node = dict(blobs.dtypes)["node"]
    cut = cut.select("group", "left", "bucket", "major", "key", "root", "n_words", "v", "node", "w").repartition(parts, "group").sortWithinPartitions("group", "left", "key")
    found = stage(cut.mapInArrow(lambda x: _link(x, p), f"a {node}, b {node}"), "found")
    drop_stage(met)
    return found


def _key(text: str):
    """The first half of the SHA-256 of a text; null is the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def near_classes(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, links). texts: key, class_key, class_id, rep_id, n_copies, n_words, n_links: one row for each distinct text.

    links: a, b: the verified pairs of different texts, as structs (no_id, id, key). The class's least node, which names it, is
    the least of them, so a class's id travels with its root and classes are never gathered.
    """
    p = params
    spark = docs.sparkSession
    small_text_batches(spark)
    raw = docs.select(F.col(doc_id).alias("_id"), _key(text).alias("key"), F.col(text).alias("_text"))
    sketches = raw.select("key", "_text").mapInArrow(lambda x: _sketch(x, p), "key binary, n_words int, v array<long>, pairs binary")
    sketches = sketches.groupBy("key").agg(F.max("n_words").alias("n_words"), F.max("v").alias("v"), F.max("pairs").alias("pairs"))
    copies = raw.groupBy("key").agg(F.min("_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"))
    texts = stage(copies.join(sketches, "key"), "sketches")
    # an entry's number is part of its hash, so a bucket is a hash alone
    members = texts.where("n_words > 0").select("key", "n_words", F.explode("v").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stage(members.join(sizes, "bucket"), "shared")
    pivots = shared.groupBy("bucket").agg(F.min(F.struct("key", "n_words")).alias("pivot"))
    pairs = shared.join(pivots, "bucket").where(F.col("key") != F.col("pivot.key")).select(F.col("pivot.key").alias("a"), F.col("key").alias("b"), F.col("pivot.n_words").alias("_m"), "n_words", "size")
    pairs = pairs.where(F.abs(F.col("_m") - F.col("n_words")) <= _most("_m", "n_words", p))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.pmod(F.xxhash64("b"), F.ceil(F.max("size") / BLOCK)).cast("int").alias("salt"))
    pairs = stage(pairs, "pairs")
    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a", "salt")).alias("top")).select("top.a", "b", "top.salt")
    needed = shared.select("key").distinct().join(texts.select("key", "rep_id"), "key")
    source = raw.where("_text is not null").alias("r").join(needed.alias("n"), (F.col("r.key") == F.col("n.key")) & F.col("r._id").eqNullSafe(F.col("n.rep_id")))
    node = F.struct(F.col("r._id").isNull().alias("no_id"), F.col("r._id").alias("id"), F.col("r.key").alias("key"))
    source = source.select("r.key", node.alias("node"), "_text")
    blobs = source.mapInArrow(_words_of, f"key binary, node {dict(source.dtypes)['node']}, w binary")
    blobs = stage(blobs, "words")
    if not blobs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # repeated rows of one id and one text
        blobs = stage(blobs.dropDuplicates(["key"]), "words")
    links = stage(_verify(best, blobs, p), "links")
    roots = stage(components(links), "roots")
    known = roots.select(F.col("node.key").alias("key"), F.col("root.key").alias("root"))
    rest = pairs.join(best, ["a", "b"], "left_anti").select("a", "b", "salt")
    of_a = rest.select("a", "salt").distinct().join(known.toDF("a", "ra"), "a")
    rest = rest.join(of_a, ["a", "salt"], "left").join(known.toDF("b", "rb"), "b", "left").where(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))).select("a", "b", "salt")
    rest = stage(rest, "rest")
    more = stage(_verify(rest, *_only(rest.select(F.col("a").alias("key")).union(rest.select("b")), blobs), p), "links")
    drop_stage(pairs)
    if not more.isEmpty():
        links = links.union(more)
        drop_stage(roots)
        roots = stage(components(links), "roots")
    found = _across(shared, texts, blobs, roots, p)
    drop_stage(shared)
    if not found.isEmpty():
        links = links.union(found)
        drop_stage(roots)
        roots = stage(components(links), "roots")
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a.key").alias("key")).agg(F.count(F.lit(1)).alias("n_links"))
    known = roots.select(F.col("node.key").alias("key"), F.col("root.key").alias("_root"), F.col("root.id").alias("_root_id"))
    joined = texts.drop("v", "pairs").join(known, "key", "left").join(degree, "key", "left")
    out = joined.select(
        "key", F.coalesce("_root", "key").alias("class_key"), F.when(F.col("_root").isNull(), F.col("rep_id")).otherwise(F.col("_root_id")).alias("class_id"),
        "rep_id", "n_copies", "n_words", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return out, links


def near_duplicates(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), n_links (verified links to different texts): one row a document."""
    classes, _ = near_classes(docs, params, doc_id, text)
    mine = docs.select(F.col(doc_id).alias("_id"), _key(text).alias("key"))
    out = mine.join(classes.where("n_words > 0").select("key", "class_id", "n_links"), "key", "left")
    return out.select(F.col("_id").alias(doc_id), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, params: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one of the least id; texts without words all stay. Columns as in docs."""
    classes, _ = near_classes(docs, params, doc_id, text)
    key, rep = fresh(docs, "key"), fresh(docs, "rep")
    best = stage(classes.where("n_words > 0 and key = class_key").select(F.col("key").alias(key), F.col("rep_id").alias(rep)), "kept")
    marked = docs.withColumn(key, _key(text))
    of_best = [F.col(f"d.{key}") == F.col(f"b.{key}"), F.col(f"d.{doc_id}").eqNullSafe(F.col(f"b.{rep}"))]
    repeated = not marked.select(doc_id, key).groupBy(key, doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    wordless = classes.where("n_words = 0").select(F.col("key").alias(key))
    kept = marked.alias("d").join(best.alias("b"), of_best[0] & of_best[1], "left_semi")
    if repeated:  # rows of one id and one text: any one of them
        kept = kept.dropDuplicates([key])
    return kept.unionByName(marked.join(wordless, key, "left_semi")).select(*docs.columns)
