"""Vectorised word and byte hashing over UTF-8 buffers (numpy only).

A word is a maximal run of ASCII letters or digits and bytes of 0x80 and above, after lower-casing. Hashes are
polynomial over the ring of 64-bit integers, taken from prefix sums, so every word of a buffer is hashed at once;
an avalanche step follows. Buffers are worked in slices of at most 1 MiB to bound memory.
"""

from __future__ import annotations

import re

import numpy as np

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}
#: Letters whose lower case takes more or fewer bytes.
_UNEVEN = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x1F000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.lower().encode()) != len(c.encode())) + "]")


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for a slice."""
    if not _tables:
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                x = np.full(SLICE + 1, base, dtype=np.uint64)
                x[0] = 1
                _tables[name] = np.multiply.accumulate(x)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche step (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """P[i] = sum of (buf[j] + 1) * BASE**j over j < i, modulo 2**64."""
    up, _ = powers()
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers()
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123)]] = True
_WORD[128:] = True


class Words:
    """Words of several texts: doc (index of the text), h (64-bit hash), and what was asked for besides."""

    def __init__(self, n_docs: int, doc: np.ndarray, h: np.ndarray, prefixes: list[np.ndarray], sentence: np.ndarray, n_sentences: int, spans: tuple[np.ndarray, np.ndarray]):
        self.n_docs, self.doc, self.h, self.prefixes, self.sentence, self.n_sentences, self.spans = n_docs, doc, h, prefixes, sentence, n_sentences, spans

    def bounds(self) -> np.ndarray:
        """bounds[i]:bounds[i+1] are the words of text i."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


def slices(raw: list[bytes]):
    """(first text, texts, bytes) for texts joined by NUL up to SLICE; a longer text comes in parts cut between words."""
    i = 0
    while i < len(raw):
        if len(raw[i]) > SLICE:
            at, b = 0, raw[i]
            while at < len(b):
                end = min(len(b), at + SLICE)
                if end < len(b):
                    tail = ~_WORD[np.frombuffer(b, np.uint8, min(4096, end - at), end - min(4096, end - at))]
                    cut = np.flatnonzero(tail)
                    if len(cut):
                        end -= len(tail) - 1 - int(cut[-1])
                yield i, 1, b[at:end]
                at = end
            i += 1
            continue
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) + 1 <= SLICE) and len(raw[j]) <= SLICE:
            size += len(raw[j]) + 1
            j += 1
        yield i, j - i, b"\0".join(raw[i:j])
        i = j


def lower(text: str) -> bytes:
    """UTF-8 of the text in lower case, byte for byte where it was: letters whose lower case has another length stay."""
    out, own = text.lower().encode("utf-8", "replace"), text.encode("utf-8", "replace")
    if len(out) != len(own) or _UNEVEN.search(text):
        out = "".join(x if len(x.encode("utf-8", "replace")) == len(c.encode("utf-8", "replace")) else c for c in text for x in (c.lower(),)).encode("utf-8", "replace")
    return out.replace(b"\0", b" ")


def words(texts: list[str | None], prefix_lengths: tuple[int, ...] = ()) -> Words:
    raw = [lower(t or "") for t in texts]
    doc, hashes, prefixes, sentence, starts_, ends_ = [], [], [[] for _ in prefix_lengths], [], [], []
    n_sent = 0
    offsets = np.zeros(len(raw) + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        for first, count, part in slices(raw):
            buf = np.frombuffer(part, np.uint8)
            is_word = np.zeros(len(buf) + 2, dtype=np.int8)
            is_word[1:-1] = _WORD[buf]
            step = np.diff(is_word)
            s, e = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            sums = prefix_sums(buf)
            hashes.append(span_hashes(sums, s, e))
            for k, p in zip(prefix_lengths, prefixes):
                p.append(span_hashes(sums, s, np.minimum(s + k, e)))
            breaks = np.cumsum(buf == 0) if count > 1 else None
            doc.append(first + breaks[s] if count > 1 else np.full(len(s), first))
            ends_of = np.cumsum(_SENTENCE_END[buf] | (buf == 0)) if len(buf) else np.zeros(0, dtype=np.int64)
            sentence.append(n_sent + ends_of[s])
            n_sent += int(ends_of[-1]) + 1 if len(buf) else 1
            if count == 1:
                starts_.append(s + offsets[first])
                ends_.append(e + offsets[first])
                offsets[first] += len(part)
            else:
                at = np.concatenate([[0], np.flatnonzero(buf == 0) + 1])
                shift = at[breaks[s]] if len(s) else s
                starts_.append(s - shift)
                ends_.append(e - shift)
    cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, dtype=t)
    return Words(len(raw), cat(doc, np.int64), cat(hashes, np.uint64), [cat(p, np.uint64) for p in prefixes], cat(sentence, np.int64), n_sent, (cat(starts_, np.int64), cat(ends_, np.int64)))
