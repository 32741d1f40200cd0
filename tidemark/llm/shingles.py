"""Word shingles of whole texts as 64-bit numbers, taken straight from Arrow's buffers.

A word's hash runs over its bytes, eight at a time, and its length; a word longer than ``LONG`` bytes is
hashed by blake2b. A shingle's hash sums the hashes of its words with a weight for each place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import mix

WORDS = 5
LONG = 512
#: Texts are hashed in chunks of about so many bytes.
CHUNK = 1_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another and their n + 1 edges; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, edges, raw = column.buffers()
    edges = np.frombuffer(edges, np.int64)[column.offset : column.offset + len(column) + 1] if edges else np.zeros(1, np.int64)
    return (np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)), edges


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another and begin at ``starts``, and each word's first byte."""
    solid = ~_BLANK[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    begun = starts[starts < len(raw)]
    opens[begun] = solid[begun]
    ended = begun[begun > 0] - 1
    closes[ended] = solid[ended]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    padded = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    left = last - first
    hashes = mix(left.astype(np.uint64) * _GOLDEN + np.uint64(1))
    on, at = np.flatnonzero(left <= LONG), 0
    while len(on):
        block = eight[first[on] + at] & _KEEP[np.minimum(left[on] - at, 8)]
        hashes[on] = mix((hashes[on] ^ block) * _GOLDEN + np.uint64(at + 1))
        at += 8
        on = on[left[on] > at]
    for k in np.flatnonzero(left > LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(padded[first[k] : last[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, first


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _WEIGHTS[i]
    return mix(total)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def shingle_sets(raw: np.ndarray, edges: np.ndarray) -> Iterator[np.ndarray]:
    """For each whole text the hashes of its distinct shingles, in ascending order; a short text is one shingle."""
    at, texts = 0, len(edges) - 1
    while at < texts:
        upto = min(texts, max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1))
        own = edges[at : upto + 1] - edges[at]
        words, first = word_hashes(raw[edges[at] : edges[upto]], own[:-1])
        whole = _windows(words, WORDS) if len(words) >= WORDS else words[:0]
        start = 0
        for stop in np.searchsorted(first, own[1:]).tolist():
            n = stop - start
            yield _distinct(whole[start : stop - WORDS + 1] if n >= WORDS else _windows(words[start:stop], n)) if n else words[:0]
            start = stop
        at = upto


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two numbers that name a set: 128 bits of a digest."""
    digest = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
    return int(digest[0]), int(digest[1])
