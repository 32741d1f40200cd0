"""Benchmark decontamination: Wu-Manber search for many word sequences at once.

The test strings are the windows of ``WINDOW`` consecutive words of the benchmark's items; an item of fewer words is
one window. Words are the symbols, blocks are two words. For windows of one length a shift table over hashed blocks
says how many words may be skipped after a block, 0 where a window ends with it; then the suffix's bucket gives the
windows that end so (kept in order of a hash of the whole window, so that a suffix which very many windows share costs
a binary search), and the words of every window left are compared byte for byte. A task runs the search over
thousands of places of its texts at once: numpy moves every place by its own shift.

Scale: documents are read once and never shuffled; what a task holds is one slice of them and one block of
windows. The benchmark is cut by a hash of its rows into blocks of about ``BLOCK_BYTES`` of text, counted before they
are sent; with more than one block each is searched for in all documents and only what it finds is put together.

Defined results: null and empty texts have no words; an item without words has no window; rows repeated in the
benchmark and items that share windows all count, an id that several rows have counts once; an item without id is
an item with an empty id. Repeated documents are rows of their own. Empty tables give empty results or no hits.
Other columns are ignored or carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carry, fresh_name, materialize, mix
from tidemark.llm.shingles import word_hashes

WINDOW = 10
BLOCK_BYTES = 16_000_000
#: A task moves about so many places at a time, and compares windows in portions of so many bytes.
LANES, PORTION = 4096, 4_000_000
#: Texts are searched in chunks of about so many bytes.
CHUNK = 1_000_000
FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words as they are compared; all others become blanks.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


@dataclass
class Words:
    """The words of some texts: 64-bit hashes, edges in the words' joined bytes, and the text that each belongs to."""

    hashes: np.ndarray
    edges: np.ndarray
    text: np.ndarray
    solid: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Words:
        each = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        raw = _FOLD[np.frombuffer(b"\n".join(each), np.uint8)]
        starts = np.cumsum([0, *(len(t) + 1 for t in each)])[:-1]
        hashes, first = word_hashes(raw, starts[:1])
        solid = raw != 0x20
        last = np.flatnonzero(solid & ~np.append(solid[1:], False)) + 1
        return cls(hashes, np.concatenate([[0], np.cumsum(last - first)]), np.searchsorted(starts, first, "right") - 1, raw[solid])

    def __len__(self) -> int:
        return len(self.hashes)

    def block(self, end: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the blocks of one or two words that end at the words ``end``."""
        return self.hashes[end] if size == 1 else mix(self.hashes[end - 1] * _GOLDEN + self.hashes[end])

    def window(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hashes of windows of ``size`` words."""
        out = np.zeros(len(start), np.uint64)
        for j in range(size):
            out = mix((out + self.hashes[start + j]) * _GOLDEN + np.uint64(1))
        return out


def same(a: Words, i: np.ndarray, b: Words, k: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from i on in ``a`` are those from k on in ``b``: lengths first, then every byte."""
    equal = np.ones(len(i), bool)
    for j in range(size):
        equal &= a.edges[i + j + 1] - a.edges[i + j] == b.edges[k + j + 1] - b.edges[k + j]
    on = np.flatnonzero(equal)
    long = a.edges[i[on] + size] - a.edges[i[on]]
    upto, at = np.cumsum(long), 0
    while at < len(on):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PORTION, "right")))
        n, own = long[at:stop], on[at:stop]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        differs = a.solid[np.repeat(a.edges[i[own]], n) + place] != b.solid[np.repeat(b.edges[k[own]], n) + place]
        equal[own] = np.add.reduceat(differs, begin) == 0
        at = stop
    return equal


class Matcher:
    """Tables for all windows of one length; entries are windows that differ, each with the items that hold it."""

    def __init__(self, words: Words, starts: np.ndarray, size: int):
        self.words, self.size, self.pair = words, size, min(2, size)
        bits = int(np.clip(np.ceil(np.log2(16 * max(1, len(starts)))), 16, 24))
        self.mask = np.uint64((1 << bits) - 1)
        reach = size - self.pair
        self.shift = np.full(1 << bits, reach + 1, np.uint8)
        for j in range(reach + 1):
            slot = words.block(starts + j + self.pair - 1, self.pair) & self.mask
            self.shift[slot] = np.minimum(self.shift[slot], reach - j)
        keys = self._keys(words, starts)
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        # windows that repeat the first one of their key are that entry; the others, should hashes clash, stay entries
        begins = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        own = begins | ~same(words, starts, words, starts[first], size)
        self.keys, self.starts = keys[own], starts[own]
        entry = np.where(own, np.cumsum(own) - 1, (np.cumsum(own) - 1)[first])
        held = np.unique(np.stack([entry, words.text[starts]]), axis=1)
        self.items, self.edges = held[1], np.searchsorted(held[0], np.arange(len(self.keys) + 1))

    def _keys(self, words: Words, starts: np.ndarray) -> np.ndarray:
        """Slot of the suffix, then a hash of the whole window: a suffix's bucket is a run of these keys."""
        suffix = words.block(starts + self.size - 1, self.pair) & self.mask
        return suffix << np.uint64(40) | words.window(starts, self.size) >> np.uint64(24)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of all occurrences, and their entries."""
        lanes = np.linspace(self.size - 1, len(words), min(LANES, max(1, len(words) // 32)) + 1).astype(np.int64)
        at, stop = lanes[:-1], lanes[1:]
        ends = []
        while True:
            alive = at < stop
            at, stop = at[alive], stop[alive]
            if not len(at):
                break
            skip = self.shift[words.block(at, self.pair) & self.mask]
            ends.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
        ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        starts = ends - (self.size - 1)
        starts = starts[words.text[starts] == words.text[ends]]
        keys = self._keys(words, starts)
        low = np.searchsorted(self.keys, keys, "left")
        n = np.searchsorted(self.keys, keys, "right") - low
        starts, entry = np.repeat(starts, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = same(words, starts, self.words, self.starts[entry], self.size)
        return starts[found], entry[found]

    def items_of(self, entries: np.ndarray) -> np.ndarray:
        return np.concatenate([self.items[self.edges[e] : self.edges[e + 1]] for e in np.unique(entries)])


@dataclass
class Benchmark:
    """A block of items, ready to be sent to tasks."""

    ids: list[str]
    matchers: list[Matcher]

    @classmethod
    def of(cls, ids: list[str], texts: list[str | None], window: int = WINDOW) -> Benchmark:
        words = Words.of(texts)
        n = np.bincount(words.text, minlength=len(texts))
        size = np.minimum(n, window)[words.text]  # of the windows of each word's item
        place = np.arange(len(words)) - (np.cumsum(n) - n)[words.text]
        starts = place + size <= n[words.text]
        return cls(ids, [Matcher(words, np.flatnonzero(starts & (size == m)), m) for m in np.unique(size).tolist()])

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, list[dict[str, int]], list[str]]]:
        """For each text its number of words, the spans of hit words and the ids of items that occur."""
        words = Words.of(texts)
        n = np.bincount(words.text, minlength=len(texts))
        first = np.cumsum(n) - n
        edges = np.zeros(len(words) + 1, np.int64)
        held: dict[int, set[str]] = {}
        for m in self.matchers:
            if len(words) < m.size:
                continue
            starts, entries = m.search(words)
            edges += np.bincount(starts, minlength=len(edges)) - np.bincount(starts + m.size, minlength=len(edges))
            owner = words.text[starts]
            for d in np.unique(owner).tolist():
                held.setdefault(d, set()).update(self.ids[i] for i in m.items_of(entries[owner == d]).tolist())
        hit = np.cumsum(edges[:-1]) > 0
        opens, closes = hit.copy(), hit.copy()
        if len(words):
            turn = words.text[1:] != words.text[:-1]
            opens[1:] &= ~hit[:-1] | turn
            closes[:-1] &= ~hit[1:] | turn
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        spans: dict[int, list[dict[str, int]]] = {}
        for d, b, e in zip(words.text[begin].tolist(), begin.tolist(), end.tolist(), strict=True):
            spans.setdefault(d, []).append({"start": b - int(first[d]), "stop": e - int(first[d])})
        for d in range(len(texts)):
            yield int(n[d]), spans.get(d, []), sorted(held.get(d, ()))


def _search(rows: DataFrame, carried: list[str], text: str, block: Benchmark | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block or Benchmark([], []))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, at = frame[text].tolist(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < CHUNK):
                    size += len(texts[stop] or "")
                    stop += 1
                yield pd.DataFrame(list(sent.value.find(texts[at:stop])), columns=["n_words", "spans", "items"])
                at = stop

    return carry(rows, carried, [text], FOUND, run)


def blocks(items: DataFrame, window: int = WINDOW) -> Iterator[Benchmark]:
    """The benchmark's items (item_id, text) in blocks of bounded size."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, n))))
    for k in range(n):
        held = dealt.where(F.col("block") == k).select("id", "text").toArrow()  # about BLOCK_BYTES
        yield Benchmark.of(held["id"].to_pylist(), held["text"].to_pylist(), window)


def occurrences(docs: DataFrame, items: DataFrame, carried: list[str], window: int = WINDOW) -> DataFrame:
    """The columns ``carried`` of every row of ``docs`` with n_words, spans (of hit words, from 0) and items (ids of those that occur)."""
    found = list(blocks(items, window))
    if len(found) <= 1:
        return _search(docs, carried, "text", found[0] if found else None)
    row = fresh_name(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    each = None
    for block in found:
        part = materialize(_search(rows, [row], "text", block), "decontaminate-found")
        each = part if each is None else each.unionByName(part)
    merged = each.groupBy(row).agg(  # a row for each block
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    return rows.select(*dict.fromkeys([*(f"`{c}`" for c in carried), row])).join(merged, row).select(*(f"`{c}`" for c in carried), "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    """Words in the union of spans in order."""
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(F.greatest(a.upto, s.stop).alias("upto"), (a.n + F.greatest(F.lit(0), s.stop - F.greatest(a.upto, s.start))).alias("n")),
        lambda a: a.n,
    )


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows = occurrences(docs, items, ["doc_id"], window)
    return rows.select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, most: float = 0.0, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` of whose words a share of ``most`` at most is hit; a text without words stays."""
    names = {c: fresh_name(docs, c) for c in ("n_words", "spans", "items")}
    if any(a != b for a, b in names.items()):  # columns of these names are there: they are carried under others
        renamed = {c: fresh_name(docs, f"own_{k}") for k, c in enumerate(docs.columns)}
        back = {v: k for k, v in renamed.items()}
        kept = drop_contaminated(docs.toDF(*("text" if c == "text" else renamed[c] for c in docs.columns)), items, most, window)
        return kept.toDF(*(back.get(c, c) for c in kept.columns))
    rows = occurrences(docs, items, docs.columns, window)
    return rows.where(covered(F.col("spans")) <= most * F.col("n_words")).select(*(f"`{c}`" for c in docs.columns))

