"""Language-model scoring with an Elias-Fano n-gram trie of order three.

Levels. The first level holds every word of the training texts, known by a 63-bit hash; a word's number is
its hash's place. The second holds the bigrams and the third the trigrams that occur ``least_count`` times or more. A
level is one ascending sequence of numbers (context * width + successor), cut into runs of ``RUN`` and
stored by Elias-Fano: low bits packed, high bits in unary, with a directory of every ``STEP``-th bucket. A
context's own entry, successor 0, is the pointer to its successors, which follow it. A trigram's context is
its bigram's place in the second level, and its last word is named by its place among the successors of the
middle word, so numbers stay small. A search finds the run, then the bucket, then the successor in it; most
numbers that aren't there are told by a sieve, a byte an entry, before that.

Model. p(w|uv) = a(uvw) + b(uv) * p(w|v), p(w|v) = a(vw) + b(v) * p(w), p(w) = (c + 0.1) / (N + 0.1 (V + 1)),
where a is the count less ``DISCOUNT`` over all occurrences of the context and b is what the kept
successors of the context leave over. a and b are kept as one byte, a logarithm in steps of 10/255.

Counting. Tasks sort and count portions of their texts and hand on sorted blocks cut at fixed places of
the number range; those places follow from the counts of the contexts, so that no block grows with one hot
context. All texts count; the model is a few bytes a kept n-gram and is read through memory maps.

Defined results: null and empty texts are the end token alone; a null doc_id is learnt from; without
training text every score is 0; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import fcntl
import functools
import os
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import carry, discard, fold_words, materialize

RUN, STEP = 4096, 16
SIEVE = 512  # 64-bit words of a run's sieve
DISCOUNT = 0.75
LEAST_COUNT = 2  # of a bigram or trigram that is kept; 1 keeps all
BLOCK = 2_000_000  # occurrences between two cuts of the number range, about
PORTION = 1_000_000  # tokens that a task sorts at a time
WORDS_BLOCK = 500_000  # words of the first level in one group
END = b" "  # no word holds a space
LOWEST = -10.0


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


# ---- Elias-Fano runs


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values packed to ``width`` bits each, as 64-bit words with one spare word."""
    if not width:
        return np.zeros(1, np.uint64)
    flat = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    raw = np.packbits(flat, bitorder="little").tobytes()
    return np.frombuffer(raw + b"\0" * (-len(raw) % 8 + 8), np.uint64)


def _sieve_bit(x: np.ndarray) -> np.ndarray:
    """The bit of a run's sieve for a number, counted from the run's first one."""
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)


def encode_runs(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of the runs of ascending distinct ``keys``; the sizes of each run's parts tell where the next one begins."""
    out: dict[str, list] = {x: [] for x in ("first", "size", "low_bits", "high_words", "low_words", "steps")}
    high, low, step, sieve = [], [], [], []
    for at in range(0, len(keys), RUN):
        own = keys[at : at + RUN]
        x = own - own[0]
        width = max(0, int(int(x[-1]) // len(x)).bit_length() - 1) if x[-1] else 0
        top = x >> width
        line = np.zeros(int(top[-1]) + len(x) + 2, np.uint8)
        line[top + np.arange(len(x))] = 1
        raw = np.packbits(line, bitorder="little").tobytes()
        high.append(np.frombuffer(raw + b"\0" * (-len(raw) % 8 + 8), np.uint64))
        low.append(_bits(x & ((1 << width) - 1), width))
        buckets = np.arange(0, int(top[-1]) + 2, STEP)
        step.append((np.searchsorted(top, buckets) + buckets).astype(np.uint32))
        held = np.zeros(64 * SIEVE, np.uint8)
        held[_sieve_bit(x)] = 1
        sieve.append(np.packbits(held, bitorder="little").view(np.uint64))
        for name, value in zip(out, (own[0], len(x), width, len(high[-1]), len(low[-1]), len(step[-1])), strict=True):
            out[name].append(value)
    whole = {x: np.array(v, np.int64) for x, v in out.items()}
    for name, parts, kind in (("high", high, np.uint64), ("low", low, np.uint64), ("step", step, np.uint32), ("sieve", sieve, np.uint64)):
        whole[name] = np.concatenate(parts) if parts else np.empty(0, kind)
    return whole


ARRAYS = {"first": np.int64, "size": np.int64, "low_bits": np.int64, "high_words": np.int64, "low_words": np.int64, "steps": np.int64, "high": np.uint64, "low": np.uint64, "step": np.uint32, "sieve": np.uint64}


class Level:
    """Memory-mapped runs with one byte (or count) for each entry."""

    def __init__(self, folder: str):
        def mapped(name: str, kind: type) -> np.ndarray:
            path = f"{folder}/{name}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)

        for name, kind in ARRAYS.items():
            setattr(self, name, mapped(name, kind))
        self.value = mapped("value", np.uint8)
        self.large_at, self.large = mapped("large_at", np.int64), mapped("large", np.int64)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.start, self.high_at, self.low_at, self.step_at = before(self.size), before(self.high_words), before(self.low_words), before(self.steps)
        self.count = int(self.start[-1])

    def _bucket(self, run: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The bit where bucket ``h`` of each run begins."""
        at = self.step[self.step_at[run] + h // STEP].astype(np.int64)
        left = h % STEP
        word = self.high_at[run] + (at >> 6)
        zeros = ~self.high[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        n = np.bitwise_count(zeros).astype(np.int64)
        far = np.flatnonzero(left > n)
        while far.size:
            left[far] -= n[far]
            word[far] += 1
            zeros[far] = ~self.high[word[far]]
            n[far] = np.bitwise_count(zeros[far])
            far = far[left[far] > n[far]]
        for k in range(1, STEP):
            more = np.flatnonzero(left > k)
            if not more.size:
                break
            zeros[more] &= zeros[more] - np.uint64(1)
        bit = np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return np.where(left > 0, (word - self.high_at[run]) * 64 + bit + 1, at)

    def _low(self, run: np.ndarray, i: np.ndarray) -> np.ndarray:
        width = self.low_bits[run]
        bit = i * width
        word, off = self.low_at[run] + (bit >> 6), (bit & 63).astype(np.uint64)
        above = np.where(off > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
        return (((self.low[word] >> off) | above) & mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not self.count:
            return out
        run = np.searchsorted(self.first, keys, "right") - 1
        ask = np.flatnonzero(run >= 0)
        run = run[ask]
        x = keys[ask] - self.first[run]
        bit = _sieve_bit(x)
        maybe = np.flatnonzero((self.sieve[run * SIEVE + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
        ask, run, x = ask[maybe], run[maybe], x[maybe]
        width = self.low_bits[run]
        h, target = x >> width, x & ((np.int64(1) << width) - 1)
        inside = h // STEP < self.steps[run]  # beyond the last bucket there is nothing
        ask, run, h, target = ask[inside], run[inside], h[inside], target[inside]
        begin = self._bucket(run, h)
        i = begin - h
        inside = i < self.size[run]
        ask, run, h, target, begin, i = ask[inside], run[inside], h[inside], target[inside], begin[inside], i[inside]
        # the bucket's entries are the ones that follow; where they reach the end of the word, the next bucket tells
        off = begin & 63
        word = ~(self.high[self.high_at[run] + (begin >> 6)] >> off.astype(np.uint64))
        ones = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        more = np.flatnonzero(off + ones >= 64)
        ones[more] = self._bucket(run[more], h[more] + 1) - 1 - begin[more]
        end = np.minimum(i + ones, self.size[run])
        lo, hi = i, end.copy()
        while True:  # the first entry that isn't below the target
            open_ = np.flatnonzero(lo < hi)
            if not open_.size:
                break
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._low(run[open_], mid) < target[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        got = np.flatnonzero(lo < end)
        got = got[self._low(run[got], lo[got]) == target[got]]
        out[ask[got]] = self.start[run[got]] + lo[got]
        return out

    def counts(self, at: np.ndarray) -> np.ndarray:
        out = self.value[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        out[large] = self.large[np.searchsorted(self.large_at, at[large])]
        return out

    def shares(self, at: np.ndarray) -> np.ndarray:
        return 10 ** (self.value[at] * (LOWEST / 255))


def _byte(shares: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(np.maximum(shares, 1e-300)) * (255 / LOWEST)), 0, 255).astype(np.uint8)


# ---- levels as tables and files

LEVEL_SCHEMA = "block long, n long, cuts array<struct<at: long, part: double>>, value binary, large_at binary, large binary, " + ", ".join(f"`{x}` binary" for x in ARRAYS)


def _level_row(block: int, keys: np.ndarray, values: np.ndarray, cuts: list[tuple[int, float]], large: np.ndarray | None = None) -> pd.DataFrame:
    at = np.flatnonzero(values >= 255) if large is not None else np.empty(0, np.int64)
    row = {"block": block, "n": len(keys), "cuts": [[{"at": a, "part": p} for a, p in cuts]], "value": [np.minimum(values, 255).astype(np.uint8).tobytes()]}
    row |= {"large_at": [at.astype(np.int64).tobytes()], "large": [values[at].astype(np.int64).tobytes()]}
    return pd.DataFrame(row | {x: [v.astype(ARRAYS[x]).tobytes()] for x, v in encode_runs(keys).items()})


def _cut_places(weights: np.ndarray) -> list[tuple[int, float]]:
    """Cuts (entry, part of its range) after every ``BLOCK`` of weight or so; a heavy entry is cut inside."""
    if not len(weights):
        return []
    total = np.cumsum(weights)
    marks = np.arange(BLOCK, int(total[-1]), BLOCK)
    at = np.searchsorted(total, marks, "right")
    inside = (marks - (total[at] - weights[at])) / np.maximum(weights[at], 1)
    return [(0, 0.0), *((int(a), float(p) if weights[a] >= BLOCK else 0.0) for a, p in zip(at, inside, strict=True))]


@dataclass(frozen=True)
class Shipped:
    """Names of a level's files on every machine."""

    name: str
    files: tuple[str, ...]


def _ship(level: DataFrame, name: str) -> Shipped:
    """Give the files of a level's table to every executor."""
    files = []
    for path in level.inputFiles():
        level.sparkSession.sparkContext.addFile(path)
        files.append(os.path.basename(path))
    return Shipped(f"{name}-{uuid.uuid4().hex}", tuple(files))


@functools.lru_cache(maxsize=8)
def open_level(shipped: Shipped) -> Level:
    """The level mapped into memory; the first worker of a machine lays its arrays out one after another."""
    folder = os.path.join(SparkFiles.getRootDirectory(), shipped.name)
    with open(folder + ".lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(folder):
            parts = [(pq.ParquetFile(SparkFiles.get(f)), SparkFiles.get(f)) for f in shipped.files]
            rows = sorted((b, i, g) for i, (p, _) in enumerate(parts) for g in range(p.num_row_groups) for b in p.read_row_group(g, ["block"])["block"].to_pylist())
            draft, before = f"{folder}.draft-{os.getpid()}", 0
            os.mkdir(draft)
            out = {x: open(f"{draft}/{x}", "wb") for x in ("value", "large_at", "large", *ARRAYS)}  # noqa: SIM115
            held: tuple[int, int, dict] = (-1, -1, {})
            for block, i, g in rows:
                if held[:2] != (i, g):
                    held = (i, g, {r["block"]: r for r in parts[i][0].read_row_group(g).to_pylist()})
                row = held[2][block]
                for x, f in out.items():
                    f.write((np.frombuffer(row[x], np.int64) + before).tobytes() if x == "large_at" else row[x])
                before += row["n"]
            for f in out.values():
                f.close()
            os.rename(draft, folder)
            for _, path in parts:  # laid out; the next worker finds the folder
                os.remove(path)
    return Level(folder)


# ---- words


class Words(dict):
    """word -> row, in the order in which words are first met; ``number`` of each row in the first level, -1 where unknown."""

    def __init__(self, level: Level, limit: int = 300_000):
        super().__init__()
        self.level, self.limit = level, limit
        self.fresh: list[bytes] = []
        self.number = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        row = self[word] = len(self)
        return row

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """Numbers of all tokens of all texts."""
        if len(self) > self.limit:
            self.clear()
            self.number = np.empty(0, np.int64)
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if self.fresh:
            hashes = np.fromiter(map(word_hash, self.fresh), np.int64, len(self.fresh))
            order = np.argsort(hashes)
            number = np.empty(len(order), np.int64)
            number[order] = self.level.find(hashes[order])
            self.number, self.fresh = np.concatenate([self.number, number]), []
        return self.number[rows]


def _portions(batches: Iterator[pd.DataFrame], tokens: int) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Rows with the tokens of their texts, each closed by the end token, about ``tokens`` at a time."""
    for batch in batches:
        at, held, words = 0, 0, []
        for i, text in enumerate(batch["text"]):
            words.append(fold_words(text))
            words[-1].append(END)
            held += len(words[-1])
            if held >= tokens or i + 1 == len(batch):
                yield batch.iloc[at : i + 1], words
                at, held, words = i + 1, 0, []


@functools.lru_cache(maxsize=1)
def _worker_words(first: Shipped) -> Words:
    return Words(open_level(first))


def _numbers(words: int) -> str:
    return "array<int>" if words < 1 << 31 else "array<bigint>"


def numbered(docs: DataFrame, first: Shipped, words: int) -> DataFrame:
    """``docs`` with ``tokens``, the numbers of its tokens, instead of its text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _worker_words(first)
        for _, texts in _portions(batches, PORTION // 4):
            yield pd.DataFrame({"tokens": np.split(known.numbers(texts), np.cumsum(_lengths(texts))[:-1])})

    return carry(docs, [c for c in docs.columns if c != "text"], ["text"], f"tokens {_numbers(words)}", run)


def _runs(batches: Iterator[pd.DataFrame], tokens: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows with all their tokens and how many each has, about ``tokens`` at a time."""
    for batch in batches:
        lengths = np.fromiter(map(len, batch["tokens"]), np.int64, len(batch))
        if not len(lengths):
            continue
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // tokens, append=-1)) + 1
        for start, stop in zip([0, *cuts[:-1]], cuts, strict=True):
            part = batch.iloc[start:stop]
            yield part, np.concatenate(part["tokens"].tolist()).astype(np.int64), lengths[start:stop]


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) of every word and of the end token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for _, words in _portions(batches, PORTION):
            counts.update(chain.from_iterable(words))
            if len(counts) > 300_000:
                yield frame(counts)
                counts = Counter()
        yield frame(counts)

    def frame(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"hash": np.fromiter(map(word_hash, counts), np.int64, len(counts)), "n": np.fromiter(counts.values(), np.int64, len(counts))})

    return docs.select("text").mapInPandas(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def word_level(counted: DataFrame, words: int) -> DataFrame:
    """The first level: blocks of equal parts of the hashes' range, which hashes fill evenly."""
    bits = max(0, (words // WORDS_BLOCK).bit_length())

    def encode(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("hash")
        n = rows["n"].to_numpy(np.int64)
        return _level_row(int(key[0]), rows["hash"].to_numpy(np.int64), n, _cut_places(n), n)

    return counted.withColumn("block", F.shiftright("hash", 63 - bits) if bits else F.lit(0).cast("long")).groupBy("block").applyInPandas(encode, LEVEL_SCHEMA)


# ---- n-grams


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts, compressed."""
    gaps = np.diff(keys, prepend=0)
    kind = np.uint32 if len(gaps) < 2 or gaps[1:].max() < 1 << 32 else np.uint64
    many = np.uint8 if counts.max(initial=0) < 256 else np.uint64
    head = np.array([len(keys), keys[0] if len(keys) else 0, kind == np.uint32, many == np.uint8], np.int64)
    return zstandard.compress(head.tobytes() + gaps[1:].astype(kind).tobytes() + counts.astype(many).tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    n, first, small, few = np.frombuffer(raw[:32], np.int64).tolist()
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    middle = 32 + (n - 1) * (4 if small else 8)
    gaps = np.frombuffer(raw[32:middle], np.uint32 if small else np.uint64).astype(np.int64)
    return np.cumsum(np.concatenate([[first], gaps])), np.frombuffer(raw[middle:], np.uint8 if few else np.uint64).astype(np.int64)


def count_grams(texts: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], cuts: np.ndarray) -> DataFrame:
    """Sorted blocks (block, packed) of the keys of all texts (tokens), cut at ``cuts``."""
    shipped = texts.sparkSession.sparkContext.broadcast(cuts)  # a number for every BLOCK occurrences

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, tokens, lengths in _runs(batches, PORTION):
            keys, counts = np.unique(keys_of(tokens, lengths), return_counts=True)
            at = np.searchsorted(keys, shipped.value)
            parts = [(i, k, c) for i, (k, c) in enumerate(zip(np.split(keys, at), np.split(counts, at), strict=True)) if len(k)]
            yield pd.DataFrame({"block": [p[0] for p in parts], "packed": [_packed(k, c) for _, k, c in parts]})

    return texts.select("tokens").mapInPandas(run, "block long, packed binary")


def merge_grams(counted: DataFrame, width: int, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row for each block: its kept keys, and of every context with kept keys all occurrences; apart from
    them, what the block holds of its first and last context, which may go on in other blocks."""

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(raw) for raw in rows["packed"]]
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] // width != keys[:-1] // width]))
        context, total = keys[heads] // width, np.add.reduceat(counts, heads)
        keep = (counts >= least_count) & (keys % width != width - 1)
        kept, number = np.add.reduceat(np.where(keep, counts, 0), heads), np.add.reduceat(keep.astype(np.int64), heads)
        ends = [{"context": int(context[i]), "total": int(total[i]), "kept": int(kept[i]), "number": int(number[i])} for i in sorted({0, len(heads) - 1})]
        some = number > 0
        return pd.DataFrame({"block": int(key[0]), "ends": [ends], "packed": [_packed(keys[keep], counts[keep])], "contexts": [_packed(context[some], total[some])], "widest": int(number.max())})

    schema = "block long, ends array<struct<context: long, total: long, kept: long, number: long>>, packed binary, contexts binary, widest long"
    return counted.groupBy("block").applyInPandas(merge, schema)


def gram_level(merged: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The level of merged blocks, and the most successors of a context."""
    shared: dict[int, list[int]] = {}  # contexts at the ends of blocks: where they begin, all, kept, number
    widest = 0
    for r in merged.select("block", "ends", "widest").orderBy("block").toLocalIterator():  # two contexts a block
        widest = max(widest, r["widest"])
        for e in r["ends"]:
            own = shared.setdefault(e["context"], [r["block"], 0, 0, 0])
            own[1:] = [own[1] + e["total"], own[2] + e["kept"], own[3] + e["number"]]
    widest = max([widest, *(x[3] for x in shared.values())])
    known = merged.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                keys, counts = _unpacked(r.packed)
                context, total = _unpacked(r.contexts)
                ends = {e["context"] for e in r.ends}
                mine = np.array(sorted(c for c in ends if known.value[c][3]), np.int64)
                total = np.concatenate([total, [known.value[c][1] for c in mine.tolist()]]).astype(np.int64)
                context = np.concatenate([context, mine])
                context, last = np.unique(context[::-1], return_index=True)  # what is known of all blocks goes before
                total = total[::-1][last]
                owner = np.searchsorted(context, keys // width)
                kept = np.bincount(owner, counts - DISCOUNT, len(context)) if len(keys) else np.zeros(len(context))
                opens = np.ones(len(context), bool)
                for i, c in enumerate(context.tolist()):
                    if c in ends:
                        kept[i] = known.value[c][2] - DISCOUNT * known.value[c][3]
                        opens[i] = known.value[c][0] == r.block
                left = np.maximum(1 - kept / total, 1e-10)
                every = np.concatenate([context[opens] * width, keys])
                values = np.concatenate([_byte(left[opens]), _byte((counts - DISCOUNT) / total[owner])])
                weight = np.concatenate([np.zeros(int(opens.sum()), np.int64), counts])
                order = np.argsort(every, kind="stable")
                yield _level_row(r.block, every[order], values[order], _cut_places(weight[order]))

    return merged.mapInPandas(run, LEVEL_SCHEMA), widest


def _cuts(level: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Where the next level's numbers are cut, and how many entries this one has."""
    before, found = 0, []
    for r in level.select("block", "n", "cuts").orderBy("block").toLocalIterator():
        found += [(before + c["at"]) * width + int(c["part"] * width) for c in r["cuts"]]
        before += r["n"]
    return np.unique(np.array(found, np.int64)), before


@dataclass
class TrieModel:
    levels: list[Shipped]  # none where nothing was learnt
    tokens: int
    words: int
    width: int = 1  # of the third level's numbers


def _lengths(words: list[list[bytes]]) -> np.ndarray:
    return np.fromiter(map(len, words), np.int64, len(words))


def _found(level: Level, keys: np.ndarray) -> np.ndarray:
    """Places of keys, which may repeat or be -1."""
    out = np.full(len(keys), -1, np.int64)
    asked = np.flatnonzero(keys >= 0)
    own, back = np.unique(keys[asked], return_inverse=True)
    out[asked] = level.find(own)[back]
    return out


def _pair_keys(numbers: np.ndarray, before: np.ndarray, words: int) -> np.ndarray:
    """Numbers of the bigrams (before, number) in the second level; -1 where a word is unknown."""
    return np.where((numbers >= 0) & (before >= 0), before * (words + 2) + numbers + 1, -1)


def _triple_keys(pairs: np.ndarray, heads: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the trigrams in the third level: place of the first bigram, and of the second among its context's.

    A second bigram that isn't kept is named width - 1; -1 where the first one isn't kept or there is none.
    """
    first = np.concatenate([[-1], pairs[:-1]])
    first[np.cumsum(lengths) - lengths] = -1
    return np.where(first >= 0, first * width + np.where(pairs >= 0, pairs - heads, width - 1), -1)


def _before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each one; the end token, each text's last one, stands before every text."""
    out = np.concatenate([[0], tokens[:-1]])
    ends = np.cumsum(lengths)
    out[ends - lengths] = tokens[ends - 1]
    return out


def _pairs(second: Level, tokens: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the place of its bigram (-1: not kept) and of its context's own entry; the distinct tokens, and which one each is."""
    own, which = np.unique(tokens, return_inverse=True)
    entry = np.full(len(own), -1, np.int64)
    known = np.flatnonzero(own >= 0)
    entry[known] = second.find(own[known] * (words + 2))
    heads = _before(entry[which], lengths)
    return _found(second, np.where(heads >= 0, _pair_keys(tokens, _before(tokens, lengths), words), -1)), heads, own, which


def learn(docs: DataFrame, least_count: int = LEAST_COUNT) -> TrieModel:
    """The model of all texts of ``docs``."""
    return _learn(docs, F.lit(False), least_count)[0]


def _learn(docs: DataFrame, held_out: Column, least_count: int) -> tuple[TrieModel, DataFrame]:
    """The model of the texts that aren't held out, and all documents (doc_id, held_out, tokens) by the model's numbers."""
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    counted = materialize(count_words(rows.where("NOT held_out")), "trie-words")
    total = counted.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    words, tokens = total["v"], total["n"]
    first = materialize(word_level(counted, words), "trie-level-1")
    one = _ship(first, "level-1")
    table = materialize(numbered(rows, one, words), "trie-tokens", "zstd")
    if not words:
        return TrieModel([], 0, 0), table
    texts, width = table.where("NOT held_out"), words + 2
    merged = materialize(merge_grams(count_grams(texts, lambda t, n: _pair_keys(t, _before(t, n), words), _cuts(first, width)[0]), width, least_count), "trie-bigrams")
    second, widest = gram_level(merged, width)
    second = materialize(second, "trie-level-2")
    discard(merged, counted)
    two, wide = _ship(second, "level-2"), widest + 2

    def triples(t: np.ndarray, n: np.ndarray) -> np.ndarray:
        keys = _triple_keys(*_pairs(open_level(two), t, n, words)[:2], n, wide)
        return keys[keys >= 0]

    merged = materialize(merge_grams(count_grams(texts, triples, _cuts(second, wide)[0]), wide, least_count), "trie-trigrams")
    third = materialize(gram_level(merged, wide)[0], "trie-level-3")
    discard(merged)
    return TrieModel([one, two, _ship(third, "level-3")], tokens, words, wide), table


def score_tokens(model: TrieModel, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: known tokens, base score and score."""
    if not model.levels:
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths)), np.zeros(len(lengths))
    one, two, three = map(open_level, model.levels)
    pairs, heads, own, which = _pairs(two, tokens, lengths, model.words)
    known = np.flatnonzero(own >= 0)
    count = np.zeros(len(own), np.int64)
    count[known] = one.counts(own[known])
    count = count[which]
    base = (count + 0.1) / (model.tokens + 0.1 * (model.words + 1))

    def over(level: Level, at: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(at), missing)
        held = np.flatnonzero(at >= 0)
        out[held] = level.shares(at[held])
        return out

    p = over(two, pairs, 0.0) + over(two, heads, 1.0) * base
    keys = _triple_keys(pairs, heads, lengths, model.width)
    asked = np.flatnonzero(keys >= 0)
    own, which = np.unique(keys[asked], return_inverse=True)
    context, of = np.unique(own // model.width, return_inverse=True)
    context = three.find(context * model.width)[of]
    triples = np.full(len(own), -1, np.int64)
    held = np.flatnonzero((context >= 0) & (own % model.width != model.width - 1))
    triples[held] = three.find(own[held])
    p[asked] = over(three, triples, 0.0)[which] + over(three, context, 1.0)[which] * p[asked]
    starts = np.cumsum(lengths) - lengths
    add = lambda x: np.add.reduceat(x, starts)
    return add((count > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(np.minimum(p, 1.0)))


def _scores(table: DataFrame, model: TrieModel) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, tokens, lengths in _runs(batches, PORTION // 2):
            known, base, full = score_tokens(model, tokens, lengths)
            yield pd.DataFrame({"n_tokens": lengths, "n_known": known, "train_tokens": model.tokens, "base_score": base, "score": full})

    return carry(table, ["doc_id", "held_out"], ["tokens"], "n_tokens long, n_known long, train_tokens long, base_score double, score double", run)


def score(docs: DataFrame, model: TrieModel) -> DataFrame:
    """doc_id, held_out (false), n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = docs.select("doc_id", F.lit(False).alias("held_out"), "text")
    if not model.levels:
        lengths = rows.select("doc_id", "held_out", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"))
        zero = F.lit(0.0)
        return lengths.select("*", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    return _scores(numbered(rows, model.levels[0], model.words), model)


def learn_and_score(docs: DataFrame, held_out: Column, least_count: int = LEAST_COUNT) -> DataFrame:
    """The scores of all documents by the model of those that aren't held out; words are looked up once for both."""
    model, table = _learn(docs, held_out, least_count)
    return _scores(table, model)
