"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

A word here is what stands between two spaces, with the space before it. Frequent words of the corpus are
compiled into a minimal acyclic transducer: equal suffixes share states, arcs carry numbers whose sum along
a path is the word's place in the lexicon, and that place leads to its ids. The file is shipped once to
every machine and memory-mapped by the Python workers. Words that it lacks are merged exactly, many at a
time, by rank and then from the left. A worker looks each distinct word up once and gathers ids by index.

Exactness: the lexicon only saves work. Its ids come from the same merges, so any lexicon, an empty one
too, gives the same result. Which words are frequent is found by lossy counting: a word is counted in a
task where it occurs at least ``seen`` times.

Defined results: a null or empty text has no ids and decodes to an empty text; the special token's string
inside a text becomes its id, as in the tokenizers library; repeated rows each give a row; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.characters import cutter, is_old
from tidemark.llm.common import carry

LEXICON_WORDS = 65_536
SEEN = 8
WIDE = 48  # bytes of a word up to which words are merged together
CHARS = 1_000_000  # of text that a worker handles at a time
NO_RANK = np.iinfo(np.int32).max

# The pattern that cuts a text before byte-level BPE, with Unicode white space spelt out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NEW_CUT = cutter(rf"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?OTHER+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+", SPACE)
#: White space that may bind words on both sides of a space; such texts are cut as a whole.
LONG_SPACE = regex.compile(rf"[{SPACE}]{{3}}|[{SPACE}]{{2}}\Z")


def pieces_of(text: str) -> list[str]:
    return (CUT if is_old(text) else NEW_CUT).findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    for b in range(256):
        symbols.setdefault(b, chr(0x100 + len(symbols) - len(plain)))
    return [symbols[b] for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file; ``suffix`` marks the last symbol of a word."""

    def __init__(self, path: str, suffix: str = ""):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._index([(vocab[a] << 32) | vocab[b] for a, b in pairs])
        of = {s: b for b, s in enumerate(symbols)}
        size = max(max(vocab.values()), *self.special.values()) + 1
        spelt = [b""] * size
        for token, i in vocab.items():
            spelt[i] = bytes(of[c] for c in token.removesuffix(suffix)) if suffix else bytes(map(of.__getitem__, token))
        for token, i in self.special.items():
            spelt[i] = token.encode()
        self.spelt_length = np.array([len(s) for s in spelt], np.int64)
        self.spelt_start = np.concatenate([[0], np.cumsum(self.spelt_length)])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def _index(self, keys: list[int]) -> None:
        """An open table of pairs: four slots a pair at least, so a search seldom looks at a second one."""
        bits = max(4, len(keys).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        for rank, (key, slot) in enumerate(zip(keys, self._slot(np.array(keys, np.int64)).tolist(), strict=True)):
            while self.slots[slot] not in (-1, key):
                slot = (slot + 1) & self.mask
            if self.slots[slot] == -1:
                self.slots[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it isn't merged."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        found = self.slots[slot]
        out = np.where(found == keys, self.ranks[slot], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.slots[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((size > 0) & (size <= WIDE))
        short = short[np.argsort(size[short], kind="stable")]
        order, parts, lengths = [], [], []
        for at in range(0, len(short), 8192):
            chosen = short[at : at + 8192]
            ids, length = self._merge_together([words[i] for i in chosen.tolist()])
            order.append(chosen)
            parts.append(ids)
            lengths.append(length)
        for i in np.flatnonzero(size > WIDE).tolist():
            parts.append(self._merge_long(words[i]))
            order.append([i])
            lengths.append([len(parts[-1])])
        if not parts:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        done, own = np.concatenate(order), np.concatenate(lengths)
        length, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        length[done], start[done] = own, np.cumsum(own) - own
        return np.concatenate(parts)[gather(start, length)], length

    def _merge_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        width = int(length.max())
        held = np.arange(width) < length[:, None]
        ids = np.full((len(words), width), -1, np.int32)
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids[held] = self.first[flat]
        ids[np.arange(len(words)), length - 1] = self.last[flat[np.cumsum(length) - 1]]
        ranks = np.full((len(words), width), NO_RANK, np.int32)
        paired = held[:, 1:]
        ranks[:, :-1][paired] = self.rank(ids[:, :-1][paired], ids[:, 1:][paired])
        live, columns = np.arange(len(words)), np.arange(width)
        done = ids.copy()
        count = length.copy()
        while live.size:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(live.size), at]
            if not (more := best != NO_RANK).all():
                done[live[~more]] = ids[~more]
                live, ids, ranks, at, best = live[more], ids[more], ranks[more], at[more], best[more]
                if not live.size:
                    break
            rows = np.arange(live.size)
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, moved, 1), np.take_along_axis(ranks, moved, 1)
            count[live] -= 1
            ids[rows, at] = self.product[best]
            n = count[live]
            ranks[rows, at] = np.where(at + 1 < n, self.rank(ids[rows, at], ids[rows, np.minimum(at + 1, width - 1)]), NO_RANK)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.rank(ids[before, at[before] - 1], ids[before, at[before]])
        return done[columns < count[:, None]], count

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a queue of pairs in the order of rank and place."""
        flat = np.frombuffer(word, np.uint8)
        ids = self.first[flat].tolist()
        ids[-1] = int(self.last[flat[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.rank(np.array(ids[:-1]), np.array(ids[1:]))) if r != NO_RANK]
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.product[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            around = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < n]
            if around:
                got = self.rank(np.array([ids[x] for x, _ in around]), np.array([ids[y] for _, y in around]))
                for (x, y), r in zip(around, got.tolist(), strict=True):
                    if r != NO_RANK:
                        heapq.heappush(queue, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each has."""
        length = self.spelt_length[ids]
        return self.spelt[gather(self.spelt_start[ids], length)], length


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of all runs, one run after another."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut(word: str) -> list[bytes]:
    return [piece.encode("utf-8", "surrogatepass") for piece in pieces_of(word)]


def encode_words(merges: Merges, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words as they stand in a text (with the space before), by exact merges alone."""
    pieces = [cut(w) for w in words]
    distinct = {p: i for i, p in enumerate(dict.fromkeys(p for ps in pieces for p in ps))}
    ids, length = merges.merge(list(distinct))
    start = np.cumsum(length) - length
    flat = np.fromiter((distinct[p] for ps in pieces for p in ps), np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.concatenate([[0], np.cumsum(length[flat])])
    word_ends = np.cumsum(sizes)
    return ids[gather(start[flat], length[flat])], ends[word_ends] - ends[word_ends - sizes]


# ---- the lexicon


def compile_lexicon(words: list[bytes], ids: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic transducer of ``words`` (sorted, distinct) and of their ids."""
    known: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []
    final: list[bool] = []

    def settle(node: list) -> int:
        """The state for a finished node: an equal one if there is one, so that equal suffixes are shared."""
        key = (node[0], tuple(node[1].items()))
        if (state := known.get(key)) is None:
            state = known[key] = len(arcs)
            arcs.append(node[1])
            final.append(node[0])
        return state

    path: list[list] = [[False, {}]]
    last = b""
    for word in [*words, None]:
        same = 0 if word is None else next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))  # noqa: B905
        for depth in range(len(last), same, -1):
            path[depth - 1][1][last[depth - 1]] = settle(path.pop())
        if word is None:
            break
        path += [[False, {}] for _ in word[same:]]
        path[-1][0] = True
        last = word
    root = settle(path[0])
    below = np.zeros(len(arcs), np.int64)  # words that can still be spelt from a state; children settle first
    keys, targets, numbers = [], [], []
    for state, out in enumerate(arcs):
        before = int(final[state])
        for byte, target in out.items():
            keys.append((state << 8) | byte)
            targets.append(target)
            numbers.append(before)
            before += int(below[target])
        below[state] = before
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return {
        "arc": np.array(keys, np.int64),
        "target": np.array(targets, np.int64),
        "number": np.array(numbers, np.int64),
        "final": np.array(final, np.int64),
        "root": np.array([root], np.int64),
        "start": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64),
    }


def save_lexicon(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a header line with the arrays' names and sizes, padded to 8 bytes, then the arrays."""
    head = json.dumps({k: len(v) for k, v in arrays.items()}).encode() + b"\n"
    head = head[:-1] + b" " * (-len(head) % 8) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for v in arrays.values():
            f.write(v.tobytes())


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        at = len(head)
        whole = np.memmap(path, np.uint8, "r")
        for name, n in json.loads(head).items():
            setattr(self, name, whole[at : at + 8 * n].view(np.int64))
            at += 8 * n

    def find(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, -1 where it is unknown; all words walk together."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.full(len(words), self.root[0], np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(length > 0) if len(self.arc) else np.empty(0, np.int64)
        ended = np.zeros(len(words), bool)
        step = 0
        while live.size:
            key = (state[live] << 8) | flat[start[live] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            known = self.arc[at] == key
            live, at = live[known], at[known]
            state[live] = self.target[at]
            place[live] += self.number[at]
            step += 1
            over = length[live] == step
            ended[live[over]] = self.final[state[live[over]]] == 1
            live = live[~over]
        return np.where(ended, place, -1)


def frequent_words(docs: DataFrame, words: int, seen: int) -> list[str]:
    """The ``words`` most frequent words of all texts; a task reports those that it has seen ``seen`` times."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    first, *rest = text.split(" ")
                    counts.update(rest)
            if len(counts) > 400_000:
                yield frame(counts)
                counts.clear()
        yield frame(counts)

    def frame(counts: Counter) -> pd.DataFrame:
        often = [(w, n) for w, n in counts.items() if n >= seen and len(w) <= WIDE]
        return pd.DataFrame(often, columns=["word", "n"])

    found = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [" " + r.word for r in found.orderBy(F.desc("n"), "word").limit(words).collect()]


def make_lexicon(docs: DataFrame, merges: Merges, words: int = LEXICON_WORDS, seen: int = SEEN) -> str:
    """Compile the lexicon of ``docs`` and ship its file to every executor; its name there."""
    found = sorted(frequent_words(docs, words, seen), key=lambda w: w.encode("utf-8", "surrogatepass")) if words else []
    ids, length = encode_words(merges, found)
    ends = np.cumsum(length)
    arrays = compile_lexicon([w.encode("utf-8", "surrogatepass") for w in found], [ids[e - n : e] for e, n in zip(ends, length, strict=True)])
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{uuid.uuid4().hex}.bin")
    save_lexicon(arrays, path)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


# ---- texts


class Known(dict):
    """word -> number, in the order in which words are first met."""

    def __init__(self, prefix: str):
        super().__init__()
        self.prefix, self.fresh, self.base = prefix, [], 0

    def __missing__(self, word: str) -> int:
        self.fresh.append(self.prefix + word)
        number = self[word] = self.base + len(self.fresh) - 1
        return number


class Encoder:
    """Encodes batches of texts; keeps what it has found until it knows ``limit`` words."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None, limit: int = 250_000):
        self.merges, self.lexicon, self.limit = merges, lexicon, limit
        self.specials = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None
        self._forget()

    def _forget(self) -> None:
        self.spaced, self.bare = Known(" "), Known("")
        self.start, self.length, self.ids = [np.empty(0, np.int64) for _ in range(2)] + [np.empty(0, np.int32)]
        self.spaced_at, self.bare_at = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, known: Known, at: np.ndarray) -> np.ndarray:
        """Look up or merge the fresh words; ``at`` leads from a word's number to its row."""
        fresh, known.fresh = known.fresh, []
        if not fresh:
            return at
        known.base += len(fresh)
        length, parts = np.zeros(len(fresh), np.int64), []
        place = self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in fresh]) if self.lexicon else np.full(len(fresh), -1)
        got = place >= 0
        if got.any():
            length[got] = self.lexicon.start[place[got] + 1] - self.lexicon.start[place[got]]
            parts.append(self.lexicon.ids[gather(self.lexicon.start[place[got]], length[got])].astype(np.int32))
        if not got.all():
            missing = np.flatnonzero(~got)
            ids, n = encode_words(self.merges, [fresh[i] for i in missing])
            length[missing] = n
            parts.append(ids)
        start = np.zeros(len(fresh), np.int64)
        order = np.concatenate([np.flatnonzero(got), np.flatnonzero(~got)])
        start[order] = len(self.ids) + np.cumsum(length[order]) - length[order]
        at = np.concatenate([at, len(self.start) + np.arange(len(fresh))])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, *parts])
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.spaced) + len(self.bare) > self.limit:
            self._forget()
        runs: list[tuple[bool, np.ndarray]] = []
        sizes = []
        for text in texts:
            n = 0
            for part in self.specials.split(text) if self.specials and self.specials.search(text) else [text]:
                if part in self.merges.special:
                    runs.append((None, np.array([self.merges.special[part]])))
                    n += 1
                elif part:
                    if LONG_SPACE.search(part):
                        pieces = pieces_of(part)
                        runs.append((False, np.fromiter(map(self.bare.__getitem__, pieces), np.int64, len(pieces))))
                        n += 1
                    else:
                        first, *rest = part.split(" ")
                        runs.append((False, np.array([self.bare[first]] if first else [], np.int64)))
                        runs.append((True, np.fromiter(map(self.spaced.__getitem__, rest), np.int64, len(rest))))
                        n += 2
            sizes.append(n)
        self.spaced_at, self.bare_at = self._learn(self.spaced, self.spaced_at), self._learn(self.bare, self.bare_at)
        ids_of, counts = [], []
        at = 0
        for n in sizes:
            got = [runs[i][1].astype(np.int32) if runs[i][0] is None else self._ids((self.spaced_at if runs[i][0] else self.bare_at)[runs[i][1]]) for i in range(at, at + n)]
            at += n
            ids_of += got
            counts.append(sum(map(len, got)))
        return (np.concatenate(ids_of) if ids_of else np.empty(0, np.int32)), np.array(counts, np.int64)

    def _ids(self, rows: np.ndarray) -> np.ndarray:
        return self.ids[gather(self.start[rows], self.length[rows])]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decoded texts as UTF-8; bytes that are no UTF-8 become U+FFFD."""
        flat, length = self.merges.spell(ids)
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)] if len(counts) else np.empty(0, np.int64)
        out, at = [], 0
        for end in ends.tolist():
            raw = flat[at:end].tobytes()
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            out.append(raw)
            at = end
        return out


@functools.cache
def _worker_merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=1)
def _worker_encoder(path: str, lexicon: str | None) -> Encoder:
    return Encoder(_worker_merges(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def portions(texts: list[str], chars: int = CHARS) -> Iterator[slice]:
    """Runs of texts of about ``chars`` characters, one text at least."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def encode_documents(docs: DataFrame, path: str, lexicon: str | None) -> DataFrame:
    """doc_id, ids (array<int>) of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _worker_encoder(path, lexicon)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for part in portions(texts):
                ids, counts = encoder.encode(texts[part])
                yield pd.DataFrame({"ids": np.split(ids, np.cumsum(counts)[:-1])})

    return carry(docs, ["doc_id"], ["text"], "ids array<int>", run)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(_worker_merges(path), None)
        for batch in batches:
            rows = [np.asarray([] if x is None else x, np.int64) for x in batch["ids"]]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            texts = encoder.decode(np.concatenate(rows) if rows else np.empty(0, np.int64), counts)
            yield pd.DataFrame({"text": [t.decode() for t in texts]})

    return carry(encoded, ["doc_id"], ["ids"], "text string", run)


def round_trip(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded and decoded again, as digests."""
    lexicon = make_lexicon(docs, Merges(path), lexicon_words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _worker_encoder(path, lexicon)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            rows = []
            for part in portions(texts):
                ids, counts = encoder.encode(texts[part])
                for own, raw in zip(np.split(ids, np.cumsum(counts)[:-1]), encoder.decode(ids, counts), strict=True):
                    rows.append((len(own), hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return carry(docs, ["doc_id"], ["text"], "n_tokens long, ids_sha256 string, decoded_sha256 string", run)
