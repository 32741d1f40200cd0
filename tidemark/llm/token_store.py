"""Token ids in a content-addressed store.

Each document's ids, closed by an end id, are cut into chunks where a rolling hash of the last ``WINDOW``
ids has ``CUT_BITS`` low bits at zero, but not before ``LEAST`` and not after ``MOST`` ids, so equal
passages give equal chunks wherever they stand. The store is a folder with three Parquet tables:

* ``chunks`` (digest, n, ids): every distinct chunk once, ids as little-endian unsigned numbers of 16 bits
  where the vocabulary allows it, else of 32;
* ``recipes`` (place, doc_id, start, n_tokens, root, digests): in ascending doc_id order, how each document
  is put together; root is the SHA-256 of the digests;
* ``manifest`` (level, block, root): the Merkle tree over the recipes, ``FANOUT`` children a node; a leaf is the
  SHA-256 of a recipe's place, doc_id, start, n_tokens and root.

Both ways of reading first build the tree again from the recipes and hold every level against the manifest, then check
every chunk against its digest, every document against its root, and that no chunk is missing. CRC-32 is linear, so
the checksum of a document follows from those of its chunks and no chunk has to move to its documents;
:func:`read_documents` does put the ids together.

Defined results: a null or empty text is the end id alone; a null doc_id comes before all others; rows
repeated with one doc_id are documents of their own, in the order in which they were written; special
tokens' strings become their ids, as in the tokenizers library; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import SPACE, Merges, gather, portions
from tidemark.llm.characters import LETTER, NUMBER, OLD_BYTE, composed, lower, lower_old
from tidemark.llm.common import carry, mix, shared_folder

WINDOW, CUT_BITS, LEAST, MOST = 8, 8, 64, 1024
FANOUT = 1024
SEEN = 200_000  # digests that a task remembers so as not to pass on a chunk twice

# The tokenizer cuts a normalised text by 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+; so a piece is a run of one
# kind, a number alone, or an apostrophe that stands alone with the ending after it.
GAP, LETTERS, NUMERAL, OTHERS, SPECIAL, LEAD, TRAIL = range(7)
ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")
WORD_END = "</w>"
SHORT = 15  # bytes of a piece that, with its length, are two 64-bit numbers

_ODD = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def normalized(text: str) -> str:
    """NFC and lower case, character by character."""
    return lower(composed(text))


def prepared(text: str) -> bytes:
    """The normalised text in UTF-8."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) == len(text):
        return raw.lower()
    if np.frombuffer(raw, np.uint8).max() < OLD_BYTE and unicodedata.normalize("NFC", text) == text:
        return lower_old(text).encode()
    return normalized(text).encode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=1)
def _kind_of_characters() -> np.ndarray:
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(0x110000, OTHERS, np.uint8)
    for kind, pattern in ((GAP, f"[{SPACE}]"), (LETTERS, LETTER), (NUMERAL, NUMBER)):
        for hit in regex.finditer(f"(?V1){pattern}+", every):
            kinds[hit.start() : hit.end()] = kind
    return kinds


@functools.lru_cache(maxsize=1)
def _kind_of_bytes() -> np.ndarray:
    kinds = np.full(256, SPECIAL, np.uint8)
    kinds[:0x80], kinds[0x80:0xC0], kinds[0xC0:0xF8] = _kind_of_characters()[:0x80], TRAIL, LEAD
    return kinds


def cut_pieces(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece starts in the bytes of normalised texts, and its length; the bytes end with white space.

    Bytes from 0xF8 on, which no UTF-8 has, stand for special tokens, 0xFF first.
    """
    kind = _kind_of_bytes()[flat]
    leads = np.flatnonzero(kind == LEAD)
    for size, least in ((2, 0xC0), (3, 0xE0), (4, 0xF0)) if leads.size else ():
        at = leads[flat[leads] >> (7 - size) == least >> (7 - size)]
        code = (flat[at] & (0xFF >> (size + 1))).astype(np.int64)
        for k in range(1, size):
            code = (code << 6) | (flat[at + k] & 0x3F)
        own = _kind_of_characters()[code]
        for k in range(size):
            kind[at + k] = own
    starts = np.ones(len(flat), bool)
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    numerals = np.flatnonzero(kind == NUMERAL)
    starts[numerals[flat[numerals] & 0xC0 != 0x80]] = True
    starts[np.flatnonzero(flat == 0xFF)] = True
    quotes = np.flatnonzero(flat == ord("'"))
    quotes = quotes[starts[quotes] & starts[quotes + 1]]
    ending = np.zeros(len(quotes), np.int64)
    for known in ENDINGS:
        fits = flat[quotes + 1] == known[0]
        ending[fits & (flat[np.minimum(quotes + 2, len(flat) - 1)] == known[1]) if len(known) == 2 else fits] = len(known)
    quotes, ending = quotes[ending > 0], ending[ending > 0]
    starts[quotes + 1] = False
    starts[quotes + 1 + ending] = True
    start = np.flatnonzero(starts)
    length = np.diff(start, append=len(flat))
    piece = kind[start] != GAP
    return start[piece], length[piece]


class PieceTable:
    """Open table of pieces of up to ``SHORT`` bytes by (low, high), their bytes and length as two numbers; no two are alike."""

    def __init__(self):
        self.count = 0
        self._empty(1 << 16)

    def _empty(self, slots: int) -> None:
        self.low, self.high, self.row = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (mixed >> np.uint64(65 - len(self.low).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 where it is unknown."""
        slot = self._slot(low, high)
        there = self.high[slot]
        hit = (there == high) & (self.low[slot] == low)
        out = np.where(hit, self.row[slot], -1)
        rest = np.flatnonzero(~hit & (there != 0))
        while rest.size:
            slot[rest] = (slot[rest] + 1) & (len(self.low) - 1)
            at = slot[rest]
            there = self.high[at]
            hit = (there == high[rest]) & (self.low[at] == low[rest])
            out[rest[hit]] = self.row[at[hit]]
            rest = rest[~hit & (there != 0)]
        return out

    def numbers(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each of the first ``rows`` rows, 0 for those that aren't in the table."""
        used, low, high = np.flatnonzero(self.high), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        low[self.row[used]], high[self.row[used]] = self.low[used], self.high[used]
        return low, high

    def add(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> None:
        """Distinct pieces that the table lacks."""
        self.count += len(low)
        if 2 * self.count > len(self.low):
            used = self.high != 0
            low, high, rows = (np.concatenate([old[used], new]) for old, new in ((self.low, low), (self.high, high), (self.row, rows)))
            self._empty(1 << (4 * self.count - 1).bit_length())
        slot = self._slot(low, high)
        rest = np.arange(len(low))
        while rest.size:
            at = slot[rest]
            free = rest[self.high[at] == 0]
            self.row[slot[free]] = rows[free]  # of those that meet in a slot, one stays
            won = free[self.row[slot[free]] == rows[free]]
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            placed = np.zeros(len(low), bool)
            placed[won] = True
            rest = rest[~placed[rest]]
            slot[rest] = (slot[rest] + 1) & (len(self.low) - 1)


class WordEncoder:
    """Encodes many texts together: they are cut at once, and each piece is looked up, or merged once for as long as it is known.

    Beyond ``limit`` pieces those that were met only where they were learnt are forgotten, or all where the others are too many.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.merges, self.limit = Merges(path, WORD_END), limit
        self.specials = regex.compile("|".join(map(regex.escape, self.merges.special)))
        # a special token is told by bytes that no text has
        self.marks = {token: b"\xff" + bytes(0xF8 + int(d) for d in np.base_repr(k, 7)) for k, token in enumerate(self.merges.special)}
        self.forget()

    def forget(self) -> None:
        self.table, self.long = PieceTable(), {}
        self.known = self.used = 0
        self.start, self.length, self.ids, self.again = np.empty(1024, np.int64), np.empty(1024, np.int32), np.empty(4096, np.int32), np.zeros(1024, bool)
        size = np.array([*map(len, self.marks.values())], np.int64)
        numbers = _as_numbers(b"".join([*self.marks.values(), bytes(2 * 8)]), np.cumsum(size) - size, size)
        self._learn([*self.marks.values()], *numbers, np.array([*self.merges.special.values()], np.int32), np.ones(len(size), np.int64))

    def _forget_rare(self) -> None:
        self.again[: len(self.marks)] = False  # they are learnt anew
        rows = np.flatnonzero(self.again[: self.known])
        low, high = self.table.numbers(self.known)
        long = {row: piece for piece, row in self.long.items()}
        start, length, ids = self.start[rows], self.length[rows], self.ids
        self.forget()
        if 2 * len(rows) <= self.limit:
            self._learn([long.get(row, b"") for row in rows.tolist()], low[rows], high[rows], ids[gather(start, length)], length)

    def _bytes_of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return prepared(text)
        out, at = [], 0
        for hit in self.specials.finditer(text):
            out += [prepared(text[at : hit.start()]), self.marks[hit[0]]]
            at = hit.end()
        return b"".join([*out, prepared(text[at:])])

    def _learn(self, fresh: list[bytes], low: np.ndarray, high: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Distinct pieces that aren't known, with their ids."""
        known, used = self.known + len(fresh), self.used + len(ids)
        self.start, self.length, self.ids, self.again = _room(self.start, known), _room(self.length, known), _room(self.ids, used), _room(self.again, known)
        self.start[self.known : known], self.length[self.known : known] = self.used + np.cumsum(length) - length, length
        self.ids[self.used : used], self.again[self.known : known] = ids, False
        rows = np.arange(self.known, known, dtype=np.int32)
        short = high != 0
        self.table.add(low[short], high[short], rows[short])
        self.long.update((fresh[i], int(rows[i])) for i in np.flatnonzero(~short).tolist())
        self.known, self.used = known, used

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if self.known > self.limit:
            self._forget_rare()
        held = [self._bytes_of(t) for t in texts]
        raw = b"\n".join([*held, b"\n" * (2 * 8)])
        start, size = cut_pieces(np.frombuffer(raw, np.uint8))
        low, high = _as_numbers(raw, start, size)
        rows = self.table.find(low, high)
        long = np.flatnonzero(high == 0)
        rows[long] = [self.long.get(raw[a:b], -1) for a, b in zip(start[long].tolist(), (start[long] + size[long]).tolist(), strict=True)]
        lacking = np.flatnonzero(rows < 0)
        self.again[rows[rows >= 0]] = True
        if lacking.size:
            pieces = [raw[a:b] for a, b in zip(start[lacking].tolist(), (start[lacking] + size[lacking]).tolist(), strict=True)]
            fresh: dict[bytes, int] = {}
            rows[lacking] = [self.known + fresh.setdefault(p, len(fresh)) for p in pieces]
            first = np.empty(len(fresh), np.int64)
            first[rows[lacking][::-1] - self.known] = lacking[::-1]
            self._learn(list(fresh), low[first], high[first], *self.merges.merge(list(fresh)))
        length = self.length[rows]
        counts = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        ends = np.searchsorted(start, np.cumsum([len(h) + 1 for h in held]))
        return self.ids[gather(self.start[rows], length)], np.diff(counts[ends], prepend=0)


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` values at least."""
    return array if n <= len(array) else np.concatenate([array, np.empty(max(n, 2 * len(array)) - len(array), array.dtype)])


_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)  # the first n bytes of a little-endian number


def _as_numbers(raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and length of each piece as two numbers; the second is 0 where the piece is longer than ``SHORT``."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    short = size <= SHORT
    low = eight[start] & _FIRST[np.minimum(size, 8)]
    high = eight[np.minimum(start + 8, len(eight) - 1)] & _FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    return low, np.where(short, high, np.uint64(0))


@functools.lru_cache(maxsize=1)
def _worker_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_places(ids: np.ndarray, ends: np.ndarray) -> Iterator[list[int]]:
    """For each document, given where it ends among all ids, the ends of its chunks."""
    total = np.zeros(len(ids), np.uint64)
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    for back in range(min(WINDOW, len(ids))):
        total[back:] += spread[: len(ids) - back] * _ODD[back]
    marks = np.flatnonzero(mix(total) & np.uint64((1 << CUT_BITS) - 1) == 0) + 1
    at, start = 0, 0
    found = marks.tolist()
    for end in ends.tolist():
        places: list[int] = []
        while start < end:
            while at < len(found) and found[at] < start + LEAST:
                at += 1
            stop = min(found[at] if at < len(found) else end, start + MOST, end)
            places.append(stop)
            start = stop
        yield places


def stage_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """row, doc_id, n_tokens, digests, parts of every document; a part is null where its task has passed it on before."""
    small = Merges(path, WORD_END).spelt_length.size <= 1 << 16

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.Table]:
        encoder, seen = _worker_encoder(path), set()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in portions([t or "" for t in texts]):
                ids, counts = encoder.encode(texts[part])
                ends = np.cumsum(counts + 1)
                closed = np.full(int(ends[-1]), end_id, np.int32)
                inside = np.ones(len(closed), bool)
                inside[ends - 1] = False
                closed[inside] = ids
                raw, width = (closed.astype("<u2").tobytes(), 2) if small else (closed.astype("<u4").tobytes(), 4)
                digests, parts, sizes = [], [], [0]
                start = 0
                for places in cut_places(closed, ends):
                    for stop in places:
                        piece = raw[start * width : stop * width]
                        digest = hashlib.blake2b(piece, digest_size=16).digest()
                        digests.append(digest)
                        parts.append(None if digest in seen else piece)
                        seen.add(digest)
                        start = stop
                    sizes.append(len(digests))
                if len(seen) > SEEN:
                    seen.clear()
                edges = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.binary())) for x in (digests, parts)]
                yield pa.Table.from_arrays([pa.array(counts + 1, pa.int64()), *lists], ["n_tokens", "digests", "parts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return carry(rows, ["row", "doc_id"], ["text"], "n_tokens long, digests array<binary>, parts array<binary>", run)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _root(hexes: Column) -> Column:
    return F.sha2(F.array_join(hexes, ""), 256)


def write_store(docs: DataFrame, path: str, end_id: int = 2) -> str:
    """Write the store of ``docs`` (doc_id, text) into a new folder of the shared one; its place."""
    place = f"{shared_folder(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    staged = _written(stage_documents(docs, path, end_id), f"{place}/staged")
    small = Merges(path, WORD_END).spelt_length.size <= 1 << 16
    pieces = staged.select(F.explode(F.arrays_zip("digests", "parts")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.parts").alias("ids"))
    chunks = pieces.where(F.col("ids").isNotNull()).groupBy("digest").agg(F.first("ids").alias("ids"))
    _written(chunks.select("digest", (F.octet_length("ids") / (2 if small else 4)).cast("int").alias("n"), "ids"), f"{place}/chunks")
    # ascending order: ranges of doc_id, then running sums inside each and over the ranges' totals
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ranged = _written(staged.drop("parts").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), f"{place}/ranged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = ranged.groupBy("range").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    totals = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("docs_before"))
    inside = Window.partitionBy("range").orderBy(*order)
    recipes = ranged.join(F.broadcast(totals), "range").select(
        (F.col("docs_before") + F.row_number().over(inside) - 1).alias("place"),
        "doc_id",
        (F.col("ids_before") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"),
        "n_tokens",
        _root(F.transform("digests", lambda d: F.lower(F.hex(d)))).alias("root"),
        "digests",
    )
    written = _written(recipes, f"{place}/recipes")
    for number, level in enumerate(_levels(written)):
        _written(level, f"{place}/manifest/{number}")
    return place


def _levels(recipes: DataFrame) -> Iterator[DataFrame]:
    """The levels (level, block, root) of the Merkle tree over the recipes, from the leaves' parents to the one root."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("place", "doc_id", "start", "n_tokens", "root")]
    last = recipes.agg(F.max("place")).first()[0] or 0
    level = recipes.select(F.col("place").alias("block"), F.sha2(F.concat_ws(" ", *fields), 256).alias("root"))
    number = 0
    while True:
        children = F.sort_array(F.collect_list(F.struct("block", "root")))  # FANOUT at most
        level = level.groupBy(F.floor(F.col("block") / FANOUT).alias("parent")).agg(children.alias("children"))
        level = level.select(F.lit(number).alias("level"), F.col("parent").alias("block"), _root(F.col("children.root")).alias("root"))
        yield level
        last //= FANOUT
        if not last:
            return
        level = level.select("block", "root")
        number += 1


def checked_recipes(spark: SparkSession, place: str) -> DataFrame:
    """The recipes, after the tree built from them has been held against the manifest; a difference is an error."""
    recipes = spark.read.parquet(f"{place}/recipes")
    for number, level in enumerate(_levels(recipes)):
        kept = spark.read.parquet(f"{place}/manifest/{number}").select("block", F.col("root").alias("kept"))
        if not level.join(kept, "block", "full").where("NOT root <=> kept").isEmpty():
            raise ValueError(f"the recipes of {place} aren't what its manifest says at level {number}")
    return recipes


def checked_chunks(spark: SparkSession, place: str) -> DataFrame:
    """digest, n, crc (CRC-32 of the ids as 32-bit numbers) of every chunk, and ids; a chunk that isn't what its digest says is an error."""
    chunks = spark.read.parquet(f"{place}/chunks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crcs = []
            for digest, n, raw in zip(batch["digest"], batch["n"], batch["ids"], strict=True):
                if hashlib.blake2b(raw, digest_size=16).digest() != digest:
                    raise ValueError(f"a chunk of {place} isn't what its digest says")
                crcs.append(zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw))
            yield batch[["digest", "n"]].assign(crc=crcs)

    return chunks.mapInPandas(run, "digest binary, n int, crc long")


def document_checksums(spark: SparkSession, place: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the store."""
    recipes = checked_recipes(spark, place)
    own = ["place", "doc_id", "start", "n_tokens", "root"]
    used = recipes.select(*own, F.posexplode("digests").alias("at", "digest")).join(checked_chunks(spark, place), "digest", "left")
    parts = used.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc", "digest"))).alias("parts"))
    parts = parts.select(*own, F.col("parts.n").alias("n"), F.col("parts.crc").alias("crc"), _root(F.transform("parts.digest", lambda d: F.lower(F.hex(d)))).alias("seen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zeros, shift = b"\0" * (4 * MOST), {}
        for batch in batches:
            if (batch["root"] != batch["seen"]).any():
                raise ValueError(f"a document of {place} isn't what its root says")
            crcs = []
            for sizes, own_crcs in zip(batch["n"], batch["crc"], strict=True):
                total = 0
                for n, crc in zip(sizes.tolist(), own_crcs.tolist(), strict=True):
                    if n != n:
                        raise ValueError(f"a chunk of {place} is missing")
                    n, crc = int(n), int(crc)
                    if n not in shift:
                        shift[n] = zlib.crc32(zeros[: 4 * n])
                    total = zlib.crc32(zeros[: 4 * n], total) ^ shift[n] ^ crc  # linear: the shifted first part and the second
                crcs.append(total)
            yield pd.DataFrame({"ids_crc32": crcs})

    return carry(parts, ["doc_id", "start", "n_tokens"], ["root", "seen", "n", "crc"], "ids_crc32 long", run)


def read_documents(spark: SparkSession, place: str) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document, put together from the chunks."""
    recipes = checked_recipes(spark, place)
    own = ["place", "doc_id", "start", "n_tokens", "root"]
    used = recipes.select(*own, F.posexplode("digests").alias("at", "digest")).join(spark.read.parquet(f"{place}/chunks"), "digest", "left")
    parts = used.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("at", "ids", "digest"))).alias("parts"))
    parts = parts.select(*own, F.col("parts.ids").alias("parts"), F.col("parts.digest").alias("digests"), _root(F.transform("parts.digest", lambda d: F.lower(F.hex(d)))).alias("seen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if (batch["root"] != batch["seen"]).any():
                raise ValueError(f"a document of {place} isn't what its root says")
            found = []
            for pieces, digests, n in zip(batch["parts"], batch["digests"], batch["n_tokens"], strict=True):
                for raw, digest in zip(pieces, digests, strict=True):
                    if raw is None or hashlib.blake2b(raw, digest_size=16).digest() != digest:
                        raise ValueError(f"a chunk of {place} is missing or isn't what its digest says")
                whole = b"".join(pieces)
                found.append(np.frombuffer(whole, "<u2" if len(whole) == 2 * n else "<u4").astype(np.int32))
            yield pd.DataFrame({"ids": found})

    return carry(parts, ["doc_id", "start"], ["root", "seen", "parts", "digests", "n_tokens"], "ids array<int>", run)
