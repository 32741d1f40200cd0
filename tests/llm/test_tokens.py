"""BPE round trips and the token store against the tokenizers library."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, characters, token_store
from tidemark.llm.common import carry

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("words", [0, 1000])
def test_round_trip_is_the_library_s(spark, documents, words):
    t = Tokenizer.from_file(BYTE)
    got = sorted((tuple(r) for r in bpe.round_trip(documents, BYTE, words).collect()), key=str)
    want = []
    for r in documents.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode_gives_the_text(spark, documents):
    encoded = bpe.encode_documents(documents, BYTE, None)
    texts = sorted((r["text"] or "") for r in documents.collect())
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, BYTE).collect()) == texts


def test_lexicon_is_minimal_and_finds_its_words(tmp_path):
    words = sorted({b" " + a + b for a in (b"walk", b"talk", b"w", b"stalk") for b in (b"", b"ed", b"ing", b"s")})
    ids = [np.arange(i % 3 + 1) for i in range(len(words))]
    arrays = bpe.compile_lexicon(words, ids)
    bpe.save_lexicon(arrays, str(tmp_path / "lexicon"))
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b" walke", b"", b" zzz", b"walk"]).tolist() == [-1] * 4
    assert len(arrays["final"]) < sum(map(len, words)) / 2  # suffixes are shared


def test_store_gives_back_what_the_library_encodes(spark, documents):
    t = Tokenizer.from_file(WORD)
    place = token_store.write_store(documents, WORD)
    got = token_store.document_checksums(spark, place).orderBy("start").collect()
    rows = sorted(documents.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    ids = [np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids, strict=True))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    back = {r["start"]: r["ids"] for r in token_store.read_documents(spark, place).collect()}
    assert all(len(back[r["start"]]) == r["n_tokens"] and zlib.crc32(np.array(back[r["start"]], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    chunks = spark.read.parquet(f"{place}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r["n_tokens"] > 0 for r in got) + 60


def copied(spark, place, **changed):
    """The store with some of its tables changed, as another store."""
    other = f"{place}-{'-'.join(changed)}-{uuid.uuid4().hex}"
    for part in ("chunks", "recipes"):
        (changed[part] if part in changed else spark.read.parquet(f"{place}/{part}")).write.parquet(f"{other}/{part}")
    spark.read.parquet(f"{place}/manifest/0").write.parquet(f"{other}/manifest/0")
    return other


def test_what_is_changed_or_lost_is_noticed(spark, documents):
    place = token_store.write_store(documents.limit(40), WORD)
    chunks, recipes = spark.read.parquet(f"{place}/chunks"), spark.read.parquet(f"{place}/recipes")
    some = chunks.orderBy("digest").first()["digest"]
    forged = chunks.withColumn("ids", F.when(F.col("digest") == some, F.concat("ids", F.unhex(F.lit("0000")))).otherwise(F.col("ids")))
    swapped = recipes.withColumn("doc_id", F.when(F.col("place") == 3, F.lit(4)).when(F.col("place") == 4, F.lit(3)).otherwise(F.col("doc_id")))
    other = recipes.where("place = 5").first()
    replaced = recipes.withColumn("digests", F.when(F.col("place") == 6, F.array(*map(F.lit, map(bytes, other["digests"])))).otherwise(F.col("digests")))
    bad = [{"chunks": forged}, {"chunks": chunks.where(F.col("digest") != some)}, {"recipes": recipes.where("place <> 7")}, {"recipes": recipes.where("place < 20")}, {"recipes": swapped}, {"recipes": replaced}]
    for changed in bad:
        for read in (token_store.document_checksums, token_store.read_documents):
            with pytest.raises(Exception, match="isn't what|aren't what|is missing"):
                read(spark, copied(spark, place, **changed)).collect()
    assert token_store.read_documents(spark, copied(spark, place, recipes=recipes)).count() == recipes.count()


def test_chunks_follow_the_content():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 40_000, 3000)
    a, b = np.concatenate([rng.integers(0, 40_000, 100), shared]), np.concatenate([rng.integers(0, 40_000, 333), shared])
    cut = lambda x: {x[s:e].tobytes() for s, e in zip([0, *places], places, strict=False)} if (places := next(token_store.cut_places(x, np.array([len(x)])))) else set()
    assert len(cut(a) & cut(b)) >= 5
    sizes = np.diff([0, *next(token_store.cut_places(a, np.array([len(a)])))])
    assert sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()


def test_no_documents(spark, nothing):
    assert bpe.round_trip(nothing, BYTE).count() == 0
    assert token_store.document_checksums(spark, token_store.write_store(nothing, WORD)).count() == 0


def every_character():
    return [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]


def test_classes_are_the_library_s_on_every_character():
    library = Tokenizer.from_file(BYTE).pre_tokenizer
    letter, number = (regex.compile("(?V1)" + x) for x in (characters.LETTER, characters.NUMBER))
    known, rest = [], []
    for c in every_character():
        (known if letter.match(chr(c)) or number.match(chr(c)) else rest).append(c)
    space = regex.compile(f"[{bpe.SPACE}]")
    # what is neither letter, number nor space is one piece, whatever there is of it
    others = "".join(chr(c) for c in rest if not space.match(chr(c)) and chr(c) != "'")
    assert len(library.pre_tokenize_str(others)) == 1
    for probe, one in (("x", letter), ("1", number)):
        for at in range(0, len(known), 20_000):
            part = known[at : at + 20_000]
            starts = {a for _, (a, _) in library.pre_tokenize_str("".join("\n" + probe + chr(c) for c in part))}
            assert [c for i, c in enumerate(part) if (3 * i + 2 not in starts) != bool(one.match(chr(c)))] == []
    old = [c for c in every_character() if chr(c) < characters.OLD]
    assert all(max(chr(c).encode()) >= characters.OLD_BYTE for c in every_character() if chr(c) >= characters.OLD)
    assert all(bool(regex.match(p, chr(c))) == bool(q.match(chr(c))) for c in old for p, q in ((r"\p{L}", letter), (r"\p{N}", number)))


def test_normalised_text_is_the_library_s_on_every_character():
    library = Tokenizer.from_file(WORD).normalizer
    for probe in ("{}", "a{}\u0334", "\u0344{}", "Σ{}"):
        chars = [c for c in every_character() if not chr(c).isspace()]
        lines = [probe.format(chr(c)) for c in chars]
        assert [hex(c) for c, a, b in zip(chars, map(token_store.normalized, lines), library.normalize_str(" ".join(lines)).split(" "), strict=True) if a != b] == []


def test_texts_of_mixed_scripts_are_the_library_s():
    rng = random.Random(11)
    odd = [c for a, b in characters.NEITHER for c in (a, b)] + [0x1C89, 0xA7CB, 0xA7DC, 0x10D50, 0x16EA0, 0x7FD, 0x898, 0x1DF7, 0x345, 0x323, 0x301, 0x3A3, 0x130, 0x1E9E, 0x23A, 0x212A, 0x2028, 0x85, 0xA0, 0x3000]
    texts = []
    for _ in range(20_000):
        n = rng.randrange(1, 9)
        texts.append("".join(rng.choice([" ", "a", "B", "'s", "7", "é", chr(rng.choice(odd)), chr(rng.randrange(0x20, 0x600)), chr(rng.choice([rng.randrange(0x600, 0xD800), rng.randrange(0xE000, 0x20000)]))]) for _ in range(n)))
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    ids, length = bpe.Encoder(bpe.Merges(BYTE), None).encode(texts)
    ends = np.cumsum(length)
    assert [t for t, a, b, w in zip(texts, ends - length, ends, byte.encode_batch(texts, add_special_tokens=False), strict=True) if ids[a:b].tolist() != w.ids] == []
    ids, length = token_store.WordEncoder(WORD).encode(texts)
    ends = np.cumsum(length)
    assert [t for t, a, b, w in zip(texts, ends - length, ends, word.encode_batch(texts, add_special_tokens=False), strict=True) if ids[a:b].tolist() != w.ids] == []


def test_pieces_that_recur_are_merged_once():
    """However many other pieces are met, and whatever stands around a piece or its case, it stays known while it recurs."""
    encoder, word, rng = token_store.WordEncoder(WORD, limit=1000), Tokenizer.from_file(WORD), random.Random(2)
    plain, merged = encoder.merges.merge, []
    encoder.merges.merge = lambda pieces: (merged.extend(pieces), plain(pieces))[1]
    for _ in range(60):
        others = ["".join(rng.choice("abcdéßж日'") for _ in range(rng.randrange(4, 30))) for _ in range(100)]
        texts = ["Commonly, it's <|endoftext|> found", " ".join(others), None, "(commonly) FOUND: internationalisation", "", "İ \x00 \x00\x00'll've"]
        ids, length = encoder.encode(texts)
        ends = np.cumsum(length)
        assert [ids[a:b].tolist() for a, b in zip(ends - length, ends, strict=True)] == [x.ids for x in word.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [merged.count(p) for p in (b"commonly", b"found", b"internationalisation")] == [1, 1, 1] and encoder.known < 2000


def test_more_pieces_than_the_table_had_room_for():
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(0xE0 + k // 17_576)}" for k in range(90_000))]
    encoder = token_store.WordEncoder(WORD)
    want = Tokenizer.from_file(WORD).encode(texts[0], add_special_tokens=False).ids
    for limit in (1_000_000, 10):
        encoder.limit = limit
        assert encoder.encode(texts)[0].tolist() == want


def test_columns_carried_beside_arrow_tables(spark):
    """What a task gives as Arrow tables, cut as it likes, stands beside the rows that it was made of."""

    def run(batches):
        for batch in batches:
            words = [t.split() for t in batch["text"]]
            for at in range(0, len(words), 3):
                yield pa.table({"words": pa.array(words[at : at + 3], pa.list_(pa.binary()))})

    docs = spark.range(20).selectExpr("id AS doc_id", "concat('a', id, ' b') AS text").coalesce(1)
    got = carry(docs, ["doc_id"], ["text"], "words array<binary>", run).collect()
    assert sorted((r["doc_id"], [bytes(w) for w in r["words"]]) for r in got) == [(i, [b"a%d" % i, b"b"]) for i in range(20)]
