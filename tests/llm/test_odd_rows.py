"""What every operator does with large ids beside nulls, clashing columns, very long texts and empty tables."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DE, EN, prose
from tidemark.llm import bpe, exact_dedup, gam, langid, maxscore, mixing, ngram_join, ngram_trie, token_store, toxicity
from tidemark.llm.common import held_out

IDS = [(1 << 60) + 1, None, (1 << 60) + 3, (1 << 53) + 1, None, -(1 << 62) - 1, 5, 5]
CLASH = ["row", "node", "words", "above", "rate", "copies", "ids", "domain", "bucket", "text_hash", "key_id", "key_hash", "mixing_row", "mixing_rate", "mixing_copies", "mixing_draw", "had_text", "held", "place", "a.b", "text.x"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    texts = [prose(rng, EN if i % 2 else DE, 40) for i in range(len(IDS) - 1)]
    made = [(i, t, "en" if k % 2 else "de", (1 << 60) + 7 if k % 3 else None, {"m": k % 2}, (1, "s"), *[9] * len(CLASH)) for k, (i, t) in enumerate(zip(IDS, [*texts, texts[-1]], strict=True))]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source_id long, m map<string, int>, s struct<x: int, `y.z`: string>, " + ", ".join(f"`{c}` int" for c in CLASH)).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(IDS) if i is not None], "doc_id long, quality int, toxic int")


def mixed(docs):
    measured = mixing.measured(docs, "lang")
    domains = mixing.learn_domains(measured)
    soft = mixing.soft_members(measured, domains)
    return soft, mixing.fit(soft, domains, power=0.7)


OPERATORS = {
    "bpe": lambda s, d, _: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")),
    "bpe encode": lambda s, d, _: bpe.decode_documents(bpe.encode_documents(d, public_tokenizers.path("byte_bpe_50k.json"), None), public_tokenizers.path("byte_bpe_50k.json")),
    "join": lambda s, d, _: ngram_join.link_documents(d),
    "quality": lambda s, d, x: gam.score(d, gam.fit(d, x)),
    "exact": lambda s, d, _: exact_dedup.copy_groups(d),
    "trie": lambda s, d, _: ngram_trie.learn_and_score(d, held_out(10, 0)),
    "languages": lambda s, d, _: langid.identify(d, langid.learn(d)),
    "store": lambda s, d, _: token_store.document_checksums(s, token_store.write_store(d, public_tokenizers.path("word_bpe_49k.json"))),
    "toxicity": lambda s, d, x: toxicity.score(d, toxicity.fit(d, x)),
    "mixing": lambda s, d, _: mixing.rates(*mixed(d)),
}
FILTERS = {
    "toxicity": lambda d, x: toxicity.drop_toxic(d, toxicity.fit(d, x), reject_at=2.0),
    "exact": lambda d, _: exact_dedup.drop_copies(d),
    "join": lambda d, _: ngram_join.keep_first(d),
    "mixing": lambda d, _: mixing.mixed(d, "lang", power=0.7),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_nulls_stay_what_they_are(spark, rows, labels, name):
    got = [r["doc_id"] for r in OPERATORS[name](spark, rows, labels).collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


@pytest.mark.parametrize("name", FILTERS)
def test_whole_rows_pass_a_stage_unchanged(rows, labels, name):
    kept = FILTERS[name](rows, labels)
    assert kept.schema.simpleString() == rows.schema.simpleString()
    before = {str(r): r for r in rows.collect()}
    after = kept.collect()
    assert {str(r) for r in after} <= set(before) and len({r["text"] for r in after}) == len({r["text"] for r in before.values()})


@pytest.mark.parametrize("name", OPERATORS)
def test_a_text_of_some_megabytes(spark, rows, labels, name):
    rng = random.Random(3)
    text = prose(rng, EN, 300_000)
    docs = spark.createDataFrame([(1, text, "en"), (2, "short text", "de"), (3, "a" * 2_000_000, "en")], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in OPERATORS[name](spark, docs, labels).collect()) == [1, 2, 3]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, nothing, labels, name):
    assert OPERATORS[name](spark, nothing, labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_an_empty_table_passes_a_stage(nothing, labels, name):
    assert FILTERS[name](nothing, labels.limit(0)).count() == 0


def test_vectors_keep_large_ids(spark):
    table = spark.createDataFrame([((1 << 60), [1.0]), (None, [1.0]), ((1 << 60) + 1, [2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in maxscore.top_k(table, F.col("vec_id") == 1 << 60).collect()]
    assert got == [(1 << 60, 1, (1 << 60) + 1, 131072)]


def test_rows_are_drawn_one_by_one(spark):
    rng = random.Random(4)
    rows = [(None, prose(rng, words, 30), lang) for lang, words in (("en", EN), ("de", DE)) for _ in range(200)]
    for made in (rows, [(5, *r[1:]) for r in rows], [rows[0]] * 200 + [rows[-1]] * 200):
        docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
        halved = mixing.mixed(docs, "lang", {"en": 0.25, "de": 0.75})
        kept = [r["lang"] for r in halved.collect()]
        assert sorted(kept) == sorted(r["lang"] for r in mixing.mixed(docs.repartition(2), "lang", {"en": 0.25, "de": 0.75}).collect())
        assert 0.15 < kept.count("en") / len(kept) < 0.36


def test_labels_of_absent_documents_take_no_places(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, EN if i % 2 else DE, 30)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(i, 0, 0) for i in range(1000, 6000)], "doc_id long, quality int, toxic int")
    model = gam.fit(docs, labels, sample=60)
    got = {r["doc_id"]: r["score"] for r in gam.score(docs, model).collect()}
    assert got == {r["doc_id"]: r["score"] for r in gam.score(docs, gam.fit(docs, labels.where("doc_id < 100"), sample=60)).collect()}
    assert toxicity._labelled(docs, labels, 60).count() == 60
