"""The pipeline's stages on the smallest tables, and the queries against DuckDB where SQL can tell."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_copies import plain_components
from tidemark.llm import queries, toxicity
from tidemark.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    before, after = (x.collect() for x in seen["exact dedup"])
    best = {}
    for r in before:
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())
    before, after = (x.collect() for x in seen["near copies"])
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in plain_components([(r["doc_id"], r["text"]) for r in before])})
    before, after = (x.collect() for x in seen["mixing"])
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}
    before, after = (x.collect() for x in seen["bpe"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], hashlib.sha256(np.array(t.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in before)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in after) == want


def plain_stages(rows, model):
    """What the first three stages keep of (doc_id, text) rows, by loops: a set of texts for each stage."""
    clean = [r for r in rows if model.probabilities([r[1]])[0, 0] < toxicity.REJECT_AT]
    texts = {r[1] or "" for r in clean}
    once = [(max((r[0] for r in clean if (r[1] or "") == t), key=lambda x: -1 if x is None else x), t) for t in texts]
    numbered = [(n, t) for n, (_, t) in enumerate(sorted(once, key=lambda r: (r[0] is None, r[0] or 0)))]
    return len(clean), texts, {numbered[c][1] for _, size, c in plain_components(numbered) if size} | {t for t in texts if not t.split()}


def chained(spark, docs):
    """The result of every stage on what the one before has kept."""
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_stages_on_nulls_copies_and_clashing_columns(spark, documents):
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    n_clean, unequal, apart = plain_stages(rows, model)
    clean, exact, near, mixed, encoded = chained(spark, documents)
    assert all(d.columns == documents.columns for d in (clean, exact, near, mixed))
    assert clean.count() == n_clean
    assert sorted((r["text"] or "") for r in exact.collect()) == sorted(unequal)
    got = [(r["text"] or "") for r in near.collect()]
    assert sorted(got) == sorted(apart)
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in near.collect()}
    assert encoded.count() == mixed.count()


def test_stages_on_large_groups(spark):
    rng = random.Random(5)
    base = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(base), "en", "s") for i in range(500)]
    for i in range(500, 800):
        w = list(base)
        w[rng.randrange(80)] = f"other{i}"
        rows.append((i, " ".join(w), "en", "s"))
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(40)), "de", "s") for i in range(800, 1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    _, exact, near, _, encoded = chained(spark, docs)
    assert exact.count() == 601 and sorted(r["doc_id"] for r in near.select("doc_id").collect()) == [near.agg({"doc_id": "min"}).first()[0], *range(800, 1100)]
    assert near.where("doc_id < 800").count() == 1 and encoded.count() >= 301


def test_stages_on_an_empty_table(spark, nothing):
    assert [d.count() for d in chained(spark, nothing)] == [0] * 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = sorted(base.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
