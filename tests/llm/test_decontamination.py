"""Wu-Manber search against looking at every window."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import EN, prose
from tidemark.llm import queries, wumanber

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if found := wanted.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    held |= found
        out.append((doc, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, EN, rng.randrange(10, 40))) for i in range(30)] + [(40, "of the and"), (41, "Größe"), (42, "on by at on by at on by at on by at on by at"), (None, "which were are"), (43, None), (44, " .;"), (45, "")]
    items += [(3, items[3][1]), (3, "another text with the id three and ten words in it"), (46, items[5][1]), (47, items[5][1].upper())]
    docs = [(i, prose(rng, EN, rng.randrange(1, 90))) for i in range(80)]
    for i in range(80, 140):
        w = words(rng.choice(items[:30])[1])
        a = rng.randrange(max(1, len(w) - 12))
        part = w[a : a + rng.choice([8, 9, 10, 11, 25])]
        docs.append((i, prose(rng, EN, 7) + rng.choice([" ", "-", "\n"]) + rng.choice(["; ", " ", "\t"]).join(part).upper() + " " + prose(rng, EN, 7)))
    docs += [(200, None), (201, ""), (202, "of the"), (203, "Of, the!\x00and GRÖSSE größe"), (204, "on by at " * 40), docs[90], docs[90], (None, docs[91][1]), (205, "x" * 5000), (206, "of the andé of the and1 of the and")]
    return docs, items


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "c", 1, 2) for r in docs], "doc_id long, text string, items string, n_words int, `a.b` int").repartition(3)
    b = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, id string")
    return sorted((tuple(r) for r in wumanber.report(d, b, **more).collect()), key=str)


@pytest.mark.parametrize("window", [10, 3, 1])
def test_against_every_window(spark, window):
    docs, items = made(window)
    assert run(spark, docs, items, window=window) == plain(docs, items, window)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, items = made(4)
    monkeypatch.setattr(wumanber, "BLOCK_BYTES", 900)
    assert run(spark, docs, items) == plain(docs, items)


def test_clashing_hashes_change_nothing(spark, monkeypatch):
    docs, items = made(5)
    real = wumanber.word_hashes

    def poor(raw, starts):
        hashes, first = real(raw, starts)
        return hashes % np.uint64(7), first

    monkeypatch.setattr(wumanber, "word_hashes", poor)
    block = wumanber.Benchmark.of(["" if i is None else str(i) for i, _ in items], [t for _, t in items])
    got = [(d, n, sum(s["stop"] - s["start"] for s in spans), len(held)) for (d, _), (n, spans, held) in zip(docs, block.find([t for _, t in docs]), strict=True)]
    assert sorted(got, key=str) == [r[:4] for r in plain(docs, items)]


def test_long_texts_and_small_portions(spark, monkeypatch):
    monkeypatch.setattr(wumanber, "PORTION", 50)
    monkeypatch.setattr(wumanber, "CHUNK", 3000)
    rng = random.Random(9)
    items = [(1, prose(rng, EN, 30)), (2, "many words that nobody has ever said in one text before today")]
    docs = [(1, (prose(rng, EN, 500) + " " + items[0][1] + " ") * 20), (2, items[1][1]), (3, prose(rng, EN, 20_000))]
    assert run(spark, docs, items) == plain(docs, items)


def test_filter_keeps_whole_rows(spark):
    docs, items = made(6)
    d = spark.createDataFrame([(*r, "c", 1, 2) for r in docs], "doc_id long, text string, items string, n_words int, `a.b` int")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = wumanber.drop_contaminated(d, b)
    assert kept.schema.simpleString() == d.schema.simpleString()
    clean = [r[0] for r in plain(docs, items) if not r[5]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)
    some = wumanber.drop_contaminated(d.select("doc_id", "text"), b, most=0.5)
    assert sorted((r["doc_id"] for r in some.collect()), key=str) == sorted((r[0] for r in plain(docs, items) if r[2] <= 0.5 * r[1]), key=str)


def test_empty_tables(spark, nothing):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert wumanber.report(nothing, items).count() == 0
    assert [tuple(r)[:4] for r in wumanber.report(nothing.sparkSession.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).collect()] == [(1, 2, 0, 0)]


def test_query_equals_its_sql_over_documents_and_benchmark(spark):
    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = queries.QUERIES["op12_wumanber"](spark, folder)
    columns = sorted(got.columns)
    want = sorted(base.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op12_wumanber']})").fetchall())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want and any(r[columns.index("n_hit")] for r in want)
