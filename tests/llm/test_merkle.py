"""Merkle manifest against a plain tree in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EN, prose
from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, node int, at int, `a.b` int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The last node, and for each first one the runs it stood in with its places."""
    ways, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, way in enumerate(ways):
            way.append((runs[own[k] // fanout], own[k] % fanout))
            own[k] //= fanout
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], ways


def plain(rows, fanout):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    subroots, found = {}, []
    for lang, own in trees.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots[lang], ways = climb([leaf(r) for r in own], fanout)
        found += zip(own, ways, strict=True)
    order = sorted(subroots, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = climb([subroots[x] for x in order], fanout)
    tops, out = dict(zip(order, tops, strict=True)), []
    for row, way in found:
        way = way + tops[row[2]]
        claim = row
        if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
            claim = (*row[:3], row[3] + 1, row[4])
        at = leaf(claim)
        for run, slot in way:
            at = digest("".join([*run[:slot], at, *run[slot + 1 :]]))
        proof = digest("".join("".join(run[:slot] + run[slot + 1 :]) for run, slot in way))
        out.append((row[0], leaf(row), subroots[row[2]], root, proof, at, at == root))
    return sorted(out, key=str)


def made(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["web", None]), rng.choice(["en", "en", "en", "de", "Ä", "", None]), rng.choice([None, i, -3, (1 << 63) - 1]), prose(rng, EN, 5) if i % 9 else None) for i in range(n)]
    rows += [(None, "web", "en", 3, "no id"), (None, None, None, None, None)] * 3 + [rows[0]] * 40 + [(7, "other", "en", 1, "same id")] * 2 if n > 3 else []
    return rows


@pytest.mark.parametrize(("n", "fanout", "depth"), [(150, 2, 8), (150, 2, 2), (300, 3, 1), (90, 5, 2), (2, 2, 2), (1, 2, 8)])
def test_every_proof(spark, n, fanout, depth):
    rows = made(n)
    table = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    got = merkle.audit(table, merkle.every_seventh(), fanout, depth).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, fanout)
    if n > 100:
        assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)


def test_one_row_and_one_language(spark):
    for rows in ([(1, None, "en", 5, "x")], [(i, "s", "en", 5, "x") for i in range(9)]):
        table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert sorted(map(tuple, merkle.audit(table, merkle.every_seventh()).collect()), key=str) == plain(rows, 2)


def test_any_change_is_noticed(spark):
    rows = [(i, "s", "en" if i % 2 else "de", 5, f"text {i}") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.audit(table, F.lit(True)).collect()
    assert len(got) == 20 and not any(r["verified"] for r in got)


def test_stored_preimages_are_all_parents(spark):
    rows = [(i, "s", "en" if i % 3 else None, 5, f"text {i}") for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.build(table.select(merkle.tree_of(F.col("lang")).alias("tree"), "doc_id", merkle.leaf_hash().alias("node")), 2, 3)
    stored = defaultdict(dict)
    for r in merkle.preimages(manifest).collect():
        stored[r["tree"]][r["level"], r["parent"]] = r["preimage"]
    for lang, key in ((None, "0"), ("en", "1en")):
        nodes, level = [leaf(r) for r in rows if r[2] == lang], 1
        while len(nodes) > 1:
            runs = ["".join(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            assert [stored[key].pop((level, k)) for k in range(len(runs))] == runs
            nodes, level = [digest(r) for r in runs], level + 1
        assert not stored[key]
    assert len(stored[None]) == 1


def test_empty(nothing):
    assert merkle.audit(nothing, merkle.every_seventh()).count() == 0
