"""MaxScore against scoring everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import maxscore


def plain(rows, k):
    use = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for n, (q, w) in enumerate(use):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for m, (i, v) in enumerate(use) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, block string").repartition(3)


@pytest.mark.parametrize(("sizes", "k"), [((4096, 4), 5), ((64, 1), 5), ((64, 2), 700)])
def test_top_k(spark, monkeypatch, sizes, k):
    monkeypatch.setattr(maxscore, "SHARD", sizes[0])
    monkeypatch.setattr(maxscore, "LANE", sizes[1])
    monkeypatch.setattr(maxscore, "CHUNK", 32)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf"), 1.0]), (1200, []), (1250, [0.5, 0.5]), (None, [1.0]), (7, [0.1] * 12), (1300, [0.0] * 12), (1350, rows[50][1]), (1351, rows[50][1])]
    got = maxscore.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k)
    assert sorted(tuple(r) for r in got.collect()) == plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k)


def test_ties_go_to_smaller_ids_and_few_rows_give_few(spark):
    rows = [(i, [1.0, 1.0]) for i in range(0, 4)]
    assert sorted(tuple(r) for r in maxscore.top_k(table(spark, rows), F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 1, 131072), (0, 2, 2, 131072), (0, 3, 3, 131072)]
    assert maxscore.top_k(table(spark, rows[:1]), F.col("vec_id") % 50 == 0).count() == 0
    assert maxscore.top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [2.0, 2.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (50, [1.0, 0.0]), (50, [3.0, 0.0]), (1 << 60, [4.0, 4.0])]
    got = sorted(tuple(r) for r in maxscore.top_k(table(spark, rows), F.col("vec_id") % 50 == 0).collect())
    assert got == plain(rows, 5) and got[0] == (0, 1, 1 << 60, 524288) and (0, 2, 1, 262144) in got


def test_large_components_are_exact(spark):
    rows = [(0, [3e9, -1.0]), (1, [3.0e9, 2.0]), (2, [2.9e9, 5e3])]
    want = plain([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5)
    if all(abs(r[3]) < 1 << 63 for r in want):
        assert sorted(tuple(r) for r in maxscore.top_k(table(spark, rows), F.col("vec_id") % 50 == 0).collect()) == want
