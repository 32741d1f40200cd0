"""Whitening against the covariance in plain numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening


def plain(rows, k=16):
    """n, deviations and whitened vectors by id, shares of the variance; from a covariance of exactly centred rows."""
    use = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in use})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, sums, strict=True)] for x in distinct])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:k]
    values, vectors = values[order], vectors[:, order]
    out = []
    for i, x in use:
        d = [n * a - b for a, b in zip(x, sums, strict=True)]
        out.append((i, sum(q * q for q in d), np.array(d, float) / n @ vectors / np.sqrt(np.maximum(values, 1e-300))))
    return n, out, values / np.trace(covariance)


def table(spark, rows, kind="float", parts=3):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, _x int, w string, `a.b` int").repartition(parts)


def check(spark, rows, kind="float", parts=3, components=16):
    if kind == "float":
        rows = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    n, want, shares = plain(rows, components)
    got = whitening.whitened(table(spark, rows, kind, parts), components).collect()
    k = min(components, len(shares))
    assert len(got) == len(want) * k
    own = {}
    for r in got:
        own.setdefault((r["vec_id"], r["deviation_text"]), {}).setdefault(r["component"], []).append(r)
    signs = np.zeros(k)
    for i, deviation, w in want:
        found = own[i, str(deviation)]
        assert sorted(found) == list(range(1, k + 1))
        for c in range(k):
            r = found[c + 1][0]
            assert r["n"] == n and r["deviation"] == (deviation if deviation < 1 << 63 else None)
            assert abs(r["explained"] - shares[c]) <= 1e-9 * shares[c] + 1e-15 and r["identity_error"] < 1e-9
            if abs(w[c]) > 0.3:
                signs[c] = signs[c] or np.sign(w[c] * r["whitened"])
    for i, deviation, w in want:
        for c in range(k):
            assert signs[c] * own[i, str(deviation)][c + 1][0]["whitened"] == pytest.approx(w[c], abs=1e-6)
    return got


def vectors(n, d, seed=1, scale=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(k, scale * (k + 1)) for k in range(d)] for _ in range(n)]


def test_odd_rows(spark):
    rows = list(enumerate(vectors(300, 6)))
    rows += [(1000, None), (1001, [1.0, None, 1, 1, 1, 1]), (1002, [float("nan")] * 6), (1003, [float("inf")] + [1.0] * 5), (1004, []), (None, [0.5] * 6), (5, [1.5] * 6), ((1 << 60) + 1, [2.0] * 6)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)]
    got = check(spark, rows)
    assert {r["vec_id"] for r in got} >= {None, (1 << 60) + 1} and not {r["vec_id"] for r in got} & set(range(1000, 1005))


def test_more_dimensions_than_components_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "ROWS", 7)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a partition for each file
    try:
        check(spark, list(enumerate(vectors(700, 20))), "double", 13)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_whitened_columns_are_uncorrelated(spark):
    rows = list(enumerate(vectors(500, 9, seed=3)))
    got = whitening.whitened(table(spark, rows, "double")).collect()
    w = np.zeros((500, 9))
    for r in got:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / 500 - np.eye(9)).max() < 1e-9


def test_exact_sums_where_doubles_are_not(spark):
    rng = random.Random(4)
    rows = [(i, [1e9 + rng.random(), rng.gauss(0, 1)]) for i in range(200)]
    check(spark, rows, "double")
    far = [(i, [(i - 100) * 3e11, float(i % 7)]) for i in range(200)]
    check(spark, far, "double")  # the deviation needs more than 64 bits


def test_no_variance(spark):
    got = whitening.whitened(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, 0.0) for r in got)
    flat = whitening.whitened(table(spark, [(i, [float(i), 1.0]) for i in range(50)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)} and max(r["identity_error"] for r in flat) < 1e-9


def test_other_lengths_and_far_entries_take_no_part(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(20)] + [(100, [1.0]), (101, [1.0, 2.0, 3.0]), (102, [1e30, 0.0])]
    assert {r["vec_id"] for r in whitening.whitened(table(spark, rows, "double")).collect()} == set(range(20))


def test_empty(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None)])).columns == whitening.whitened(table(spark, [(1, [1.0])])).columns
