"""Binomial bounds, bins and other column builders."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import beta_shrunk, ladder, last, ratio, sigmoid, wilson_direction


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "up", "says"), [(40, 27, "UP"), (40, 26, "NO_SIGNAL"), (40, 13, "DOWN"), (40, 14, "NO_SIGNAL"), (50, 32, "UP"), (50, 31, "NO_SIGNAL"), (50, 18, "DOWN"), (50, 19, "NO_SIGNAL"), (39, 39, "NO_SIGNAL")])
def test_wilson_needs_enough_and_a_clear_majority(spark, n, up, says):
    direction, confidence = wilson_direction(F.lit(up), F.lit(n), 40)
    assert one(spark, direction) == says
    assert (one(spark, confidence) is None) == (says == "NO_SIGNAL")


def test_ratio_of_nothing_is_null(spark):
    assert one(spark, ratio(F.lit(0), F.lit(0))) is None
    assert one(spark, ratio(F.lit(1), F.lit(4))) == 0.25


def test_ladder_counts_reached_edges(spark):
    rows = spark.createDataFrame([(-1.0,), (2.0,), (7.9,), (8.0,), (100.0,)], "x double")
    assert [r["b"] for r in rows.select(ladder(F.col("x"), (2.0, 8.0, 20.0)).alias("b")).collect()] == [0, 1, 1, 2, 3]


def test_sigmoid_is_clamped_and_beta_pulls_to_one_half(spark):
    assert one(spark, sigmoid(F.lit(1000.0))) == pytest.approx(1 / (1 + math.exp(-60)))
    assert one(spark, beta_shrunk(F.lit(8), F.lit(8))) == 0.75


def test_last_takes_all_of_a_short_array(spark):
    assert one(spark, last(F.array(F.lit(1), F.lit(2)), 5)) == [1, 2]
    assert one(spark, last(F.array(*map(F.lit, range(9))), 3)) == [6, 7, 8]
