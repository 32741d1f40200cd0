"""Queries where very many ticks come shortly after each other."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.operators import engines, shell
from tidemark.plans import oracles, queries

TICK = "symbol string, us bigint, event_id bigint, price double"


@pytest.fixture(scope="module")
def walk(spark):
    rng, us, rows = random.Random(8), 0, []
    for i in range(900):
        us += rng.choice([0, 100_000, 700_000]) if i % 100 else 40_000_000
        rows.append(("ab"[i % 2], us, i, round(50_000 + rng.gauss(0, 8), 2)))
    return spark.createDataFrame(rows, TICK).repartition(4)


@pytest.mark.parametrize("make", [engines.labouchere, engines.entropy_regime])
def test_windows_of_the_wanted_are_those_of_all(spark, walk, make):
    scale = TimeScale()
    every = {r["event_id"]: r for r in make(walk, scale).collect()}
    some = {r["event_id"]: r for r in make(walk, scale, shell.before_cutoff(scale)).collect()}
    assert 10 < len(some) < 500 and all(every[k] == r for k, r in some.items())


def test_windows_are_made_for_the_wanted_only(spark, walk):
    """A tick that nothing looks back on gets no window, however few are wanted."""
    scale = TimeScale()
    rows = engines.windowed(walk, scale, 8, (F.col("event_id") == 700) | (F.col("event_id") == 301), 3)
    assert sorted(r["event_id"] for r in rows.collect()) == [295, 297, 299, 301, 694, 696, 698, 700]
    assert {r["event_id"]: len(r["w"]) for r in rows.where("wanted").collect()} == {301: 8, 700: 8}


def test_flow_features_equal_their_sql_where_ticks_are_microseconds_apart(spark, tmp_path):
    """Features are beyond the bounds of the score there."""
    name = "flow_features"
    rng, at, rows = random.Random(9), datetime.datetime(2024, 1, 1), []
    for i in range(600):
        at += datetime.timedelta(microseconds=rng.choice([0, 3, 40, 2_000])) if i % 60 else datetime.timedelta(hours=6)
        rows.append((i, at, i % 5, "click", round(rng.expovariate(0.02), 2), "{}"))
    table = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    table.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = base.sql(f"SELECT {', '.join(got.columns)} FROM ({oracles.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert max(abs(x) for row in want for x in row[2:] if x is not None) > 10_000_000
