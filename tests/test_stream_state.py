"""Stateful processors against batch results: eviction, restarts, late rows, labels that come due."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import price_asof
from tidemark.streaming import ingest, state

TICK = "symbol string, ts timestamp, event_id bigint, price double"
PREDICTION = "symbol string, ts timestamp, prediction_id bigint, direction string, price_then double, target timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(second):
    return START + dt.timedelta(seconds=second)


def us(second):
    return round((START + dt.timedelta(seconds=second)).timestamp() * 1_000_000)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield state.with_state_store(spark)
    spark.conf.set(key, before)


def drop(spark, folder, rows, schema):
    """One more file, so one more micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def advance(stream, tmp_path, name):
    """Run over what is there, then stop: the next call is a restart from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_recent_ticks_evict_restart_and_take_late_ticks(store, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "recent"
    batches = [
        [("a", 0, 1), ("a", 10, 2), ("b", 5, 3)],
        [("a", 50, 4), ("a", 20, 5), ("a", 10, 2)],  # out of order, and one that comes twice
        [("a", 75, 6), ("b", 60, 7)],  # 0 and 10 go, as 75 - 60 is after them
        [("a", 70, 8), ("a", 5, 9)],  # 5 is behind the watermark
        [("c", 300, 10)],  # a and b have been quiet for long
        [("c", 301, 11)],
    ]
    for batch in batches:
        drop(store, folder, [(s, at(t), e, float(e)) for s, t, e in batch], TICK)
        advance(state.recent_ticks(ingest.file_stream(store, str(folder), TICK, 1), 60.0, "30 seconds"), tmp_path, "recent")
    rows = store.read.parquet(str(out)).collect()
    held = {(r["symbol"], r["as_of_us"]): [x["event_id"] for x in r["ticks"]] for r in rows}
    assert held["a", us(10)] == [1, 2] and held["a", us(50)] == [1, 2, 5, 4]
    # seen as of 75 first without, then with the tick that came out of order
    assert sorted([x["event_id"] for x in r["ticks"]] for r in rows if (r["symbol"], r["as_of_us"]) == ("a", us(75))) == [[5, 4, 6], [5, 4, 8, 6]]
    assert held["b", us(5)] == [3] and held["b", us(60)] == [3, 7]
    empty = {r["symbol"]: r for r in rows if r["n_ticks"] == 0}
    assert set(empty) == {"a", "b"} and empty["a"]["price"] is None
    assert held["c", us(301)] == [10, 11]
    last = max((r for r in rows if r["symbol"] == "a" and r["n_ticks"]), key=lambda r: (r["as_of_us"], r["n_ticks"]))
    assert (last["low"], last["high"], last["price"], last["first_us"]) == (4.0, 8.0, 6.0, us(20))


def test_labels_come_due_as_in_the_batch_join(store, tmp_path):
    rng = random.Random(8)
    ticks, asked = [], []
    second = 20.0
    for i in range(300):
        second += rng.choice([0.0, 0.5, 0.5, 1.0, 9.0])
        ticks.append((rng.choice(["a", "a", "b", None]), at(second), i, float(rng.randrange(90, 110))))
    for k in range(120):
        begin = 1.0 + k * second / 140
        symbol = rng.choice(["a", "b", None, "none"])
        asked.append((symbol, at(begin), k, rng.choice(["UP", "DOWN", "NO_SIGNAL"]), rng.choice([100.0, None]), at(begin + rng.choice([0.0, 3.0, 15.0]))))
    closing = [(s, at(second + 1000 + j), 9000 + j, 1.0) for j in range(2) for s in ("a", "b", "z", None)]  # carries the watermark beyond all targets
    both = sorted([(t[1], 0, t) for t in ticks] + [(p[1], 1, p) for p in asked], key=lambda x: x[:2])
    tick_folder, asked_folder = tmp_path / "ticks", tmp_path / "asked"
    parts = [both[i : i + 70] for i in range(0, len(both), 70)] + [[(None, 0, t) for t in closing[:4]], [(None, 0, t) for t in closing[4:]]]
    for part in parts:  # files in order of time, a restart after each two
        own = [x[2] for x in part if x[1] == 0], [x[2] for x in part if x[1] == 1]
        rng.shuffle(own[0])
        drop(store, tick_folder, own[0], TICK)
        drop(store, asked_folder, own[1], PREDICTION)
        stream = state.due_labels(ingest.file_stream(store, str(asked_folder), PREDICTION), ingest.file_stream(store, str(tick_folder), TICK), "30 seconds")
        advance(stream, tmp_path, "due")
    got = {r["prediction_id"]: r for r in store.read.parquet(str(tmp_path / "due")).collect()}
    moments = store.createDataFrame(asked, PREDICTION).select("symbol", "prediction_id", F.unix_micros("target").alias("target_us"))
    all_ticks = store.createDataFrame(ticks + closing, TICK).select("symbol", F.unix_micros("ts").alias("us"), "event_id", "price")
    want = {r["prediction_id"]: r["price"] for r in price_asof(moments, all_ticks).collect()}
    assert {k: r["actual_price"] for k, r in got.items()} == {k: p for k, p in want.items() if p is not None}
    assert len(got) > 80
    for symbol, _, k, direction, then, _ in asked:
        if k in got:
            r = got[k]
            actual = None if then is None else "UP" if r["actual_price"] > then else "DOWN" if r["actual_price"] < then else "FLAT"
            assert (r["symbol"], r["actual_direction"]) == (symbol, actual)
            assert r["correct"] == (None if direction == "NO_SIGNAL" or then is None else direction == actual)


def test_a_label_without_a_tick_before_waits_for_the_first_after(store, tmp_path):
    for part, asked in (([], [("a", at(0), 1, "UP", 5.0, at(2))]), ([("b", at(100), 1, 1.0)], []), ([("a", at(120), 3, 8.0), ("a", at(110), 2, 7.0)], []), ([("b", at(200), 4, 1.0)], []), ([("b", at(201), 5, 1.0)], [])):
        drop(store, tmp_path / "t", part, TICK)
        drop(store, tmp_path / "p", asked, PREDICTION)
        advance(state.due_labels(ingest.file_stream(store, str(tmp_path / "p"), PREDICTION), ingest.file_stream(store, str(tmp_path / "t"), TICK), "30 seconds"), tmp_path, "due")
    got = store.read.schema(state.DUE).parquet(str(tmp_path / "due")).collect()
    assert [(r["prediction_id"], r["actual_price"]) for r in got] == [(1, 7.0)]
