"""Beacons of running, ended and failed streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import health, ingest

TICK = "symbol string, ts timestamp, event_id bigint, price double"


@pytest.fixture
def beacon(spark, tmp_path):
    listener = health.Beacon(spark, str(tmp_path / "beacons"))
    spark.streams.addListener(listener)
    yield listener
    spark.streams.removeListener(listener)


def settle(spark, folder, wanted):
    """Listeners are told a little later."""
    for _ in range(100):
        try:
            rows = health.beacons(spark, folder).collect()
        except Exception:  # nothing is written yet
            rows = []
        if {(r["query"], r["kind"]) for r in rows} >= wanted:
            return rows
        time.sleep(0.1)
    raise AssertionError(f"only {[(r['query'], r['kind']) for r in rows]}")


def test_what_streams_did_and_how_far_they_lag(spark, tmp_path, beacon):
    folder = str(tmp_path / "in")
    now = dt.datetime.now(dt.timezone.utc)
    for k in range(3):
        rows = [("a", now - dt.timedelta(seconds=500 - 100 * k + i), 10 * k + i, 1.0) for i in range(4)]
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.candle_stream(ingest.file_stream(spark, folder, TICK, 1), 5)
    ingest.run_available(stream, "beacon_candles", str(tmp_path / "c"))

    @F.udf("double")
    def fails(x):
        raise ValueError("no such price")

    broken = ingest.file_stream(spark, folder, TICK, 1).select(fails("price").alias("p"))
    with pytest.raises(Exception, match="no such price"):
        ingest.run_available(broken, "beacon_broken", str(tmp_path / "d"))
    rows = settle(spark, beacon.folder, {("beacon_candles", k) for k in ("started", "progress", "ended")} | {("beacon_broken", "ended")})
    progress = sorted((r for r in rows if r["query"] == "beacon_candles" and r["kind"] == "progress" and r["input_rows"]), key=lambda r: r["batch"])
    assert [r["input_rows"] for r in progress] == [4, 4, 4] and all(295_000 < r["lag_ms"] < 700_000 for r in progress)
    assert [r["newest_ms"] for r in progress] == sorted(r["newest_ms"] for r in progress) and progress[-1]["state_rows"] >= 1 and beacon.failed == 0
    at = max(r["at_ms"] for r in rows)
    got = {r["query"]: r for r in health.stream_health(health.beacons(spark, beacon.folder), F.lit(at + 5)).collect()}
    assert got["beacon_candles"]["status"] == "ENDED" and got["beacon_candles"]["input_rows"] == 12
    assert got["beacon_broken"]["status"] == "FAILED" and "no such price" in got["beacon_broken"]["error"]


def test_status_of_a_stream(spark):
    rows = [
        ("fine", "r2", "progress", 7, 1_000_000, 5, 10), ("fine", "r1", "ended", None, 900_000, None, None), ("slow", "r", "progress", 1, 1_000_000, 5, 40_000), ("slow", "r", "idle", None, 1_000_500, None, None),
        ("gone", "r", "progress", 1, 900_000, 5, 10), ("new", "r", "started", None, 1_000_900, None, None),
    ]
    made = spark.createDataFrame(rows, "query string, run_id string, kind string, batch bigint, at_ms bigint, input_rows bigint, lag_ms bigint")
    records = made.select("*", F.col("at_ms").alias("newest_ms"), *(F.lit(None).cast(t).alias(n) for n, t in (("watermark_ms", "bigint"), ("state_rows", "bigint"), ("late_rows", "bigint"), ("error", "string"))))
    got = {r["query"]: (r["status"], r["age_ms"]) for r in health.stream_health(records, F.lit(1_001_000)).collect()}
    assert got == {"fine": ("VERIFIED", 1000), "slow": ("DEGRADED", 500), "gone": ("OFFLINE", 101_000), "new": ("VERIFIED", 100)}
