"""Health beacons: what every running stream last did and how far it lags, written where anybody can read it."""

from __future__ import annotations

import datetime as dt
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BEACON = "query string, run_id string, kind string, batch bigint, at_ms bigint, input_rows bigint, rows_per_second double, watermark_ms bigint, newest_ms bigint, lag_ms bigint, state_rows bigint, late_rows bigint, duration_ms bigint, error string"


def _ms(text: str | None) -> int | None:
    """Milliseconds of a time in a progress report; none for the start of time, which says that nothing has come."""
    if not text:
        return None
    at = dt.datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()
    return round(at * 1000) if at > 0 else None


class Beacon(StreamingQueryListener):
    """Writes a record for each progress, idle spell and end of every stream of the session into ``folder``, a file each.

    ``lag_ms`` is how long ago the newest event time was when the batch ended. A record that can't be written never stops a stream.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.names: dict[str, str] = {}
        self.failed = 0

    def _write(self, record: dict) -> None:
        try:
            jvm = self.spark._jvm
            name = f"{record['kind']}-{record['run_id']}-{record.get('batch', 0)}-{record['at_ms']}.json"
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
            try:
                out.write((json.dumps(record) + "\n").encode())
            finally:
                out.close()
        except Exception:  # noqa: BLE001 - the beacon is not the work
            self.failed += 1

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self._write({"query": event.name or str(event.id), "run_id": str(event.runId), "kind": "started", "at_ms": round(time.time() * 1000)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        now = round(time.time() * 1000)
        newest = _ms(p.eventTime.get("max")) if p.eventTime else None
        self._write({
            "query": p.name or str(p.id), "run_id": str(p.runId), "kind": "progress", "batch": p.batchId, "at_ms": now, "input_rows": p.numInputRows,
            "rows_per_second": None if p.processedRowsPerSecond != p.processedRowsPerSecond else p.processedRowsPerSecond, "watermark_ms": _ms(p.eventTime.get("watermark")) if p.eventTime else None, "newest_ms": newest,
            "lag_ms": None if newest is None else now - newest, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "duration_ms": p.batchDuration,
        })

    def onQueryIdle(self, event) -> None:
        self._write({"query": self.names.get(str(event.runId), str(event.id)), "run_id": str(event.runId), "kind": "idle", "at_ms": round(time.time() * 1000)})

    def onQueryTerminated(self, event) -> None:
        self._write({"query": self.names.pop(str(event.runId), str(event.id)), "run_id": str(event.runId), "kind": "ended", "at_ms": round(time.time() * 1000), "error": (event.exception or "")[:2000] or None})


def beacons(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BEACON).json(folder)


def stream_health(records: DataFrame, now_ms: Column, quiet_ms: int = 60_000, lag_ms: int = 30_000) -> DataFrame:
    """query, the latest record of each kind of news, totals of its newest run and status: FAILED, ENDED, OFFLINE, DEGRADED (lagging) or VERIFIED."""
    newest = records.groupBy("query").agg(F.max_by("run_id", "at_ms").alias("run_id"))
    rows = records.join(newest, ["query", "run_id"])
    news = F.col("kind") == "progress"
    seen = F.when(news & F.col("newest_ms").isNotNull(), F.col("batch"))
    g = rows.groupBy("query", "run_id").agg(
        F.max("at_ms").alias("last_ms"), F.max(F.when(news, F.col("batch"))).alias("batch"), F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"),
        F.max_by("lag_ms", seen).alias("lag_ms"), F.max_by("state_rows", F.when(news, F.col("batch"))).alias("state_rows"), F.max("watermark_ms").alias("watermark_ms"),
        F.bool_or(F.col("kind") == "ended").alias("ended"), F.max("error").alias("error"),
    )
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.col("ended"), "ENDED").when(now_ms - F.col("last_ms") > quiet_ms, "OFFLINE").when(F.col("lag_ms") > lag_ms, "DEGRADED").otherwise("VERIFIED")
    return g.withColumn("age_ms", now_ms - F.col("last_ms")).withColumn("status", status).drop("ended")
