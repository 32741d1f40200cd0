"""Structured Streaming forms of ingest, candles, sessions, once-only triggers and delayed labels.

All take and return streaming DataFrames, so they run over any source (files, Kafka, rate) and sink. Event
time is ``ts``; what comes later than the watermark is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.upserts import latest_wins

LATE = "30 seconds"


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 200) -> DataFrame:
    """Parquet files as they come into a folder; one micro-batch takes ``files_per_batch`` at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once_per_key(rows: DataFrame, keys: Sequence[str], late: str = LATE) -> DataFrame:
    """The first row of each key within the watermark: a trigger that fires once for each round."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def candle_stream(ticks: DataFrame, seconds: float = 5.0, late: str = LATE) -> DataFrame:
    """symbol, start, o, h, l, c, n of every closed candle of ticks (symbol, ts, event_id, price)."""
    order = F.struct("ts", "event_id")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w"))
    g = rows.agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("w.start").alias("start"), "o", "h", "l", "c", "n")


def session_stream(ticks: DataFrame, gap_seconds: int = 60, late: str = LATE) -> DataFrame:
    """Closed sessions: symbol, start, last tick and number of ticks.

    A session window would join ticks that are exactly the gap apart; a gap shorter by a microsecond cuts there.
    """
    window = F.session_window("ts", f"{gap_seconds - 1} seconds 999999 microseconds")
    g = ticks.withWatermark("ts", late).groupBy("symbol", window.alias("w")).agg(F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_ticks"))
    return g.select("symbol", F.col("w.start").alias("start"), "end", "n_ticks")


def delayed_labels(observations: DataFrame, outcomes: DataFrame, within: str = "90 seconds", late: str = LATE) -> DataFrame:
    """Observations (symbol, round_num, ts, ...) with the outcome (symbol, round_num, ts, outcome) of their successor, if it comes in time."""
    left = observations.withWatermark("ts", late).alias("a")
    right = outcomes.where(F.col("outcome").isin("UP", "DOWN")).withWatermark("ts", late).alias("b")
    near = (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    joined = left.join(right, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("b.round_num") == F.col("a.round_num") + 1) & near)
    return joined.select("a.*", F.col("b.outcome").alias("next_outcome"))


def upsert_batches(target: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch writes its own newest rows by key bucket under ``target``; nothing older is read or written again.

    Replaying a batch writes the same files, and numbers may have gaps.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = latest_wins(batch, keys, order).select(batch.columns)
        newest.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")

    return write


BASES = "_base"  # hidden from a reader of the target's batches


def _complete(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the folders ``name=number`` in ``folder`` whose writing has ended, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at(folder)):
        return []
    parts = [p.getPath().getName() for p in files.listStatus(at(folder)) if p.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.split("=", 1)[1]) for p in parts if files.exists(at(f"{folder}/{p}/_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def upserted(spark: SparkSession, target: str, schema: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key that :func:`upsert_batches` has written; of rows equal in ``order``, the later batch's.

    Reads the newest base that :func:`compact` has completed and the batches after it.
    """
    rows = spark.read.schema(f"{schema}, batch bigint, bucket bigint").parquet(target)
    bases = _complete(spark, f"{target}/{BASES}", "upto")
    if bases:
        base = spark.read.schema(f"{schema}, bucket bigint").parquet(f"{target}/{BASES}/upto={bases[-1]}")
        rows = rows.where(F.col("batch") > bases[-1]).unionByName(base.withColumn("batch", F.lit(bases[-1]).cast("bigint")))
    return latest_wins(rows, keys, [*order, "batch"]).drop("batch", "bucket")


def compact(spark: SparkSession, target: str, schema: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> int | None:
    """Merge the last base with all complete batches since into a new base; gives the last batch in it, None if nothing is new.

    The old base and its batches stay until the next compaction, so that a reader that has just begun still finds them, and
    a base that was not completed is ignored and written anew. A batch that is replayed after its compaction changes nothing.
    The whole base is written again: call it when the batches have grown to a share of the base, not after each.
    """
    bases, batches = _complete(spark, f"{target}/{BASES}", "upto"), _complete(spark, target, "batch")
    last = bases[-1] if bases else -1
    if not batches or batches[-1] <= last:
        return None
    upto = batches[-1]
    new = spark.read.schema(f"{schema}, batch bigint, bucket bigint").parquet(target).where((F.col("batch") > last) & (F.col("batch") <= upto)).drop("bucket")
    if bases:
        base = spark.read.schema(f"{schema}, bucket bigint").parquet(f"{target}/{BASES}/upto={last}").drop("bucket")
        new = new.unionByName(base.withColumn("batch", F.lit(last).cast("bigint")))
    newest = latest_wins(new, keys, [*order, "batch"]).drop("batch")
    newest.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{BASES}/upto={upto}")
    for number in bases[:-1]:
        _delete(spark, f"{target}/{BASES}/upto={number}")
    for number in batches:
        if number <= last:
            _delete(spark, f"{target}/batch={number}")
    return upto


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what has come so far into the in-memory table ``name``; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
