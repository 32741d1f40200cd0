"""Open-high-low-close candles and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TimeScale, micros
from tidemark.functions.columns import move
from tidemark.operators.ordered import rejoined

#: Length of a block of candles in look-backs.
BLOCK_LOOKBACKS = 50


def candles(ticks: DataFrame, seconds: float) -> DataFrame:
    """symbol, bucket, o, h, l, c, n of every time bucket with ticks; the last one of a symbol is still open and left out."""
    order = F.struct("us", "event_id")
    rows = ticks.groupBy("symbol", F.floor(F.col("us") / micros(seconds)).alias("bucket")).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.count(F.lit(1)).alias("n")
    )
    newest = rows.groupBy("symbol").agg(F.max("bucket").alias("_newest"))
    return rejoined(rows, newest, ["symbol"]).where("bucket < _newest").drop("_newest")


def candle_class() -> Column:
    """Class of a candle (o, h, l, c) after the one before it (po, pc)."""
    size = F.col("h") - F.col("l")
    top, bottom = F.greatest("o", "c"), F.least("o", "c")
    body = F.abs(F.col("c") - F.col("o")) / size
    bull = F.col("c") > F.col("o")
    inside = (bottom > F.least("po", "pc")) & (top < F.greatest("po", "pc"))
    return (
        F.when(size < 1e-9, "doji")
        .when(body < 0.10, "doji")
        .when(body > 0.85, F.when(bull, "marubozu_bull").otherwise("marubozu_bear"))
        .when(((bottom - F.col("l")) / size > 0.55) & (body < 0.45), "hammer")
        .when(((F.col("h") - top) / size > 0.55) & (body < 0.45), "star")
        .when(F.col("po").isNotNull() & inside, "inside")
        .otherwise(F.when(bull, "body_bull").otherwise("body_bear"))
    )


def candlestick_signatures(ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """symbol, bucket, c, class, position, prev_dir, streak and signature as of every closed candle with two before it in the look-back.

    The streak counts equal classes backwards over at most six candles and not beyond the look-back's second one. So no
    candle asks for more than its look-back: candles are dealt to blocks that repeat as much of the one before.
    """
    back = round(scale.candle_history / scale.candle)
    size = back * BLOCK_LOOKBACKS
    block, late = F.floor(F.col("bucket") / size), F.pmod(F.col("bucket"), F.lit(size)) >= size - back
    rows = candles(ticks, scale.candle).withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("_own", F.col("_block") == block)
    order = Window.partitionBy("symbol", "_block").orderBy("bucket")
    for name, column in (("po", "o"), ("pc", "c")):
        rows = rows.withColumn(name, F.lag(column).over(order))
    rows = rows.withColumn("class", candle_class())
    rows = rows.withColumn("seen", F.count(F.lit(1)).over(order.rangeBetween(-(back - 1), 0)))
    last5 = order.rowsBetween(-4, 0)
    rows = rows.withColumn("in5", F.least(F.col("seen"), F.lit(5)))
    # of the last five candles only those inside the look-back count
    recent = F.collect_list(F.struct("h", "l")).over(last5)
    kept = F.slice(recent, F.size(recent) - F.col("in5") + 1, F.col("in5"))
    rows = rows.withColumn("hi", F.array_max(F.transform(kept, lambda x: x.h))).withColumn("lo", F.array_min(F.transform(kept, lambda x: x.l)))
    place = (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rows = rows.withColumn("position", F.when(F.col("hi") <= F.col("lo"), "mid").when(place <= 0.33, "lo").when(place >= 0.67, "hi").otherwise("mid"))
    rows = rows.withColumn("prev_dir", move(F.col("pc"), F.col("po")))
    changed = F.when(F.lag("class").over(order) == F.col("class"), 0).otherwise(1)
    rows = rows.withColumn("_run", F.sum(changed).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run_length = F.row_number().over(Window.partitionBy("symbol", "_block", "_run").orderBy("bucket"))
    rows = rows.withColumn("streak", F.least(run_length, 1 + F.least(F.lit(6), F.col("seen") - 2)).cast("int")).where("_own AND seen >= 3")
    signature = F.concat(F.lit("cs:"), "class", F.lit("_"), "position", F.lit("_"), "prev_dir", F.lit("_st"), F.least(F.col("streak") - 1, F.lit(3)).cast("string"))
    return rows.select("symbol", "bucket", "c", "class", "position", "prev_dir", "streak", signature.alias("signature"))
