"""Simple predictors over the resolved rounds of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASELINES = ("always_down", "always_up", "last_continue", "last_reverse", "majority")
MAJORITY_ROUNDS = 20


def baselines(rounds: DataFrame, history: int = MAJORITY_ROUNDS) -> DataFrame:
    """symbol, round_num, engine, direction: what each baseline says before a round, from the resolved rounds before it."""
    order = Window.partitionBy("symbol").orderBy("round_num")
    resolved = F.when(F.col("win_side").isin(1, 2), F.col("win_side"))
    # the resolved rounds so far, newest first, without the round itself
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rounds.withColumn("_last", F.last(resolved, ignorenulls=True).over(before))
    rank = F.count(resolved).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_rank", rank).withColumn("_ups", F.sum(F.when(resolved == 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_n", F.coalesce(F.lag("_rank").over(order), F.lit(0))).withColumn("_up", F.coalesce(F.lag("_ups").over(order), F.lit(0)))
    # ups among the last ``history`` resolved rounds: the running sum less what it was ``history`` resolved rounds ago
    old = rows.where(F.col("win_side").isin(1, 2)).select("symbol", F.col("_rank").alias("_then"), F.col("_ups").alias("_up_then"))
    rows = rows.withColumn("_then", F.col("_n") - history).join(old, ["symbol", "_then"], "left")
    up, n = F.col("_up") - F.coalesce("_up_then", F.lit(0)), F.least(F.col("_n"), F.lit(history))
    says = {
        "always_down": F.lit("DOWN"),
        "always_up": F.lit("UP"),
        "last_continue": F.when(F.col("_last") == 1, "UP").when(F.col("_last") == 2, "DOWN").otherwise("NO_SIGNAL"),
        "last_reverse": F.when(F.col("_last") == 1, "DOWN").when(F.col("_last") == 2, "UP").otherwise("NO_SIGNAL"),
        "majority": F.when(2 * up > n, "UP").when(2 * up < n, "DOWN").otherwise("NO_SIGNAL"),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("engine"), v.alias("direction")) for k, v in says.items())))
    return rows.select("symbol", "round_num", each.alias("x")).select("symbol", "round_num", "x.engine", "x.direction")
