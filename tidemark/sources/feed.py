"""Raw feed messages (JSON text) to ticks and rounds, with the reason why a message is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the feed: names of commands and symbols, plausible prices, and years of times in milliseconds.
TICK_COMMAND, ROUND_COMMAND = "/kline/BTC-USD/ticker", "/contest/BTC/USD/5/ticker"
TICK_SYMBOL, ROUND_SYMBOL = "BTC-USD", "BTC/USD"
PRICES = (100.0, 10_000_000.0)
TIMES_MS = (1_577_836_800_000, 4_102_444_800_000)  # 2020, 2100
EARLIER_ROUNDS = 6

TICK_MESSAGE = "cmd string, status int, resp struct<c: string, p: string, s: string, t: bigint>"
EARLIER = "array<struct<id: string, startPrice: double, endPrice: double, winSide: int>>"
ROUND_MESSAGE = (
    "cmd string, status int, resp struct<id: string, symbol: string, status: int, currentTime: bigint, statusChangeTime: bigint, roundStartTime: bigint, tradeCutoffTime: bigint, priceStartTime: bigint, "
    f"priceEndTime: bigint, startPrice: string, endPrice: string, winSide: int, previousRoundResult: {EARLIER}>"
)


def plausible(price: Column) -> Column:
    return (price > PRICES[0]) & (price < PRICES[1])


def _in_time(ms: Column) -> Column:
    return (ms > TIMES_MS[0]) & (ms < TIMES_MS[1])


def _told(reason: str, value: Column) -> Column:
    return F.concat(F.lit(f"{reason}:"), F.coalesce(value.cast("string"), F.lit("undefined")))


def normalize_ticks(messages: DataFrame, symbol: str = TICK_SYMBOL, command: str = TICK_COMMAND) -> DataFrame:
    """symbol, price, tick_ms, received_ms, latency_ms, raw_change, reject_reason of messages (message, received_ms); null reason: good."""
    m = F.from_json("message", TICK_MESSAGE)
    rows = messages.select(m.alias("m"), "received_ms").select("m.cmd", "m.resp", F.col("m.resp.s").alias("symbol"), F.expr("try_cast(m.resp.p AS double)").alias("price"), F.col("m.resp.t").alias("tick_ms"), "received_ms")
    reason = (
        F.when(F.col("cmd").isNull() | (F.col("cmd") != command), "unknown_tick_cmd")
        .when(F.col("resp").isNull(), "missing_resp")
        .when(~F.col("symbol").eqNullSafe(F.lit(symbol)), _told("wrong_tick_symbol", F.col("symbol")))
        .when(F.col("price").isNull() | ~plausible(F.col("price")), _told("implausible_tick_price", F.col("resp.p")))
        .when(F.col("tick_ms").isNull() | ~_in_time(F.col("tick_ms")), _told("implausible_tick_timestamp", F.col("tick_ms")))
    )
    return rows.select("symbol", "price", "tick_ms", "received_ms", (F.col("received_ms") - F.col("tick_ms")).alias("latency_ms"), F.col("resp.c").alias("raw_change"), reason.alias("reject_reason"))


def normalize_rounds(messages: DataFrame, symbol: str = ROUND_SYMBOL, command: str = ROUND_COMMAND) -> DataFrame:
    """round_id, times, prices (null where implausible), raw_direction, the latest earlier rounds and reject_reason."""
    r = messages.select(F.from_json("message", ROUND_MESSAGE).alias("m")).select("m.cmd", F.col("m.resp").isNull().alias("empty"), "m.resp.*")

    def price(name: str) -> Column:
        value = F.expr(f"try_cast({name} AS double)")
        return F.when(plausible(value), value)

    def time(name: str) -> Column:
        return F.when(_in_time(F.col(name)), F.col(name))

    reason = (
        F.when(F.col("cmd").isNull() | (F.col("cmd") != command), "unknown_round_cmd")
        .when(F.col("empty"), "missing_resp")
        .when(~F.col("symbol").eqNullSafe(F.lit(symbol)), _told("wrong_round_symbol", F.col("symbol")))
        .when(F.coalesce("id", F.lit("")) == "", "missing_round_id")
        .when(time("roundStartTime").isNull(), _told("bad_round_start", F.col("roundStartTime")))
        .when(time("tradeCutoffTime").isNull(), _told("bad_cutoff", F.col("tradeCutoffTime")))
    )
    earlier = F.slice(F.coalesce("previousRoundResult", F.array().cast(EARLIER)), 1, EARLIER_ROUNDS)
    earlier = F.transform(earlier, lambda x: F.struct(x.id.alias("round_id"), x.startPrice.alias("start_price"), x.endPrice.alias("end_price"), x.winSide.alias("win_side")))
    return r.select(
        F.col("id").alias("round_id"), "symbol", F.col("roundStartTime").alias("start_ms"), F.col("tradeCutoffTime").alias("cutoff_ms"), time("priceStartTime").alias("price_start_ms"),
        time("priceEndTime").alias("price_end_ms"), price("startPrice").alias("start_price"), price("endPrice").alias("end_price"), F.col("winSide").alias("win_side"),
        F.when(F.col("winSide") == 1, "UP").when(F.col("winSide") == 2, "DOWN").otherwise("UNRESOLVED").alias("raw_direction"), F.col("status").alias("status_code"),
        time("statusChangeTime").alias("status_change_ms"), earlier.alias("earlier"), reason.alias("reject_reason"),
    )


def feed_health(last: DataFrame, tick_max_ms: int = 5_000, round_max_ms: int = 15_000, latency_max_ms: int = 3_000, offline_ms: int = 60_000, tick_symbol: str = TICK_SYMBOL, round_symbol: str = ROUND_SYMBOL) -> DataFrame:
    """``last`` (tick_age_ms, round_age_ms, tick_symbol, round_symbol, latency_ms, session_id; any may be null) with status and reason."""
    tick, rnd, late = F.col("tick_age_ms"), F.col("round_age_ms"), F.col("latency_ms")

    def in_ms(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), value.cast("string"), F.lit("ms"))

    reasons = F.array_compact(
        F.array(
            F.when(tick.isNull(), "no_tick_received").when(tick > tick_max_ms, in_ms("tick_stale", tick)),
            F.when(rnd.isNull(), "no_round_received").when(rnd > round_max_ms, in_ms("round_stale", rnd)),
            F.when(F.col("tick_symbol") != tick_symbol, _told("wrong_tick_symbol", F.col("tick_symbol"))),
            F.when(F.col("round_symbol") != round_symbol, _told("wrong_round_symbol", F.col("round_symbol"))),
            F.when(late > latency_max_ms, in_ms("high_latency", late)),
            F.when(F.coalesce(F.col("session_id").cast("string"), F.lit("")) == "", "no_session"),
        )
    )
    status = F.when(tick.isNull() & rnd.isNull(), "UNVERIFIED").when(tick > offline_ms, "OFFLINE").when(F.size(reasons) > 0, "DEGRADED").otherwise("VERIFIED")
    return last.select("*", status.alias("status"), F.when(F.size(reasons) > 0, F.array_join(reasons, ",")).otherwise("ok").alias("reason"))
