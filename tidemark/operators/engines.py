"""Signatures of every tick's trailing window.

Ticks are dealt to (symbol, block of time) with what came shortly before the block, so a symbol with very
many ticks is spread over tasks; windows look back by number of ticks inside the history that is kept.
Signatures that plain functions can express are columns; the others are Arrow-batched Python functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.config import TimeScale, micros
from tidemark.functions import windows
from tidemark.functions.columns import fold, ladder, move, total
from tidemark.operators.ordered import RANKS, lagged, running
from tidemark.operators.recurrences import ema_and_its_ema, restarted, scanned, wilder
from tidemark.scratch import materialize

BLOCK_HISTORIES = 10  # length of a block in histories; two histories before it are read again


def blocked(ticks: DataFrame, scale: TimeScale) -> DataFrame:
    """``ticks`` with block and own; a tick is repeated, not own, in the next block if that one looks back on it."""
    size, back = micros(scale.history * BLOCK_HISTORIES), micros(scale.history * 2)
    block = F.floor(F.col("us") / size)
    late = F.pmod(F.col("us"), F.lit(size)) >= size - back
    rows = ticks.withColumn("_b", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    return rows.withColumn("own", F.col("_b") == block).withColumnRenamed("_b", "block")


def _order() -> Window:
    return Window.partitionBy("symbol", "block").orderBy("us", "event_id")


def trailing(rows: DataFrame, k: int, scale: TimeScale, name: str = "w") -> DataFrame:
    """``rows`` with the array ``name`` (us, price) of the last k ticks of the history, oldest first."""
    seen = F.collect_list(F.struct("us", "price")).over(_order().rowsBetween(-(k - 1), 0))
    return rows.withColumn(name, F.filter(seen, lambda x: x.us > F.col("us") - micros(scale.history)))


def dwell(signature: str, back: int, scale: TimeScale) -> Column:
    """Bin of how long ``signature`` has held, seen over ``back`` ticks: since the tick after the last one that differs."""
    held = F.collect_list(F.struct(F.coalesce(signature, F.lit("")).alias("s"), F.col("us").alias("t"))).over(_order().rowsBetween(-(back - 1), 0))
    since = fold(
        held,
        F.struct(F.lit("").alias("s"), F.lit(0).cast("bigint").alias("t")),
        lambda a, x: F.when(a.s == x.s, a).otherwise(F.struct(x.s.alias("s"), x.t.alias("t"))),
        lambda a: a.t,
    )
    return ladder((F.col("us") - since) / 1e6, scale.dwell)


def velocity(features: list[str], scale: TimeScale, offset: int = 4) -> Column:
    """Bin of how fast the features change: their moves since ``offset`` ticks ago over the time between."""
    order = _order()
    seconds = (F.col("us") - F.lag("us", offset).over(order)) / 1e6
    moved = sum((F.abs(F.col(f) - F.lag(f, offset).over(order)) for f in features), F.lit(0.0))
    speed = F.when(seconds > 0, moved / seconds)
    return F.when(speed.isNull(), 0).otherwise(ladder(speed, scale.velocity))


def prices(name: str = "w") -> Column:
    return F.transform(name, lambda x: x.price)


def near(rows: DataFrame, wanted: Column | None, back: int, order: WindowSpec | None = None) -> DataFrame:
    """Only those ``rows`` that are ``wanted`` or one of the ``back`` before such a one; all if nothing is said.

    ``wanted`` may name ``next_us``, the time of the tick after a row. A signature costs far more than finding these rows.
    """
    if wanted is None:
        return rows.withColumn("wanted", F.lit(True))
    order = order or _order()
    rows = rows.withColumn("next_us", F.lead("us").over(order)).withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    return rows.withColumn("_near", F.max(F.col("wanted").cast("int")).over(order.rowsBetween(0, back))).where("_near = 1").drop("_near", "next_us")


def windowed(ticks: DataFrame, scale: TimeScale, k: int, wanted: Column | None, back: int) -> DataFrame:
    """As :func:`near` of the ``trailing`` windows of all ticks, but no window is made that isn't asked for."""
    if wanted is None:
        return near(trailing(blocked(ticks, scale), k, scale), None, back)
    return near(trailing(near(blocked(ticks, scale), wanted, back + k), k, scale), F.col("wanted"), back)


def _done(rows: DataFrame, *columns: str) -> DataFrame:
    if "wanted" in rows.columns:
        rows = rows.where("wanted")
    return rows.where("own").select("symbol", "us", "event_id", *columns)


def _text(template: str, *parts: Column | str) -> Column:
    return F.format_string(template, *parts)


# ---- residues


def crt(ticks: DataFrame, scale: TimeScale, wanted: Column | None = None) -> DataFrame:
    """symbol, us, event_id, core, dwell_bin, signature: residues of the price modulo 7, 11 and 13."""
    value = F.pmod((F.col("price") * 100_000).cast("bigint"), F.lit(1001))
    core = F.concat(F.lit("crt:"), (value % 7).cast("string"), F.lit("-"), (value % 11).cast("string"), F.lit("-"), (value % 13).cast("string"))
    rows = near(blocked(ticks, scale), wanted, 15).withColumn("core", core).withColumn("dwell_bin", dwell("core", 15, scale))
    return _done(rows.withColumn("signature", _text("%s_dw%d", "core", "dwell_bin")), "core", "dwell_bin", "signature")


# ---- staking sequence

START = (1, 1, 2, 3)


def labouchere(ticks: DataFrame, scale: TimeScale, wanted: Column | None = None) -> DataFrame:
    """The sequence that a staking rule reaches over the last eight ticks, its last step, length and sum."""

    def start() -> Column:
        return F.array(*(F.lit(x).cast("bigint") for x in START))

    def inner(s: Column) -> Column:
        return F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0)))

    def step(a: Column, x: Column) -> Column:
        won = F.when(F.size(a.s) < 2, start()).otherwise(F.slice(F.concat(inner(a.s), F.array(a.s[0] + F.element_at(a.s, -1))), 1, 32))
        lost = F.when(F.size(a.s) - 2 >= 2, inner(a.s)).otherwise(start())
        way = F.when(a.p.isNull(), "none").when(x.price > a.p, "win").when(x.price < a.p, "loss").otherwise("flat")
        s = F.when(a.p.isNull() | (x.price == a.p), a.s).when(x.price > a.p, won).otherwise(lost)
        return F.struct(s.alias("s"), x.price.alias("p"), way.alias("way"))

    first = F.struct(start().alias("s"), F.lit(None).cast("double").alias("p"), F.lit("none").alias("way"))
    rows = windowed(ticks, scale, 8, wanted, 13).withColumn("state", fold(F.col("w"), first, step)).drop("w")
    rows = rows.select("*", F.col("state.way").alias("transition"), F.size("state.s").alias("seq_len"), F.aggregate("state.s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("seq_sum")).drop("state")
    core = F.when(F.col("transition") != "none", _text("lab:%s:len%d_sum%d", "transition", "seq_len", "seq_sum"))
    rows = rows.withColumn("core", core).withColumn("dwell_bin", dwell("core", 12, scale)).withColumn("velocity_bin", velocity(["seq_len", "seq_sum"], scale))
    signature = _text("%s_dw%d_v%d", "core", "dwell_bin", "velocity_bin")
    return _done(rows.withColumn("signature", F.when(F.col("core").isNotNull(), signature)), "transition", "seq_len", "seq_sum", "core", "signature")


# ---- entropies


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entropy(codes: Column, outcomes: int) -> Column:
    """Shannon entropy of an array of codes from 0 to 7 as a share of its most over ``outcomes``."""

    def of_counts(counts: Column) -> Column:
        return _bound(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), lambda n: total(F.transform(counts, lambda c: F.when(c > 0, -(c / n) * F.ln(c / n)).otherwise(F.lit(0.0)))))

    def tally(found: Column) -> Column:
        return F.transform(F.array(*map(F.lit, range(8))), lambda k: F.size(F.filter(found, lambda x: x == k)).cast("bigint"))

    return _bound(codes, lambda found: _bound(tally(found), of_counts)) / float(np.log(outcomes))


def entropies(rows: DataFrame, name: str = "w") -> DataFrame:
    """``rows`` with permutation_entropy (orders of three prices, ties by place) and return_entropy (log returns in eight bins)."""
    enough = F.size(name) >= 4

    def orders(p: Column) -> Column:
        def pattern(i: Column) -> Column:
            a, b, c = (F.element_at(p, (i + k).cast("int")) for k in range(3))
            # which of the three comes before which, written as three bits
            return F.when(a <= b, 4).otherwise(0) + F.when(a <= c, 2).otherwise(0) + F.when(b <= c, 1).otherwise(0)

        return F.transform(F.sequence(F.lit(1), F.size(p) - 2), pattern)

    def steps(logs: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), F.size(logs)), lambda i: F.element_at(logs, i) - F.element_at(logs, i - 1))

    def spread_of(r: Column) -> Column:
        def binned(x: Column) -> Column:
            return _entropy(F.transform(r, lambda v: F.least(((v - x.lo) / (x.hi - x.lo) * 8).cast("bigint"), F.lit(7))), 8)

        return _bound(F.struct(F.array_min(r).alias("lo"), F.array_max(r).alias("hi")), lambda x: F.when(x.hi <= x.lo, F.lit(0.0)).otherwise(binned(x)))

    logs = F.transform(name, lambda x: F.ln(F.greatest(x.price, F.lit(1e-9))))
    rows = rows.withColumn("permutation_entropy", F.when(enough, _bound(prices(name), lambda p: _entropy(orders(p), 6))))
    return rows.withColumn("return_entropy", F.when(enough, _bound(logs, lambda x: _bound(steps(x), spread_of))))


def entropy_regime(ticks: DataFrame, scale: TimeScale, wanted: Column | None = None) -> DataFrame:
    rows = windowed(ticks, scale, 32, wanted, 12)
    rows = entropies(rows)

    def quarter(x: str) -> Column:
        return F.when(F.col(x) <= 0, 0).when(F.col(x) >= 1, 3).otherwise((F.col(x) * 4).cast("int"))

    last = move(F.col("price"), F.lag("price").over(_order()))
    core = F.when(F.size("w") >= 8, F.concat(F.lit("ent:p"), quarter("permutation_entropy").cast("string"), F.lit("_r"), quarter("return_entropy").cast("string"), F.lit("_d"), last))
    rows = rows.withColumn("core", core).drop("w").withColumn("dwell_bin", dwell("core", 10, scale)).withColumn("velocity_bin", velocity(["permutation_entropy", "return_entropy"], scale))
    signature = F.when(F.col("core").isNotNull(), _text("%s_dw%d_v%d", "core", "dwell_bin", "velocity_bin"))
    return _done(rows.withColumn("signature", signature), "permutation_entropy", "return_entropy", "core", "signature")


# ---- volatility of returns


def return_volatility(ticks: DataFrame, scale: TimeScale, k: int = 20) -> DataFrame:
    """volatility (sample deviation of the last k - 1 returns) and terrain: 0 calm, 1 normal, 2 volatile."""
    order = _order()
    rows = blocked(ticks, scale).withColumn("r", F.col("price") / F.lag("price").over(order) - 1)
    frame = order.rowsBetween(-(k - 2), 0)
    rows = rows.withColumn("n", F.count("r").over(frame)).withColumn("volatility", F.when(F.col("n") >= 2, F.stddev_samp("r").over(frame)))
    return _done(rows.withColumn("terrain", ladder(F.col("volatility"), (0.00005, 0.00020))).where("volatility IS NOT NULL"), "n", "volatility", "terrain")


# ---- windows that need numpy

#: engine -> ticks in its window, dwell look-back, function of (times, prices)
NUMERIC: dict[str, tuple[int, int, Callable]] = {
    "trig_euler": (windows.TRIG_WINDOW, 12, windows.trig),
    "superformula": (windows.SUPER_WINDOW, 8, windows.superformula),
    "navier_stokes": (windows.FLOW_WINDOW, 6, windows.flow),
    "trail_tracer": (windows.TRAIL_WINDOW, 8, windows.trail),
    "curve_geometry": (windows.CURVE_POINTS, 8, windows.curve),
}


def arrays(window) -> tuple[np.ndarray, np.ndarray]:
    """Times in seconds and prices of an array of ticks."""
    return np.array([x["us"] for x in window], float) / 1e6, np.array([x["price"] for x in window], float)


RANK_BLOCK = 4096  # ticks in a block of ranks


def by_rank(ticks: DataFrame, back: int, *also: str) -> DataFrame:
    """``ticks`` with _rank among their symbol's, block and own; a tick is repeated, not own, in the next block if it is one of the ``back`` before it.

    Blocks of ranks hold as many ticks however many come in a second, so a busy symbol is as many tasks as it needs.
    """
    rows = running(ticks.where("us IS NOT NULL").select("symbol", "us", "event_id", "price", *also), ["symbol"], ["us", "event_id"], {"_rank": F.lit(1)})
    block = F.floor(F.col("_rank") / RANK_BLOCK)
    late = F.col("_rank") % RANK_BLOCK >= RANK_BLOCK - back
    rows = rows.withColumn("block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    return rows.withColumn("own", F.col("block") == block)


def latest_windows(ticks: DataFrame, scale: TimeScale, size: int, wanted: Column | None, *also: str) -> DataFrame:
    """symbol, us, event_id, the columns ``also`` and w, the array of the last ``size`` ticks of the history, of the ticks that are ``wanted`` (as in :func:`near`); no other tick has its window made."""
    order = Window.partitionBy("symbol", "block").orderBy("_rank")
    rows = near(by_rank(ticks, size, *also), wanted, size, order)
    seen = F.collect_list(F.struct("us", "price")).over(order.rangeBetween(-(size - 1), 0))
    rows = rows.withColumn("w", F.when(F.col("wanted"), F.filter(seen, lambda x: x.us > F.col("us") - micros(scale.history))))
    return rows.where("own AND wanted").select("symbol", "us", "event_id", *also, "w")


def signatures(function: Callable, times: np.ndarray, prices: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``function`` of each window from starts to ends (included), and why it gives none; windows of one length at once where that form of it is there."""
    cores, reasons = np.full(len(ends), None, object), np.full(len(ends), None, object)
    odd = np.concatenate([[0], np.cumsum(~(np.abs(prices) < 1e15))])  # neither finite nor of a size that hundredths still show
    whole = odd[ends + 1] == odd[starts]
    many, sizes, left = windows.MANY.get(function), ends - starts + 1, np.ones(len(ends), bool)
    for n in np.unique(sizes[whole]).tolist() if many else ():
        at = np.flatnonzero(whole & (sizes == n))
        for part in np.array_split(at, -(-len(at) // 1024)):
            held = starts[part][:, None] + np.arange(n)
            cores[part] = many(times[held], prices[held])
        left[at] = False
    for i in np.flatnonzero(left).tolist():
        part = slice(starts[i], ends[i] + 1)
        try:
            cores[i] = function(times[part], prices[part])
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError) as error:
            reasons[i] = f"failed: {type(error).__name__}"
    reasons[(cores == None) & (reasons == None)] = "insufficient ticks"  # noqa: E711
    return cores, reasons


def numeric(ticks: DataFrame, scale: TimeScale, name: str, wanted: Column | None = None) -> DataFrame:
    """symbol, us, event_id, core, signature of one of the engines in ``NUMERIC``; a window on which it fails gives null and the reason.

    ``wanted`` as in :func:`near`. A window is the last ticks of the history, at most as many as the engine takes, read off its block of ranks.
    """
    size, back, function = NUMERIC[name]
    history, edges = micros(scale.history), np.array(scale.dwell)

    def signed(block: pa.Table) -> pa.Table:
        block = block.take(np.argsort(block["_rank"].to_numpy()))
        rank, us, price = (block[c].to_numpy() for c in ("_rank", "us", "price"))
        asked = block["wanted"].to_numpy()
        following = np.append(rank[asked], np.iinfo(np.int64).max)
        at = np.flatnonzero(following[np.searchsorted(rank[asked], rank)] - rank < back)  # one of those that dwell looks at
        starts = np.maximum(np.searchsorted(us, us[at] - history, "right"), np.searchsorted(rank, rank[at] - size + 1))
        cores, reasons = signatures(function, us / 1e6, price.astype(float), starts, at)
        # the first tick of the run of equal ones, seen over ``back`` ticks
        other = np.append(True, (cores[1:] != cores[:-1]) | (np.diff(rank[at]) > 1))[: len(at)]
        place = np.arange(len(at))
        since = np.maximum(np.maximum.accumulate(np.where(other, place, 0)), np.searchsorted(rank[at], rank[at] - back + 1))
        held = np.searchsorted(edges, (us[at] - us[at][since]) / 1e6, "right")
        kept = np.flatnonzero(asked[at] & block["own"].to_numpy()[at])
        cores, reasons = cores[kept], reasons[kept]
        made = [None if c is None else f"{c}_dw{d}" for c, d in zip(cores, held[kept].tolist(), strict=True)]
        out = block.take(at[kept]).select(["symbol", "us", "event_id"])
        for column, values in (("core", cores), ("signature", made), ("reason", reasons)):
            out = out.append_column(column, pa.array(values, pa.string()))
        return out

    order = Window.partitionBy("symbol", "block").orderBy("_rank")
    rows = near(by_rank(ticks, size + back), wanted, size + back, order)
    kinds = {c: t for c, t in rows.dtypes if c in ("symbol", "us", "event_id")}
    schema = ", ".join(f"{c} {t}" for c, t in (kinds | dict.fromkeys(("core", "signature", "reason"), "string")).items())
    return rows.select("symbol", "block", "_rank", "us", "event_id", "price", "own", "wanted").groupBy("symbol", "block").applyInArrow(signed, schema)


def once(function):
    """The function as one that is called once a row: neither a filter on its result nor a second use of it calls it again."""
    return function.asNondeterministic()


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as the session shuffles to, few and small as they may be: a row that is fitted costs far more than its bytes tell.

    Not by a key: rows that are dealt by it already would stay together in the few tasks that their bytes ask for.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def last_in_play(ticks: DataFrame, scale: TimeScale, size: int, round_num: Column, in_play: Column) -> DataFrame:
    """symbol, round_num, us and w, the array of the last ``size`` ticks of the history, of the last tick in play of each round."""
    following = F.lead(F.struct("round_num", "in_play")).over(Window.partitionBy("symbol", "block").orderBy("_rank"))
    last = F.col("in_play") & (following.isNull() | ~following.in_play | (following.round_num != F.col("round_num")))
    rows = latest_windows(ticks.withColumn("round_num", round_num).withColumn("in_play", in_play), scale, size, last, "round_num", "in_play")
    # the last tick of a block may seem to be the last in play
    return rows.groupBy("symbol", "round_num").agg(F.max_by(F.struct("us", "w"), F.struct("us", "event_id")).alias("x")).select("symbol", "round_num", "x.*")


def trajectory(ticks: DataFrame, scale: TimeScale, round_num: Column, in_play: Column) -> DataFrame:
    """symbol, round_num, us, core, signature, ensemble_direction, strength and best model as of the last tick in play of each round.

    The time since the signature last differed is looked for over the ten windows before, the latest first and only
    until one differs; it is 0 where none of them does.
    """
    back, size = 10, windows.TRAJECTORY_WINDOW

    @F.pandas_udf("core string, ensemble_direction string, strength double, model string, since_us long")
    def fitted(w: pd.Series) -> pd.DataFrame:
        def fit(times: np.ndarray, prices: np.ndarray) -> tuple:
            try:
                return windows.trajectory(times, prices) or (None,) * 4
            except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
                return (None,) * 4

        def judged(x) -> tuple:
            times, prices = arrays(x)
            n = len(prices)
            own = fit(times[-size:], prices[-size:])
            for ago in range(1, min(back, n - 1) + 1) if own[0] else ():
                part = slice(max(0, n - ago - size), n - ago)
                if fit(times[part], prices[part])[0] != own[0]:
                    return *own, x[n - 1]["us"] - x[n - ago - 1]["us"]
            return *own, 0

        return pd.DataFrame([judged(x) for x in w], columns=["core", "ensemble_direction", "strength", "model", "since_us"])

    rows = spread(last_in_play(ticks, scale, size + back, round_num, in_play)).withColumn("f", once(fitted)("w")).drop("w").where("f.core IS NOT NULL")
    signature = _text("%s_dw%d", F.col("f.core"), ladder(F.col("f.since_us") / 1e6, scale.dwell))
    return rows.select("symbol", "round_num", "us", "f.core", "f.ensemble_direction", "f.strength", "f.model", signature.alias("signature"))


def trajectory_forecasts(ticks: DataFrame, scale: TimeScale, round_num: Column, in_play: Column) -> DataFrame:
    """symbol, round_num, us, price_now and models (model, weight, direction, values) as of the last tick in play of each round; values are the prices that a model expects at the next ticks."""

    @F.pandas_udf("price_now double, models array<struct<model:string,weight:double,direction:string,values:array<double>>>")
    def forecast(w: pd.Series) -> pd.DataFrame:
        def made(x) -> tuple:
            try:
                found = windows.trajectory_models(*arrays(x))
            except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
                found = None
            return (None, None) if found is None else (found[2], [dict(zip(("model", "weight", "direction", "values"), m, strict=True)) for m in found[3]])

        return pd.DataFrame([made(x) for x in w], columns=["price_now", "models"]).astype({"price_now": "Float64"})

    rows = spread(last_in_play(ticks, scale, windows.TRAJECTORY_WINDOW, round_num, in_play))
    rows = rows.withColumn("f", once(forecast)("w"))
    return rows.where("f.models IS NOT NULL").select("symbol", "round_num", "us", "f.price_now", "f.models")


# ---- momentum over closed candles

#: Candles and ticks that a window needs, candles that it holds at most, candles whose signatures dwell looks at.
MOMENTUM_CANDLES, MOMENTUM_TICKS, MOMENTUM_MOST, MOMENTUM_BACK = 90, 200, 240, 12
#: Differences of averages below this share of the price are rounding.
ROUNDING = 1e-13


def momentum(candles: DataFrame, scale: TimeScale, least: int = MOMENTUM_CANDLES, least_ticks: int = MOMENTUM_TICKS, rsi: int = 60, fast: int = 30, slow: int = 60, smooth: int = 20, short: int = 30) -> DataFrame:
    """symbol, bucket, core, dwell_bin, signature, rsi, hist, stochastic and channel as of every candle (symbol, bucket, o, h, l, c, n) with enough before it.

    A window holds the candles of the history up to its last one, and its smoothings start with its first one. All of
    them are read off one scan of the symbol's candles by :func:`restarted`, for the window and for the up to
    ``MOMENTUM_BACK`` shorter ones whose signatures tell how long the core has held. Candles are dealt to blocks by rank
    with a look-back, so a symbol is many tasks and no row holds more than ``short + MOMENTUM_BACK`` values.
    """
    most = min(round(scale.history / scale.candle), MOMENTUM_MOST)
    needed = max(least, rsi + 1, slow + smooth + 1, 2 * short + 1)
    rows = running(candles.where("bucket IS NOT NULL"), ["symbol"], ["bucket"], {"_rank": F.lit(1)}, RANKS)
    rows = lagged(rows, ["symbol"], ["_rank"], "c", "_before", RANKS)
    gain, loss = F.greatest(F.col("c") - F.col("_before"), F.lit(0.0)), F.greatest(F.col("_before") - F.col("c"), F.lit(0.0))
    rows = rows.withColumn("_gain", F.coalesce(gain, F.lit(0.0))).withColumn("_loss", F.coalesce(loss, F.lit(0.0)))
    averages = {"f": ema_and_its_ema(fast, smooth), "s": ema_and_its_ema(slow, smooth)}
    scans = {n: (r, F.col("c")) for n, r in averages.items()}
    for name, period in (("long", rsi), ("near", short)):
        scans |= {f"g_{name}": (wilder(period), F.col("_gain")), f"l_{name}": (wilder(period), F.col("_loss"))}
    rows = materialize(scanned(rows, ["symbol"], "_rank", scans), "momentum-scans")
    # blocks of candles with the look-back of a window before them
    size = 8 * most
    block, late = F.floor(F.col("_rank") / size), F.col("_rank") % size >= size - most - 1
    rows = rows.withColumn("_block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block)))).withColumn("own", F.col("_block") == block)
    order = Window.partitionBy("symbol", "_block").orderBy("bucket")
    window = order.rangeBetween(-(most - 1), 0)
    for name, period in (("long", rsi), ("near", short)):  # the first average is the plain one of ``period`` moves
        plain = order.rowsBetween(-(period - 1), 0)
        rows = rows.withColumn(f"_first_{name}", F.struct(*(F.avg(x).over(plain).alias(x[1]) for x in ("_gain", "_loss")), F.col(f"g_{name}").alias("g_then"), F.col(f"l_{name}").alias("l_then")))
    typical = F.collect_list((F.col("h") + F.col("l") + F.col("c")) / 3).over(order.rowsBetween(-(short - 1), 0))
    rows = rows.withColumn("_typical", typical).withColumn("_mean", total(F.col("_typical")) / F.size("_typical"))
    spread = total(F.transform("_typical", lambda x: F.abs(x - F.col("_mean")))) / F.size("_typical")
    rows = rows.withColumn("_spread", spread).withColumn("_channel", F.when(F.col("_spread") <= 1e-12, 0.0).otherwise((F.element_at("_typical", -1) - F.col("_mean")) / (0.015 * F.col("_spread")))).drop("_typical", "_mean", "_spread")
    state = F.struct("c", "f", "s", "g_long", "l_long", "g_near", "l_near", "_channel")
    rows = rows.withColumn("_tail", F.collect_list(state).over(order.rowsBetween(-(short + MOMENTUM_BACK), 0)))
    rows = rows.withColumn("_start", F.first(F.struct("c", "f", "s")).over(window)).withColumn("_n", F.count(F.lit(1)).over(window)).withColumn("_ticks", F.sum("n").over(window))
    for name, period in (("long", rsi), ("near", short)):
        rows = rows.withColumn(f"_from_{name}", F.nth_value(f"_first_{name}", period + 1).over(window))
    rows = rows.where(F.col("own") & (F.col("_n") >= needed) & (F.col("_ticks") >= least_ticks))

    def at(back: Column) -> Column:
        return F.element_at("_tail", -(back + 1).cast("int"))

    def histogram(back: Column) -> Column:
        """Fast less slow average, less the average of that difference."""
        steps, now = F.col("_n") - 1 - back, at(back)
        parts = [restarted(r, most, steps, [F.col("_start.c")] * 2, [F.col(f"_start.{n}")[k] for k in range(2)], [now[n][k] for k in range(2)]) for n, r in averages.items()]
        line, signal = parts[0][0] - parts[1][0], parts[0][1] - parts[1][1]
        return F.when(F.abs(line - signal) <= ROUNDING * F.abs(now.c), 0.0).otherwise(line - signal)

    def strength(back: Column, name: str, period: int) -> Column:
        steps, now, begun = F.col("_n") - 1 - back - period, at(back), F.col(f"_from_{name}")
        g, l = (restarted(wilder(period), most, steps, [begun[x]], [begun[f"{x}_then"][0]], [now[f"{x}_{name}"][0]])[0] for x in "gl")  # noqa: E741
        return F.when(l <= 1e-12, 100.0).otherwise(100 - 100 / (1 + g / l))

    def values(back: Column) -> Column:
        recent = F.transform(F.sequence(F.lit(0), F.lit(short - 1)), lambda i: strength(back + i, "near", short))
        return F.struct(strength(back, "long", rsi).alias("rsi"), histogram(back).alias("hist"), histogram(back + 1).alias("before"), recent.alias("recent"), at(back)["_channel"].alias("channel"))

    def judged(x: Column) -> Column:
        low, high = F.array_min(x.recent), F.array_max(x.recent)
        stochastic = F.when(high - low <= 1e-9, 50.0).otherwise((x.recent[0] - low) / (high - low) * 100)
        return F.struct(x.rsi.alias("rsi"), x.hist.alias("hist"), x.before.alias("before"), stochastic.alias("stochastic"), x.channel.alias("channel"))

    def core(x: Column) -> Column:
        grows = (x.hist >= x.before) | (F.abs(x.hist - x.before) <= ROUNDING * F.col("c"))
        falls = (x.hist <= x.before) | (F.abs(x.hist - x.before) <= ROUNDING * F.col("c"))
        phase = F.when(x.hist > 0, F.when(grows, 0).otherwise(1)).when((x.hist < 0) & falls, 2).otherwise(3)
        return _text("mom:r%d_m%d_s%d_c%d", ladder(x.rsi, (30, 50, 70)), phase, ladder(x.stochastic, (20, 80)), ladder(x.channel, (-100, 100)))

    # this window and the shorter ones with the same start that are still long enough
    longest = F.least(F.lit(MOMENTUM_BACK), F.col("_n") - needed).cast("int")
    rows = rows.withColumn("_judged", F.transform(F.transform(F.sequence(F.lit(0), longest), values), judged)).drop("_tail")
    rows = rows.withColumn("_cores", F.transform("_judged", core)).withColumn("core", F.col("_cores")[0])
    other = F.array_position(F.transform("_cores", lambda x: x != F.col("core")), True)
    held = F.when(other > 0, other - 2).otherwise(longest)
    rows = rows.withColumn("dwell_bin", ladder(held * scale.candle, scale.dwell)).withColumn("_v", F.col("_judged")[0])
    return rows.select("symbol", "bucket", "core", "dwell_bin", _text("%s_dw%d", "core", "dwell_bin").alias("signature"), "_v.rsi", "_v.hist", "_v.stochastic", "_v.channel")
