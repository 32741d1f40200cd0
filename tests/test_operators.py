"""Engines, memory, votes and conjunctions on small made-up tables."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import TimeScale
from tidemark.functions import windows
from tidemark.operators import engines, interactions, shell
from tidemark.operators.evaluate import accuracy_label, model_scores, prediction_status
from tidemark.operators.memory import point_in_time
from tidemark.operators.shell import decided
from tidemark.operators.voting import combinations, holt_slope, pick_direction
from tidemark.sources.feed import feed_health, normalize_rounds, normalize_ticks
from tidemark.sources.files import bounded, open_or_create, record_set, scan_csv, scan_json, sink_json

TICK = "symbol string, us bigint, event_id bigint, price double"


def series(spark, prices, step=500_000):
    return spark.createDataFrame([("a", i * step, i, float(p)) for i, p in enumerate(prices)], TICK)


def test_labouchere_against_a_loop(spark):
    prices = [10, 11, 12, 11, 10, 9, 9, 10, 11, 12, 13, 14, 15, 14, 13, 12, 11, 10]
    got = {r["event_id"]: r for r in engines.labouchere(series(spark, prices), TimeScale()).collect()}
    for i in range(1, len(prices)):
        seq, last = [1, 1, 2, 3], "none"
        window = prices[max(0, i - 7) : i + 1]
        for a, b in itertools.pairwise(window):
            if b > a:
                seq = (seq[1:-1] + [seq[0] + seq[-1]])[:32] if len(seq) >= 2 else [1, 1, 2, 3]
            elif b < a:
                seq = seq[1:-1] if len(seq) >= 4 else [1, 1, 2, 3]
            last = "win" if b > a else "loss" if b < a else "flat"
        assert (got[i]["transition"], got[i]["seq_len"], got[i]["seq_sum"]) == (last, len(seq), sum(seq))
    assert got[0]["signature"] is None


def test_crt_residues_and_dwell(spark):
    got = [r["signature"] for r in engines.crt(series(spark, [1000.0] * 30), TimeScale()).orderBy("us").collect()]
    v = 100_000_000 % 1001
    assert got[0] == f"crt:{v % 7}-{v % 11}-{v % 13}_dw0"
    assert got[20].endswith("_dw1") and got[-1].endswith("_dw1")  # the look-back of 15 ticks ends at seven seconds


def test_blocks_do_not_change_windows(spark):
    prices = [100 + (i * 7919) % 13 for i in range(400)]
    wide, narrow = TimeScale(history=10_000.0), TimeScale(history=30.0)
    for engine in (engines.crt, engines.labouchere):
        a, b = ({r["event_id"]: r["signature"] for r in engine(series(spark, prices), s).collect()} for s in (wide, narrow))
        assert a == b


def test_point_in_time_memory_sees_only_past_labels(spark):
    rows = [("s", t, t, t + 15, "UP" if t % 3 else "DOWN") for t in range(0, 300, 2)]
    got = {r["event_id"]: r for r in point_in_time(spark.createDataFrame(rows, "signature string, us bigint, event_id bigint, label_us bigint, result string"), 50, 40).collect()}
    for _, t, e, _, _ in rows:
        seen = [r for r in rows if r[3] <= t][-50:]
        assert (got[e]["n_seen"], got[e]["up_seen"]) == (len(seen), sum(r[4] == "UP" for r in seen))


def test_prediction_status_and_labels(spark):
    rows = spark.createDataFrame([(0, 10_000_000), (6_000_000, 10_000_000), (6_000_001, 10_000_000), (10_000_000, 10_000_000)], "now bigint, cutoff bigint")
    lead, status = prediction_status(F.col("now"), F.col("cutoff"))
    assert [tuple(r) for r in rows.select(lead, status).collect()] == [(8000, "LOCKED"), (2000, "LOCKED"), (1999, "LATE"), (-2000, "INVALID")]
    rows = spark.createDataFrame([(0, None), (3, None), (3, 0.6), (3, 0.5), (3, 0.4)], "n int, a double")
    assert [r[0] for r in rows.select(accuracy_label(F.col("n"), F.col("a"))).collect()] == ["learning", "pending", "edge", "marginal", "below_chance"]


def test_model_scores(spark):
    ticks = series(spark, [100, 101, 102, 103, 104])
    made = [(1, 101.0, [("m", 0.5, "UP", [102.0, 103.0, 105.0]), ("n", 0.5, "DOWN", [101.0, 100.0, 99.0]), ("o", 0.1, "FLAT", [101.0, 101.0, 101.0]), ("short", 0.1, "UP", [1.0])]), (2, 103.0, [("m", 1.0, "UP", [1.0, 1.0, 1.0])])]
    forecasts = spark.createDataFrame([("a", *r) for r in made], "symbol string, round_num int, price_now double, models array<struct<model: string, weight: double, direction: string, values: array<double>>>")
    moved = spark.createDataFrame([("a", 1, 500_000, "DOWN"), ("a", 2, 1_500_000, "UP")], "symbol string, round_num int, at_us bigint, result string")
    got = {r["model"]: r for r in model_scores(forecasts, moved, ticks, 3).collect()}
    assert set(got) == {"m", "n", "o"} and all(r["round_num"] == 1 for r in got.values())  # round 2 has one tick after it
    assert got["m"]["endpoint_error"] == 1.0 and got["m"]["trajectory_rms"] == pytest.approx((1 / 3) ** 0.5) and (got["m"]["internal_correct"], got["m"]["target_correct"]) == (True, False)
    assert (got["n"]["internal_correct"], got["n"]["target_correct"]) == (False, True) and (got["o"]["internal_correct"], got["o"]["target_correct"]) == (None, None)


def test_trajectory_forecasts_against_the_windows(spark):
    prices = [100 + math.sin(i / 3) * 5 + i * 0.1 for i in range(200)]
    rows = engines.trajectory_forecasts(series(spark, prices), TimeScale(), F.floor(F.col("us") / 20_000_000), F.pmod(F.col("us"), F.lit(20_000_000)) <= 10_000_000).collect()
    assert len(rows) == 5
    for r in rows:
        last = int(r["us"] // 500_000)
        assert last % 40 == 20
        p0, height, now, models = windows.trajectory_models(np.arange(last + 1) * 0.5, np.array(prices[: last + 1]))
        assert r["price_now"] == now == prices[last] and [m["model"] for m in r["models"]] == [m[0] for m in models]
        for a, (_, weight, direction, values) in zip(r["models"], models, strict=True):
            assert a["weight"] == pytest.approx(weight) and a["values"] == pytest.approx(values) and a["direction"] == direction == ("UP" if values[-1] > now else "DOWN")
        signature, direction, strength, best = windows.trajectory(np.arange(last + 1) * 0.5, np.array(prices[: last + 1]))
        assert direction == ("UP" if sum(m[1] * m[3][-1] for m in models) > now else "DOWN")


def test_curve_of_play_against_the_windows(spark):
    rng = random.Random(3)
    rows, us, price = [], 0, 100.0
    while us < 300_000_000:
        rows.append(("a", us, len(rows), price))
        us += rng.choice([100_000, 500_000, 500_000, 1_000_000]) if not 120_000_000 < us < 180_000_000 else rng.choice([100_000, 4_000_000])
        price += rng.gauss(0, 1)
    ticks = spark.createDataFrame(rows, "symbol string, us bigint, event_id bigint, price double").repartition(3)
    scale = TimeScale()
    rounds = spark.createDataFrame([("a", k, k * 30_000_000, k * 30_000_000 + 15_000_000) for k in range(10)] + [("z", 0, 0, 1)], "symbol string, round_num int, start_us bigint, cutoff_us bigint")
    got = {r["round_num"]: r for r in shell.curve_of_play(ticks, rounds, scale).collect()}
    fallbacks = 0
    for k in range(10):
        seen = [(u / 1e6, p) for _, u, _, p in rows if u <= k * 30_000_000 + 15_000_000]
        play = [x for x in seen if x[0] >= k * 30]
        n_play = len(play)
        if n_play < 8:
            play, fallbacks = seen[-60:], fallbacks + 1
        elif n_play > 60:
            play = [play[int(i * (n_play / 60))] for i in range(60)]
        core = windows.curve(*(np.array([x[j] for x in play]) for j in range(2)))
        minute = [x for x in seen if x[0] >= seen[-1][0] - 60]
        dwell = windows.curve_dwell(*(np.array([x[j] for x in minute]) for j in range(2)), core, (5.0, 15.0, 30.0, 60.0)) if len(seen) >= 40 else 0.0
        assert (got[k]["n_play"], got[k]["signature"]) == (n_play, f"{core}_dw{sum(dwell >= e for e in scale.dwell)}")
    assert fallbacks and len(got) == 10


def test_holt_slope(spark):
    level, slope = 0.5, 0.6 - 0.5
    for x in (0.6, 0.55, 0.7, 0.65):
        new = 0.3 * x + 0.7 * (level + slope)
        slope = 0.1 * (new - level) + 0.9 * slope
        level = new
    for values, want in (((0.5, 0.6, 0.55, 0.7, 0.65), slope), ((0.5,), 0.0), ((), 0.0)):
        got = spark.range(1).select(holt_slope(F.array(*map(F.lit, values)).cast("array<double>")).alias("x")).first()["x"]
        assert got == pytest.approx(want, abs=1e-15)


def test_combinations_and_choice(spark):
    rows = spark.createDataFrame([(1, "b", "UP"), (1, "a", "DOWN"), (2, "a", "NO_SIGNAL"), (2, "b", "NO_SIGNAL")], "k int, engine string, direction string")
    assert combinations(rows.where("k = 1"), ["k"]).first()["combination"] == "a:DOWN|b:UP"
    assert sorted(tuple(r) for r in pick_direction(rows, ["k"], ["b", "a"]).collect()) == [(1, "b", "UP"), (2, "b", "NO_SIGNAL")]


SIGNATURES = {
    "sf:m0_n1_1_n2_0_dD_dw0": {"m": "0", "d": "D", "dw": "0"},
    "ns:v1_p1_d0_a0_dw0": {"v": "1", "p": "1", "d": "0", "a": "0", "dw": "0"},
    "crt:0-8-4_dw0": {"a": "0", "b": "8", "c": "4", "sum": "12", "repeated": "false", "dw": "0"},
    "crt:5-5-12": {"a": "5", "sum": "22", "repeated": "true"},
    "traj:CURVE_four1_normal_dw2": {"shape": "CURVE", "model": "four1", "state": "normal", "dw": "2"},
    "nsflow:down:p3": {"flow": "down:p3"},
    "nsflow:down_p3": {"flow": "down", "p": "3"},
    "lab:flat:len7_sum12_dw1_v2": {"result": "flat:len7", "sum": "12", "dw": "1", "v": "2"},
    "cs:star_hi_D_st2": {"part0": "star", "part1": "hi", "part3": "st2", "form": "star", "dircode": "hi", "st": "2", "candle_dir": "D"},
    "cs:body_bear_mid_U_st0": {"form": "body", "dircode": "bear", "candle_dir": "U"},
    "trail:nt4_pev1_DU_t2_dw3": {"nt": "4", "pev": "1", "t": "2", "dw": "3", "pair": "DU"},
    "mom:r2_m0_s1_c1_dw0": {"r": "2", "m": "0", "s": "1", "c": "1"},
    "cg:f1_s2_q4_dw1": {"f": "1", "s": "2", "q": "4"},
    "trig:rel2_cx0_tr1_dir3_sg0_dw2": {"rel": "2", "cx": "0", "tr": "1", "dir": "3", "sg": "0"},
    "proj:a4_c1_h2": {"a": "4", "c": "1", "h": "2"},
    "plain": {"namespace": "unknown"},
}


def test_signature_features(spark):
    rows = spark.createDataFrame([(s,) for s in SIGNATURES], "s string").select("s", interactions.signature_features(F.col("s")).alias("f")).collect()
    for r in rows:
        found = {x["feature"]: x["value"] for x in r["f"]}
        assert SIGNATURES[r["s"]].items() <= found.items() and "namespace" in found
        if r["s"].startswith("lab"):
            assert "len" not in found


def test_atoms_leave_out_silent_directions_and_placeholders(spark):
    rows = spark.createDataFrame([(1, "trajectory", "UP", "ns:v1_p0_d0_a0_dw0"), (1, "candlestick", "NO_SIGNAL", "cs:doji_mid_U_st0"), (1, "crt", "UP", "-")], "k int, engine string, direction string, signature string")
    found = {r["atom"] for r in interactions.atoms(rows, ["k"]).collect()}
    assert "sig.candlestick=cs:doji_mid_U_st0" in found and "dir.trajectory=UP" in found
    assert not any(a.startswith(("dir.candlestick", "sig.crt", "dir.crt")) for a in found)


def test_bounded_sets_and_hash(spark):
    names = list("edcba")
    row = spark.range(1).select(interactions.bounded_sets(F.array(*map(F.lit, names)), most=20).alias("s"), interactions.interaction_hash(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("h")).first()
    want = [list(c) for k in (2, 3, 4) for c in itertools.combinations(sorted(names), k)][:20]
    assert row["s"] == want
    import hashlib

    assert row["h"] == hashlib.sha256(json.dumps(["a", "b"], separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize(("up", "down", "adaptive", "p", "says"), [(None, 0.65, 0.616292613452465, 0.35 * 0.45 + 0.616292613452465 * 0.55, "NO_SIGNAL"), (0.65, None, 0.55, 0.595, "UP"), (None, 0.65, None, 0.35, "DOWN")])
def test_fusion(spark, up, down, adaptive, p, says):
    got = spark.range(1).select(*(c.alias(n) for c, n in zip(interactions.fused(*(F.lit(x).cast("double") for x in (up, down, adaptive))), "pd", strict=True))).first()
    assert got["p"] == pytest.approx(p, abs=1e-12) and got["d"] == says


def test_mined_rules_need_every_pair(spark):
    rows = [(i, ["a", "b", "c"] if i % 2 else ["a", "d"], "UP" if i % 3 else "DOWN") for i in range(60)]
    found = {r["key"]: (r["size"], r["n"]) for r in interactions.mined_rules(spark.createDataFrame(rows, "k int, atoms array<string>, next_outcome string"), ["k"]).collect()}
    assert found['["a","b","c"]'] == (3, 30) and found['["a","d"]'] == (2, 30) and '["b","d"]' not in found


def test_feed_messages(spark):
    ok = {"cmd": "/kline/BTC-USD/ticker", "status": 1, "resp": {"c": "d", "p": "50000.5", "s": "BTC-USD", "t": 1_700_000_000_000}}
    bad = [ok | {"cmd": "x"}, {"cmd": ok["cmd"]}, *(ok | {"resp": ok["resp"] | x} for x in ({"s": "Y"}, {"p": "100"}, {"p": "NaN?"}, {"t": 5}))]
    rows = spark.createDataFrame([(json.dumps(m), 1_700_000_000_250) for m in [ok, *bad]] + [("no json", 1)], "message string, received_ms bigint")
    got = normalize_ticks(rows).collect()
    assert [r["reject_reason"] for r in got] == [
        None, "unknown_tick_cmd", "missing_resp", "wrong_tick_symbol:Y", "implausible_tick_price:100", "implausible_tick_price:NaN?", "implausible_tick_timestamp:5", "unknown_tick_cmd",
    ]
    assert (got[0]["latency_ms"], got[0]["raw_change"]) == (250, "d")
    earlier = [{"id": x, "startPrice": 1.5, "endPrice": 2, "winSide": 1} for x in "abcdefgh"]
    body = {"id": "7", "symbol": "BTC/USD", "roundStartTime": 1_700_000_000_000, "tradeCutoffTime": 1_700_000_015_000, "startPrice": "50", "endPrice": "50001", "winSide": 2, "previousRoundResult": earlier}
    told = [body, body | {"symbol": "Z"}, body | {"id": ""}, body | {"roundStartTime": 7}, body | {"tradeCutoffTime": None}]
    got = normalize_rounds(spark.createDataFrame([(json.dumps({"cmd": "/contest/BTC/USD/5/ticker", "resp": b}),) for b in told], "message string")).collect()
    r = got[0]
    assert (r["raw_direction"], r["start_price"], r["end_price"], [x["round_id"] for x in r["earlier"]], r["earlier"][0]["end_price"]) == ("DOWN", None, 50001.0, list("abcdef"), 2.0)
    assert [x["reject_reason"] for x in got] == [None, "wrong_round_symbol:Z", "missing_round_id", "bad_round_start:7", "bad_cutoff:undefined"]


def test_feed_health(spark):
    schema = "tick_age_ms bigint, round_age_ms bigint, tick_symbol string, round_symbol string, latency_ms bigint, session_id string"
    rows = [(100, 200, "BTC-USD", "BTC/USD", 5, "s"), (5001, 200, "BTC-USD", "BTC/USD", 3001, "s"), (60_001, None, None, None, None, None), (None, None, None, None, None, ""), (5, 5, "X", "Y", 1, "s")]
    got = [(r["status"], r["reason"]) for r in feed_health(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("VERIFIED", "ok"), ("DEGRADED", "tick_stale:5001ms,high_latency:3001ms"), ("OFFLINE", "tick_stale:60001ms,no_round_received,no_session"),
        ("UNVERIFIED", "no_tick_received,no_round_received,no_session"), ("DEGRADED", "wrong_tick_symbol:X,wrong_round_symbol:Y"),
    ]


def test_decisions_beside_memory(spark):
    rows = [("UP", 0.8, "UP", 0.6), ("UP", 0.8, "DOWN", 0.6), ("UP", 0.8, "NO_SIGNAL", None), (None, None, "DOWN", 0.6), (None, None, "NO_SIGNAL", None)]
    d = spark.createDataFrame(rows, "a string, s double, b string, c double")
    got = [tuple(r) for r in d.select(*decided(F.col("a"), F.col("s"), F.col("b"), F.col("c"))).collect()]
    assert got == [("UP", pytest.approx(0.64), "agree"), ("NO_SIGNAL", None, "disagree"), ("UP", 0.8, "own_only"), ("DOWN", 0.6, "pattern_fallback"), ("NO_SIGNAL", None, "both_silent")]


def test_files_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("crt_signature,next_round_outcome,crt_direction\ncrt:1-2-3,UP,\n,DOWN,UP\n")
    rows = scan_csv(spark, str(tmp_path / "a.csv"), "crt_signature string, next_round_outcome string, crt_direction string")
    assert [tuple(r) for r in rows.collect()] == [("crt:1-2-3", "UP", None), (None, "DOWN", "UP")]
    sink_json(rows, str(tmp_path / "out"))
    assert sorted(map(str, scan_json(spark, str(tmp_path / "out"), rows.schema.simpleString()[7:-1].replace(":", " ")).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "bad.json").write_text('{"a": 1}\nno json\n')
    assert sorted(str(r["a"]) for r in scan_json(spark, str(tmp_path / "bad.json"), "a int").collect()) == ["1", "None"]
    t = open_or_create(spark, str(tmp_path / "t"), "k int")
    spark.range(3).selectExpr("CAST(id AS int) AS k").write.mode("append").parquet(str(tmp_path / "t"))
    assert t.count() == 0 and open_or_create(spark, str(tmp_path / "t"), "k int").count() == 3
    sets = spark.createDataFrame([('[{"n": 1}, {"n": 2}]',), ("nothing",), (None,)], "j string").select(record_set("j", "struct<n:int>").alias("x")).collect()
    assert [[y["n"] for y in r["x"]] for r in sets] == [[1, 2], [], []]
    assert bounded(5, 1, 9) == 5
    with pytest.raises(ValueError, match="not between"):
        bounded(0, 1, 9)


def test_atom_select_leaves_no_feature_out(spark):
    from tidemark.plans import queries

    outputs = queries._directed(spark, "/root/testdata/sf0.001")
    found = interactions.atoms(outputs, queries.MOMENT)
    n = found.groupBy(*queries.MOMENT).agg(F.count_distinct("atom").alias("n"))
    rows = interactions.selected_atoms(found, queries.MOMENT).join(n, queries.MOMENT).select(F.size("atoms").alias("kept"), "n").collect()
    assert rows and max(r["n"] for r in rows) > 8 and all(r["kept"] == min(r["n"], interactions.MOST_ATOMS) for r in rows)


def test_state_summary_counts_and_orders(spark):
    rows = [(1, "b", "UP", "x:1"), (1, "a", "NO_SIGNAL", "y:2"), (1, "c", "DOWN", "-"), (2, "a", "DOWN", None), (3, "a", "odd", "z")]
    got = {r["k"]: (r["state_json"], r["n_signatures"], r["n_directional"]) for r in interactions.state_summary(spark.createDataFrame(rows, "k int, engine string, direction string, signature string"), ["k"]).collect()}
    assert got == {1: ('[["a","NO_SIGNAL","y:2"],["b","UP","x:1"]]', 2, 1), 3: ('[["a","NO_SIGNAL","z"]]', 1, 0)}


def test_sway_knows_only_earlier_outcomes(spark):
    S = 1_000_000
    rows = [(i, i * S, (i + 1) * S, ["a", "b"], "UP") for i in range(20)]
    got = {r["k"]: r for r in interactions.sway(spark.createDataFrame(rows, "k int, us bigint, label_us bigint, atoms array<string>, next_outcome string"), ["k"]).collect()}
    # with n earlier ups the shrunk share is (n + 4) / (n + 8); five are the least
    assert set(got) == set(range(5, 20)) and all(got[k]["p_up"] == pytest.approx((k + 4) / (k + 8)) for k in got)
    late = [(i, 0, (i + 1) * S, ["a", "b"], "UP") for i in range(20)]
    assert interactions.sway(spark.createDataFrame(late, "k int, us bigint, label_us bigint, atoms array<string>, next_outcome string"), ["k"]).count() == 0


def test_agreement_and_sway_of_a_direction(spark):
    rows = spark.createDataFrame([("UP", "UP"), ("UP", "DOWN"), ("UP", "NO_SIGNAL"), ("NO_SIGNAL", "DOWN")], "a string, b string")
    got = [tuple(r) for r in rows.select(interactions.agreement(F.col("a"), F.col("b")), interactions.swayed(F.col("a"), F.col("b"))).collect()]
    assert got == [("A", "continuation"), ("C", "reversal"), ("N", "none"), ("N", "none")]
