"""Streams over files against what the same rows give in a batch."""

import datetime as dt

from tidemark.streaming import ingest

TICK = "symbol string, ts timestamp, event_id bigint, price double"


def at(second: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def written(spark, tmp_path, rows, schema=TICK):
    folder = str(tmp_path / "in")
    for i in range(0, len(rows), 5):  # a file for each batch
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, stream, name, tmp_path):
    ingest.run_available(stream, name, str(tmp_path / f"checkpoint-{name}"))
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_candles_close_behind_the_watermark(spark, tmp_path):
    rows = [("a", at(s), i, float(10 + (i * 7) % 5)) for i, s in enumerate([0, 1, 4, 5, 6, 9.5, 11, 12, 60, 120])]
    stream = ingest.file_stream(spark, written(spark, tmp_path, rows), TICK)
    got = run(spark, ingest.candle_stream(stream, 5), "candles", tmp_path)
    assert [(r[1].second, r[-1]) for r in got][:3] == [(0, 3), (5, 3), (10, 2)]
    first = [r[3] for r in rows[:3]]
    assert got[0][2:6] == (first[0], max(first), min(first), first[-1])


def test_sessions_cut_at_exactly_the_gap(spark, tmp_path):
    rows = [("a", at(s), i, 1.0) for i, s in enumerate([0, 59.999, 119.999, 120, 600])]
    stream = ingest.file_stream(spark, written(spark, tmp_path, rows), TICK)
    got = run(spark, ingest.session_stream(stream), "sessions", tmp_path)
    assert [r[3] for r in got] == [2, 2]


def test_one_trigger_for_each_round(spark, tmp_path):
    rows = [("a", at(s), i % 3, 1.0) for i, s in enumerate(range(12))]
    stream = ingest.file_stream(spark, written(spark, tmp_path, rows), TICK, 1)
    got = run(spark, ingest.once_per_key(stream, ["symbol", "event_id"]), "once", tmp_path)
    assert sorted(r[2] for r in got) == [0, 1, 2]


def test_labels_come_from_the_next_round_in_time(spark, tmp_path):
    o = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(30)), ("a", 7, at(40))], "symbol string, round_num bigint, ts timestamp")
    l = spark.createDataFrame([("a", 2, at(20), "UP"), ("a", 3, at(200), "DOWN"), ("a", 9, at(50), "UP")], "symbol string, round_num bigint, ts timestamp, outcome string")  # noqa: E741
    for name, rows in (("o", o), ("l", l)):
        rows.write.parquet(str(tmp_path / name))
    streams = [ingest.file_stream(spark, str(tmp_path / n), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)) for n, rows in (("o", o), ("l", l))]
    got = run(spark, ingest.delayed_labels(*streams), "labels", tmp_path)
    assert [(r[1], r[3]) for r in got] == [(1, "UP")]


def test_batches_are_merged_latest_first(spark, tmp_path):
    target, schema = str(tmp_path / "t"), "k string, v int, w string"
    write = ingest.upsert_batches(target, ["k"], ["v"])
    write(spark.createDataFrame([("x", 1, "a"), ("y", 1, "a"), ("x", 0, "old")], schema), 0)
    for _ in range(2):  # a replay, and a gap in the numbers
        write(spark.createDataFrame([("x", 2, "b"), ("z", 5, "b"), ("y", 1, "same time, later batch")], schema), 7)
    got = sorted(tuple(r) for r in ingest.upserted(spark, target, schema, ["k"], ["v"]).select("k", "v", "w").collect())
    assert got == [("x", 2, "b"), ("y", 1, "same time, later batch"), ("z", 5, "b")]


def test_compaction_keeps_every_newest_row(spark, tmp_path):
    """A plain dictionary against batches and bases: ties, a replay behind a base, an unfinished base, what is deleted when."""
    target, schema = str(tmp_path / "t"), "k string, v int, w string"
    write, held = ingest.upsert_batches(target, ["k"], ["v"], 4), {}

    def add(number, rows):
        write(spark.createDataFrame(rows, schema), number)
        for k, v, w in rows:
            if k not in held or v >= held[k][0]:
                held[k] = (v, w)

    def same():
        got = {r["k"]: (r["v"], r["w"]) for r in ingest.upserted(spark, target, schema, ["k"], ["v"]).collect()}
        assert got == held

    def merge():
        return ingest.compact(spark, target, schema, ["k"], ["v"], 4)

    first = [(f"k{i}", i % 3, "a") for i in range(20)]
    add(0, first)
    add(3, [(f"k{i}", 1, "b") for i in range(10)])
    same()
    assert merge() == 3
    same()
    assert merge() is None
    write(spark.createDataFrame(first, schema), 0)  # a replay
    same()
    add(4, [("k1", 1, "a tie after the base"), ("k2", 0, "too old"), ("new", 1, "c")])
    same()
    (tmp_path / "t" / "_base" / "upto=9").mkdir()  # a base that was never completed
    same()
    assert merge() == 4
    same()
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"batch=4", "_base"}
    add(5, [("k7", 9, "d")])
    assert merge() == 5
    same()
    assert {p.name for p in (tmp_path / "t" / "_base").iterdir()} == {"upto=4", "upto=5", "upto=9"}
