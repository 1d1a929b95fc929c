import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_fold import frame, random_chat, rows_of

from larder.operators import conversations as cv
from larder.operators import features as ft
from larder.plans import model as m
from larder.streaming import jobs as sj
from larder.streaming.stateful import resolve_one

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def stream_of(spark, batches, path):
    """A file stream that delivers each batch as one micro-batch."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    return sj.read_events(spark, str(path), batches[0].schema, 1)


def run(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def test_dedup(spark, tmp_path):
    schema = "chat_id string, message_id string, ts timestamp"
    one = spark.createDataFrame([("c", "m1", at(0)), ("c", "m1", at(1)), ("c", "m2", at(2))], schema)
    two = spark.createDataFrame([("c", "m1", at(3)), ("c", "m3", at(4))], schema)
    out = run(spark, sj.stream_dedup(stream_of(spark, [one, two], tmp_path / "in")), "dedup", tmp_path / "cp")
    assert sorted(r.message_id for r in out.collect()) == ["m1", "m2", "m3"]


def test_rates_and_sessions_equal_their_batch_forms(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((at(rng.randint(0, 3000)), rng.choice("ab"), rng.choice(["finished", "error"]), float(rng.randint(1, 9))) for _ in range(60))
    df = spark.createDataFrame(rows, "ts timestamp, user_id string, outcome string, duration_s double")
    final = spark.createDataFrame([(at(90_000), "z", "finished", 1.0)], df.schema)
    batches = [df.filter(F.col("ts") < F.lit(at(1500))), df.filter(F.col("ts") >= F.lit(at(1500))), final]
    done = F.col("window_end") < F.lit(at(80_000))
    got = run(spark, sj.stream_request_rates(stream_of(spark, batches, tmp_path / "r")), "rates", tmp_path / "cp1").filter(done)
    assert sorted(map(str, got.collect())) == sorted(map(str, sj.stream_request_rates(df).collect()))
    got = run(spark, sj.stream_sessions(stream_of(spark, batches, tmp_path / "s"), "3 minutes"), "sessions", tmp_path / "cp2")
    got = got.filter("user_id <> 'z'")
    assert sorted(map(str, got.collect())) == sorted(map(str, sj.stream_sessions(df, "3 minutes").collect()))


def test_status_alerts(spark, tmp_path):
    schema = "location_id string, item_id string, ts timestamp, days_of_supply double, minimum_days_supply int"
    one = spark.createDataFrame([("l", "i", at(3), 9.0, 14), ("l", "i", at(1), 20.0, 14), ("l", "i", at(2), 15.0, 14), ("l", "j", at(1), 30.0, 14)], schema)
    two = spark.createDataFrame([("l", "i", at(5), 8.0, 14), ("l", "i", at(6), 14.0, 14), ("l", "i", at(0), 1.0, 14)], schema)
    out = run(spark, sj.stream_status_alerts(stream_of(spark, [one, two], tmp_path / "in")), "alerts", tmp_path / "cp")
    got = sorted((r.item_id, r.ts, r.alert, r.late) for r in out.collect() if not r.late)
    assert got == [("i", at(3), "BELOW_MINIMUM", False), ("i", at(6), "RECOVERED", False)]
    assert [(r.ts, r.alert) for r in out.collect() if r.late] == [(at(0), None)]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    rng = random.Random(21)
    rows = rows_of(*[random_chat(rng, 12) for _ in range(12)])
    whole = frame(spark, rows)
    third = len(rows) // 3
    by_time = sorted(rows, key=lambda r: (r["seq"], r["chat_id"]))
    batches = [frame(spark, by_time[:third]), frame(spark, by_time[third : 2 * third]), frame(spark, by_time[2 * third :])]
    out = run(spark, sj.stream_messages(stream_of(spark, batches, tmp_path / "in"), idle="30 minutes", arrived="ts"), "resolved", tmp_path / "cp")
    resolved = out.filter("NOT late").drop("late")
    batch = cv.resolve_events(whole)
    for assemble in (cv.assemble_messages, cv.assemble_tool_calls, cv.assemble_reasonings):
        assert sorted(map(str, assemble(resolved).collect())) == sorted(map(str, assemble(batch).collect()))


def test_idle_runs_are_closed_and_later_events_are_marked(spark, tmp_path):
    def event(chat, seq, when, kind, **f):
        row = dict.fromkeys(cv.EVENT_FIELDS)
        row.update(chat_id=chat, run_id="r", seq=seq, ts=when, type=kind, **f)
        return row

    one = frame(spark, [event("a", 0, at(0), "TEXT_MESSAGE_CONTENT", message_id="m", delta="x")])
    two = frame(spark, [event("b", 0, at(9000), "TEXT_MESSAGE_CONTENT", message_id="n", delta="y")])
    three = frame(spark, [event("b", 1, at(9001), "TEXT_MESSAGE_CONTENT", message_id="n", delta="z")])
    four = frame(spark, [event("a", 1, at(9002), "TEXT_MESSAGE_CONTENT", message_id="m", delta="late")])
    stream = stream_of(spark, [one, two, three, four], tmp_path / "in")
    out = run(spark, sj.stream_messages(stream, idle="10 minutes", delay="1 second", arrived="ts"), "idle", tmp_path / "cp")
    rows = out.collect()
    assert [(r.chat_id, r.seq) for r in rows if r.late] == [("a", 1)]
    messages = {m.message_id: m for m in cv.assemble_messages(out.filter("NOT late")).collect()}
    assert (messages["m"].content, messages["m"].in_progress) == ("x", False)
    assert (messages["n"].content, messages["n"].in_progress) == ("yz", True)


def test_events_with_an_old_time_are_not_lost(spark, tmp_path):
    def event(chat, seq, when, came, **f):
        row = dict.fromkeys(cv.EVENT_FIELDS)
        row.update(chat_id=chat, run_id="r", seq=seq, ts=when, type="TEXT_MESSAGE_CONTENT", **f)
        return frame(spark, [row]).withColumn("came", F.lit(came))

    batches = [
        event("a", 0, at(0), at(10), message_id="m", delta="x"), event("b", 0, at(9000), at(9000), message_id="n", delta="y"),
        event("b", 1, at(9001), at(9001), message_id="n", delta="z"), event("a", 1, at(1), at(9002), message_id="m", delta="old"),
        event("c", 0, at(2), at(9003), message_id="o", delta="first of its chat"),
    ]
    stream = stream_of(spark, batches, tmp_path / "in")
    out = run(spark, sj.stream_messages(stream, idle="10 minutes", delay="1 second", arrived="came"), "old", tmp_path / "cp").collect()
    assert sorted((r.chat_id, r.seq) for r in out if r.late) == [("a", 1)]
    assert [(r.chat_id, r.delta) for r in out if r.chat_id == "c"] == [("c", "first of its chat")]


def test_forgotten_chats_start_afresh(spark, tmp_path):
    def event(chat, seq, when, **f):
        row = dict.fromkeys(cv.EVENT_FIELDS)
        row.update(chat_id=chat, run_id="r", seq=seq, ts=when, type="TEXT_MESSAGE_CONTENT", delta="x", **f)
        return frame(spark, [row])

    others = [event("b", i, at(9000 * (i + 1)), message_id="n") for i in range(4)]
    batches = [event("a", 0, at(0), message_id="m"), *others, event("a", 1, at(36_001), message_id="m")]
    stream = stream_of(spark, batches, tmp_path / "in")
    out = run(spark, sj.stream_messages(stream, "10 minutes", "1 second", keep="1 hour", arrived="ts"), "forgotten", tmp_path / "cp")
    assert [(r.seq, r.late) for r in out.filter("chat_id = 'a' AND type <> 'RUN_FINISHED'").orderBy("seq").collect()] == [(0, False), (1, False)]


def test_feature_refresh_writes_what_a_full_run_gives(spark, tmp_path):
    rng = random.Random(8)
    schema = "k string, snapshot_date date, daily_demand_units int, days_of_supply double, minimum_days_supply int, on_order_units int"
    day0 = dt.date(2024, 1, 1)
    rows = [(k, day0 + dt.timedelta(days=i), rng.randint(0, 9), float(rng.randint(0, 40)), 14, 3) for k in "ab" for i in range(80)]
    panel = spark.createDataFrame(rows, schema)
    spec = ft.PanelSpec(keys=("k",))
    written = []
    new = panel.filter((F.col("k") == "a") & (F.col("snapshot_date") >= F.lit(day0 + dt.timedelta(days=75))))
    stream = stream_of(spark, [new], tmp_path / "in")
    q = sj.stream_feature_refresh(stream, lambda: panel, lambda df, _: written.extend(df.collect()), str(tmp_path / "cp"), spec)
    q.awaitTermination(300)
    assert q.exception() is None
    full = ft.rolling_features(panel, spec).filter((F.col("k") == "a") & (F.col("snapshot_date") >= F.lit(day0 + dt.timedelta(days=75))))
    assert sorted(map(str, written)) == sorted(map(str, full.collect()))


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    spec, out = ft.PanelSpec(keys=("k",), day="day"), str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame([(k, dt.date(2024, 1, day), v) for k, day, v in x], "k string, day date, v int")
    sj.write_refresh(rows(("a", 1, 1), ("b", 1, 1)), out, 0)
    sj.write_refresh(rows(("a", 1, 2), ("a", 2, 2)), out, 1)
    with pytest.raises(Exception, match="killed"):
        sj.write_refresh(rows(("a", 1, 3), ("c", 1, 3)).withColumn("v", F.when(F.col("k") == "c", F.raise_error(F.lit("killed"))).otherwise(F.col("v"))), out, 2)
    for _ in range(2):  # the batch comes again
        sj.write_refresh(rows(("a", 1, 4), ("c", 1, 4)), out, 2)
    stored = spark.read.parquet(out)
    assert stored.filter("refresh = 2").count() == 2
    got = sorted((r.k, r.day.day, r.v) for r in sj.read_refreshed(stored, spec).collect())
    assert got == [("a", 1, 4), ("a", 2, 2), ("b", 1, 1), ("c", 1, 4)]


def test_closing_events_have_numbers_of_their_own(spark, tmp_path):
    def event(chat, run_id, seq, when, **f):
        row = dict.fromkeys(cv.EVENT_FIELDS)
        row.update(chat_id=chat, run_id=run_id, seq=seq, ts=when, type="TEXT_MESSAGE_CONTENT", delta="x", **f)
        return row

    one = frame(spark, [event("a", r, i, at(i), message_id=f"m{i}") for i, r in enumerate(["r", "s", "t"])])
    idle = [frame(spark, [event("b", "r", i, at(9000 + i), message_id="n")]) for i in range(2)]
    again = frame(spark, [event("a", "u", i, at(9010 + i), message_id="m9") for i in (3, 4)])
    stream = stream_of(spark, [one, *idle, again], tmp_path / "in")
    out = run(spark, sj.stream_messages(stream, idle="10 minutes", delay="1 second", arrived="ts"), "numbers", tmp_path / "cp")
    rows = sorted((r.seq, r.type, r.run_id) for r in out.filter("chat_id = 'a'").collect())
    assert [x[0] for x in rows] == list(range(8))
    assert [x[2] for x in rows if x[1] == "RUN_FINISHED"] == ["r", "s", "t"] and [x[2] for x in rows[6:]] == ["u", "u"]


def test_each_message_is_known_without_a_search_of_all(spark):
    class Id(str):
        compared = 0
        __hash__ = str.__hash__

        def __eq__(self, other):
            Id.compared += 1
            return str.__eq__(self, other)

    state = {}
    for i in range(300):
        resolve_one("c", state, {**dict.fromkeys(cv.EVENT_FIELDS), "type": "MESSAGE", "role": "user", "message_id": Id(f"m{i}"), "seq": i})
    assert list(state["seen"]) == [f"m{i}" for i in range(300)]
    assert Id.compared < 3_000


def test_events_of_a_chat_are_made_in_one_task(spark, tmp_path):
    turns = [(c, t, "assistant" if t % 2 else "user", "x" * 90) for t in range(4) for c in range(9)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = m.run_events(spark, str(tmp_path), 3)
    parts = rows.withColumn("part", F.spark_partition_id()).groupBy("chat_id").agg(F.countDistinct("part").alias("parts"))
    assert rows.rdd.getNumPartitions() == 3
    assert [r.parts for r in parts.collect()] == [1] * 9
    assert sorted(map(str, rows.collect())) == sorted(map(str, m.run_events(spark, str(tmp_path)).collect()))
