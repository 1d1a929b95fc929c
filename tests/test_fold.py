"""Folding run events: hand-written cases, and random streams against an event-by-event loop."""

import datetime as dt
import random

import pytest

from larder.operators import conversations as cv
from larder.streaming.stateful import resolve_one

T0 = dt.datetime(2024, 1, 1)


def ev(kind, **fields):
    return {"type": kind, **fields}


def user(id_="m1", text="Hi", name="u1"):
    return ev("MESSAGE", message_id=id_, content=text, name=name, role="user")


def start(id_, **f):
    return ev("TEXT_MESSAGE_START", message_id=id_, **f)


def text(id_, delta):
    return ev("TEXT_MESSAGE_CONTENT", message_id=id_, delta=delta)


def end(id_):
    return ev("TEXT_MESSAGE_END", message_id=id_)


def chunk(id_=None, delta=None):
    return ev("TEXT_MESSAGE_CHUNK", message_id=id_, delta=delta)


BEGIN, DONE = ev("RUN_STARTED"), ev("RUN_FINISHED")
FAIL = ev("RUN_ERROR", error_message="Failed")


def rows_of(*chats):
    """Each chat is a list of runs, each run a list of events."""
    rows = []
    for c, runs in enumerate(chats):
        seq = 0
        for r, events in enumerate(runs):
            for e in events:
                row = dict.fromkeys(cv.EVENT_FIELDS)
                row.update(chat_id=f"c{c}", run_id=f"r{r}", seq=seq, ts=T0 + dt.timedelta(seconds=seq), **e)
                rows.append(row)
                seq += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in cv.EVENT_FIELDS) for r in rows], cv.EVENT_SCHEMA)


def fold(spark, *chats):
    resolved = cv.resolve_events(frame(spark, rows_of(*chats)))
    out = {}
    for m in cv.assemble_messages(resolved).collect():
        out.setdefault(m.chat_id, {})[m.message_id] = m
    return resolved, out


WHOLE = [start("m2"), text("m2", "part 1.\n"), text("m2", "part 2."), end("m2")]


def test_complete_message(spark):
    _, out = fold(spark, [[user(), BEGIN, *WHOLE, DONE]])
    m1, m2 = out["c0"]["m1"], out["c0"]["m2"]
    assert (m1.role, m1.name, m1.content, m1.in_progress) == ("user", "u1", "Hi", False)
    assert (m2.role, m2.name, m2.content, m2.in_progress, m2.error) == ("assistant", "agent", "part 1.\npart 2.", False, None)
    assert m2.created_at == T0 + dt.timedelta(seconds=2)


def test_unfinished_runs(spark):
    _, out = fold(spark, [[user(), BEGIN, *WHOLE]], [[user(), BEGIN, *WHOLE[:-1]]])
    assert (out["c0"]["m2"].in_progress, out["c1"]["m2"].in_progress) == (False, True)
    assert out["c1"]["m2"].content == "part 1.\npart 2."
    resolved = cv.resolve_events(frame(spark, rows_of([[user(), BEGIN, *WHOLE]], [[user(), BEGIN, *WHOLE[:-1]]])))
    assert [tuple(r) for r in cv.unclosed_chats(cv.assemble_messages(resolved)).collect()] == [("c1", 1)]


def test_errors(spark):
    coded = ev("RUN_ERROR", error_message="Failed", error_code="E1")
    _, out = fold(spark, [[user(), BEGIN, *WHOLE[:-1], FAIL]], [[user(), BEGIN, *WHOLE[:-1], coded]])
    assert (out["c0"]["m2"].error, out["c0"]["m2"].in_progress) == ("Failed", False)
    assert out["c1"]["m2"].error == "[E1] Failed"


def test_error_after_the_end_still_reaches_the_active_message(spark):
    """An end event closes a message but leaves it active, so the run error is written to it."""
    _, out = fold(spark, [[user(), BEGIN, *WHOLE, FAIL]])
    assert (out["c0"]["m2"].error, out["c0"]["m2"].content) == ("Failed", "part 1.\npart 2.")


def test_unclosed_messages_and_swapping_back(spark):
    _, out = fold(
        spark,
        [[user(), text("m2", "part 1.\n"), text("m3", "new")]],
        [[user(), text("m2", "part 1.\n"), text("m3", "new"), text("m2", "part 2.")]],
    )
    assert (out["c0"]["m2"].content, out["c0"]["m2"].in_progress) == ("part 1.\n", False)
    assert (out["c0"]["m3"].content, out["c0"]["m3"].in_progress) == ("new", True)
    assert (out["c1"]["m2"].content, out["c1"]["m2"].in_progress) == ("part 1.\npart 2.", False)
    assert (out["c1"]["m3"].content, out["c1"]["m3"].in_progress) == ("new", False)


def test_steps_are_stamped_at_creation(spark):
    on, off = lambda s: ev("STEP_STARTED", name=s), lambda s: ev("STEP_FINISHED", name=s)
    run = [
        BEGIN, on("s1"), chunk("m2", "M2"), chunk("m3", "M3"), off("s1"), chunk("m4", "M4"),
        on("s2"), chunk("m5", "M5"), off("s2"), chunk("m6", "M6"), DONE,
    ]
    _, out = fold(spark, [[user(), *run]])
    assert {i: m.step for i, m in out["c0"].items()} == {"m1": None, "m2": "s1", "m3": "s1", "m4": None, "m5": "s2", "m6": None}
    assert all(not m.in_progress for m in out["c0"].values())


def test_tool_calls_and_reasonings(spark):
    think = lambda k, **f: ev(f"THINKING_TEXT_MESSAGE_{k}", **f)
    call = lambda k, **f: ev(f"TOOL_CALL_{k}", **f)
    run = [
        BEGIN, *WHOLE,
        call("START", parent_message_id="m2", tool_call_id="tc1", name="t1"),
        call("ARGS", tool_call_id="tc1", delta="a,"), call("ARGS", tool_call_id="tc1", delta="b"),
        call("END", tool_call_id="tc1"), call("RESULT", tool_call_id="tc1", content="TC1"),
        ev("THINKING_START", name="Thinking"), think("START"), think("CONTENT", delta="t1\n"),
        think("CONTENT", delta="t2"), think("END"), think("START"), think("CONTENT", delta="t3"),
        think("CONTENT", delta_list=["x", 'q"r']), think("END"), ev("THINKING_END"),
        call("CHUNK", parent_message_id="m2", tool_call_id="tc2", name="t2", delta="x,y"),
        call("RESULT", tool_call_id="tc2", content="TC2"), DONE,
    ]
    resolved, out = fold(spark, [[user(), *run]])
    assert set(out["c0"]) == {"m1", "m2"} and out["c0"]["m2"].content == "part 1.\npart 2."
    tools = cv.assemble_tool_calls(resolved).orderBy("created_seq").collect()
    assert [(t.message_id, t.tool_call_id, t.name, t.arguments, t.content, t.in_progress, t.error) for t in tools] == [
        ("m2", "tc1", "t1", "a,b", "TC1", False, None),
        ("m2", "tc2", "t2", "x,y", "TC2", False, None),
    ]
    thoughts = cv.assemble_reasonings(resolved).orderBy("block").collect()
    assert [(r.message_id, r.name, r.content, r.in_progress) for r in thoughts] == [
        ("m2", "Thinking", "t1\nt2", False),
        ("m2", "Thinking", 't3\n["x", "q\\"r"]', False),
    ]


def test_unnamed_tool_and_error_on_open_parts(spark):
    run = [
        BEGIN, start("m2"), ev("TOOL_CALL_ARGS", tool_call_id="x", delta="1"), ev("THINKING_TEXT_MESSAGE_CONTENT", delta="hm"), FAIL,
    ]
    resolved, _ = fold(spark, [[user(), *run]])
    (tool,) = cv.assemble_tool_calls(resolved).collect()
    assert (tool.name, tool.arguments, tool.error, tool.in_progress) == ("UNKNOWN", "1", "Failed", False)
    (thought,) = cv.assemble_reasonings(resolved).collect()
    assert (thought.name, thought.content, thought.error, thought.in_progress) == ("", "hm", "Failed", False)


def test_events_without_an_id(spark):
    loose = ev("TOOL_CALL_ARGS", tool_call_id="t", delta="1")
    _, out = fold(
        spark,
        [[user(), BEGIN, loose, DONE]],  # last message is the user's: a new one
        [[user(), BEGIN, *WHOLE, DONE], [BEGIN, loose, DONE]],  # last message is the assistant's: that one
        [[user(), BEGIN, chunk(delta="a"), chunk(delta="b"), DONE]],  # a chunk starts one message
        [[user(), BEGIN, loose, chunk(delta="a"), chunk(delta="b"), DONE], [BEGIN, loose, DONE]],
    )
    assert sorted(i[:8] for i in out["c0"]) == ["implicit", "m1"]
    assert set(out["c1"]) == {"m1", "m2"}
    assert sorted(m.content for m in out["c2"].values()) == ["Hi", "ab"]
    assert sorted(m.content for m in out["c3"].values()) == ["", "Hi", "ab"]


def test_a_burst_of_fifty_chunks(spark):
    run = [BEGIN, start("m2"), *[text("m2", f"{i};") for i in range(50)], end("m2"), DONE]
    _, out = fold(spark, [[user(), *run]])
    assert out["c0"]["m2"].content == "".join(f"{i};" for i in range(50))


KINDS = (
    *cv.TEXT, *cv.TOOL, *cv.THOUGHT, "THINKING_START", "THINKING_END", "STEP_STARTED", "STEP_FINISHED",
    "RUN_FINISHED", "RUN_ERROR", "RUN_STARTED",
)


def random_chat(rng, size):
    runs = []
    for _ in range(rng.randint(1, 4)):
        run = [user(f"u{rng.randint(0, 99)}") for _ in range(rng.randint(0, 2))]
        for _ in range(rng.randint(1, size)):
            kind = rng.choice(KINDS)
            e = ev(kind)
            if kind in cv.TEXT:
                e["message_id"] = rng.choice("abc") if kind != "TEXT_MESSAGE_CHUNK" or rng.random() < 0.6 else None
                e["delta"] = rng.choice(["x", "yz", "w "])
            elif kind in cv.TOOL:
                e["tool_call_id"] = rng.choice("pq") if kind != "TOOL_CALL_CHUNK" or rng.random() < 0.5 else None
                e["parent_message_id"] = rng.choice(["a", "b", None])
                e["delta"], e["content"], e["name"] = rng.choice("123"), rng.choice("RS"), rng.choice(["n1", "n2"])
            elif kind == "THINKING_START" or kind.startswith("STEP"):
                e["name"] = rng.choice(["s", "t"])
            elif kind == "RUN_ERROR":
                e["error_message"] = rng.choice(["bad", "worse"])
            elif kind == "THINKING_TEXT_MESSAGE_CONTENT":
                e["delta"] = rng.choice("kl")
            run.append(e)
        runs.append(run)
    return runs


def loop(rows):
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["chat_id"], r["seq"])):
        got = resolve_one(r["chat_id"], states.setdefault(r["chat_id"], {}), r)
        out[r["chat_id"], r["seq"]] = got
    return out


@pytest.mark.parametrize("chat_rows", [65_536, 20, 4, 1])
def test_batch_equals_an_event_by_event_loop(spark, chat_rows):
    rng = random.Random(11)
    rows = rows_of(*[random_chat(rng, 14) for _ in range(120)])
    want = loop(rows)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    resolved = cv.resolve_events(frame(spark, shuffled), chat_rows=chat_rows).collect()
    assert len(resolved) == len(rows)
    for r in resolved:
        w = want[r.chat_id, r.seq]
        got = (r.target_id, r.active_id, r.tool_id, r.active_tool and r.active_tool.asDict(), r.block, r.step, r.title)
        assert got == tuple(w.get(k) for k in ("target_id", "active_id", "tool_id", "active_tool", "block", "step", "title")), (r, w)
        assert (r.open_block and r.open_block.asDict()) == w.get("open_block"), (r, w)


def test_blocks_of_chats_without_names(spark):
    """Missing chats and runs are a chat and a run of their own, apart from empty names; no events give no rows."""
    rng = random.Random(23)
    rows = rows_of(*[random_chat(rng, 10) for _ in range(30)])
    for r in rows:
        r["chat_id"] = {"c0": None, "c1": ""}.get(r["chat_id"], r["chat_id"])
        r["run_id"] = {"r0": None, "r1": ""}.get(r["run_id"], r["run_id"])
    whole, cut = (sorted(map(str, cv.resolve_events(frame(spark, rows), chat_rows=n).collect())) for n in (65_536, 3))
    assert cut == whole and len(whole) == len(rows)
    assert cv._resolve_in_blocks(frame(spark, rows).limit(0), 3).count() == 0


def test_tasks_grow_with_events(spark, monkeypatch):
    rows = [dict(chat_id=f"c{i}", run_id="r", seq=0, type="MESSAGE", message_id=f"m{i}", content="x") for i in range(25)]
    events = spark.createDataFrame([{n: r.get(n) for n in cv.EVENT_FIELDS} for r in rows], cv.EVENT_SCHEMA)
    monkeypatch.setattr(cv, "TASK_EVENTS", 5)
    assert cv.resolve_events(events).rdd.getNumPartitions() == 5
    assert cv.resolve_events(events).filter("seq = 0").count() == 25
    assert cv.resolve_events(events.limit(0)).count() == 0
