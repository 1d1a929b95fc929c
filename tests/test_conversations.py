import datetime as dt
import json

from pyspark.sql import functions as F

from larder.operators import conversations as cv
from larder.operators.joins import nest_children
from larder.operators.ordering import newest_chats, page, page_after, transcript_order
from larder.operators.predicates import drop_health_checks, find_user
from larder.operators.windows import latest_open


def d(year):
    return dt.datetime(year, 1, 1)


def transcript_inputs(spark):
    messages = spark.createDataFrame(
        [
            ("c", "u1", "m1", "assistant", "gpt", "Machine message", d(2000), True, "message_error"),
            ("c", "u0", None, "user", "user1", "User message.", d(1940), False, None),
        ],
        "chat_id string, message_uuid string, public_id string, role string, name string, content string, created_at timestamp, in_progress boolean, error string",
    )
    tools = spark.createDataFrame(
        [
            ("u1", "u2", None, None, "tool1", "args1", "output1", d(1980), False, "Failed"),
            ("u1", "u3", "t2", "t2", "tool2", "args2", "", d(1970), True, None),
        ],
        "message_uuid string, uuid string, tool_call_id string, public_id string, name string, arguments string, content string, created_at timestamp, in_progress boolean, error string",
    )
    thoughts = spark.createDataFrame(
        [
            ("u1", "u5", "thought2", "", "", d(1960), True, None),
            ("u1", "u4", None, "Thinking", "Thoughts", d(1950), False, None),
        ],
        "message_uuid string, uuid string, public_id string, name string, content string, created_at timestamp, in_progress boolean, error string",
    )
    return messages, tools, thoughts


def test_transcript_order_and_defaults(spark):
    rows = transcript_order(cv.transcript(*transcript_inputs(spark))).collect()
    got = [(r.id, r.role, r.name, r.content, r.tool_call_id, r.in_progress, r.error) for r in rows]
    assert got == [
        ("u0", "user", "user1", "User message.", None, False, None),
        ("m1", "assistant", "gpt", "Machine message", None, True, "message_error"),
        ("t2", "tool", "tool2", "Completed tool2", "t2", True, None),
        ("u2", "tool", "tool1", "output1", "u2", False, "Failed"),
        ("u4", "reasoning", "Thinking", "Thoughts", None, False, None),
        ("thought2", "reasoning", "", "", None, True, None),
    ]


def test_nested_children(spark):
    messages, tools, thoughts = transcript_inputs(spark)
    rows = nest_children(messages, tools, "message_uuid", ["created_at", "uuid"], "calls").collect()
    got = {(r.message_uuid, r.calls_position): r.calls and r.calls.uuid for r in rows}
    assert got == {("u1", 0): "u3", ("u1", 1): "u2", ("u0", None): None}
    many = spark.range(25_000).selectExpr("'u1' AS message_uuid", "id AS created_at", "cast(id AS string) AS uuid")
    places = nest_children(messages, many, "message_uuid", ["created_at", "uuid"], "calls").filter("message_uuid = 'u1'")
    assert places.selectExpr("count(*)", "count_if(calls_position = calls.created_at)").first() == (25_000, 25_000)
    assert [r.uuid for r in latest_open(thoughts, "message_uuid", ["created_at"]).collect()] == ["u5"]


def test_tool_results_join_their_calls(spark):
    call = [{"id": "t1", "name": "n1", "arguments": '{"a": 1}'}, {"id": "t2", "name": "n2", "arguments": "not json"}]
    rows = [
        ("c", "m0", "user", "hello", []),
        ("c", "m1", "assistant", "", [(x["id"], x["name"], x["arguments"]) for x in call]),
        ("c", "t1", "tool", "result 1", []),
        ("c", "t9", "tool", "orphan", []),
        ("c2", "t2", "tool", "other chat", []),
        ("c", "t1", "tool", "a result before", []),
    ]
    df = spark.createDataFrame(rows, "chat_id string, id string, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>")
    got = {(r.chat_id, r.message_id, r.tool_call_id): r for r in cv.attach_tool_results(df).collect()}
    assert len(got) == 5
    assert (got["c", "m1", "t1"].state, got["c", "m1", "t1"].text, got["c", "m1", "t1"].arguments_are_json) == ("result", "result 1", True)
    assert (got["c", "m1", "t2"].state, got["c", "m1", "t2"].text, got["c", "m1", "t2"].arguments_are_json) == ("call", None, False)
    assert got["c", "t9", None].text == "orphan" and got["c2", "t2", None].text == "other chat"
    assert got["c", "m0", None].text == "hello"


def test_dedup_first_wins_and_new_non_user_messages_are_rejected(spark):
    rows = [("c", "m1", 0, "user"), ("c", "m1", 5, "user"), ("c", "m2", 1, "assistant"), ("c", "m3", 2, "assistant"), ("d", "m1", 0, "user")]
    incoming = spark.createDataFrame(rows, "chat_id string, message_id string, seq int, role string")
    stored = spark.createDataFrame([("c", "m3")], "chat_id string, message_id string")
    got = {(r.chat_id, r.message_id, r.seq): (r.status, r.error) for r in cv.dedup_messages(incoming, stored).collect()}
    error = "The user cannot create new non-user messages."
    assert got == {
        ("c", "m1", 0): ("accepted", None), ("c", "m1", 5): ("duplicate", None), ("c", "m2", 1): ("rejected", error),
        ("c", "m3", 2): ("duplicate", None), ("d", "m1", 0): ("accepted", None),
    }


def test_delete_cascades(spark):
    chats = spark.createDataFrame([("a",), ("b",)], "chat_id string")
    messages = spark.createDataFrame([("a", "1"), ("b", "2")], "chat_id string, message_uuid string")
    calls = spark.createDataFrame([("1", "x"), ("2", "y")], "message_uuid string, uuid string")
    left = cv.delete_chats(spark.createDataFrame([("a",)], "chat_id string"), chats, messages, tool_calls=calls)
    assert {n: [tuple(r) for r in df.collect()] for n, df in left.items()} == {
        "chats": [("b",)], "messages": [("b", "2")], "tool_calls": [("2", "y")],
    }


def test_partial_update(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    updates = spark.createDataFrame([("a", None, "z")], "k string, n int, s string")
    assert sorted(tuple(r) for r in cv.apply_partial(base, updates, "k").collect()) == [("a", 1, "z"), ("b", 2, "y")]


def test_identity_upsert_lookup_and_expiry(spark):
    schema = "provider_user_id string, provider_type string, user_id int, access_token string, access_token_expires_at timestamp"
    base = spark.createDataFrame([("p1", "g", 1, "old", d(2020)), ("p2", "g", 2, "keep", None)], schema)
    updates = spark.createDataFrame(
        [("p1", "g", 1, "new", None, 1), ("p1", "g", 7, None, d(2030), 2), ("p3", "h", 3, "t3", d(2019), 1), ("p3", "h", 3, "t4", None, 4)],
        schema + ", seq int",
    )
    got = cv.upsert_identities(base, updates)
    rows = {r.provider_user_id: tuple(r)[2:] for r in got.collect()}
    assert rows == {"p1": (7, "new", d(2030)), "p2": (2, "keep", None), "p3": (3, "t4", d(2019))}
    assert cv.identity_by_external(got, "g", "p1").first().user_id == 7
    now = F.lit(d(2025))
    assert [r.provider_user_id for r in cv.expired_tokens(got, now).collect()] == ["p3"]
    by_user = cv.upsert_identities(base, updates, ["user_id", "provider_type"])
    assert by_user.count() == 4


def test_payloads(spark):
    good = {
        "v": 1, "message_uuid": "u", "chat_id": None, "role": "assistant", "content": "​", "created_at": "2024-01-01T00:00:00Z",
        "tool_calls": [{"uuid": "t", "name": "n", "arguments": "​", "content": "r", "in_progress": False}],
    }
    bodies = [json.dumps(good), json.dumps({"v": 2, "message_uuid": "x"}), "junk", json.dumps({"v": 1, "message_uuid": "w"})]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = {r.message_uuid: r for r in cv.decode_payloads(df).collect()}
    assert set(got) == {"u", "w"}
    u, w = got["u"], got["w"]
    assert (u.role, u.content, u.in_progress, u.chat_id, u.created_at) == ("assistant", "", True, None, d(2024))
    assert (u.tool_calls[0].arguments, u.tool_calls[0].content, u.tool_calls[0].role, u.tool_calls[0].in_progress) == ("", "r", "tool", False)
    assert (w.role, w.name, w.content, w.tool_calls, w.reasonings) == ("user", "", "", [], [])


def test_lists_and_lookups(spark):
    chats = spark.createDataFrame([(i, d(2000 + i % 3)) for i in range(6)], "chat_id int, created_at timestamp")
    assert [r.chat_id for r in newest_chats(chats).collect()] == [2, 5, 1, 4, 0, 3]
    assert [r.chat_id for r in page(chats, ["chat_id"], 2, 2).collect()] == [2, 3]
    assert [r.chat_id for r in page_after(chats, "chat_id", 3).collect()] == [4, 5]
    users = spark.createDataFrame([(1, "u1", "a@x"), (2, "u2", "b@x")], "id int, uuid string, email string")
    assert [r.id for r in find_user(users, email="b@x").collect()] == [2]
    assert find_user(users).count() == 0
    logs = spark.createDataFrame([("GET /health 200",), ("POST /health",), ("GET /chat",), (None,)], "message string")
    assert drop_health_checks(logs).count() == 3 and drop_health_checks(logs, "debug").count() == 4
