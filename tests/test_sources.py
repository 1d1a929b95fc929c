import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from larder.operators.checks import provenance_check
from larder.sources import envelopes as en
from larder.sources import tables as tb


def test_catalog_tables(spark):
    tb.ensure_schema(spark, "readiness", use=False)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, p string")
    tb.write_table(df, "readiness.facts", ["p"], "It's a fact")
    assert tb.table_counts({"facts": tb.read_table(spark, "readiness.facts")}).first() == ("facts", 3)
    listed = {r.table_name for r in tb.list_tables(spark, "readiness").collect()}
    assert listed == {"facts"}
    df.createOrReplaceTempView("facts_view")
    assert {r.table_name for r in tb.list_tables(spark, "readiness", views=True).collect()} >= {"facts", "facts_view"}
    comment = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED readiness.facts").collect()}["Comment"]
    assert comment == "It's a fact"
    tb.write_table(df.withColumn("extra", F.lit(1)).filter("id > 1"), "readiness.facts")
    again = tb.read_table(spark, "readiness.facts")
    assert again.columns == ["id", "p", "extra"] and again.count() == 2
    tb.write_table(df, "readiness.stays")
    assert tb.drop_known(spark, "readiness", ["facts", "never_there"]) == ["facts"]
    assert [r.table_name for r in tb.list_tables(spark, "readiness").collect()] == ["stays"]
    tb.drop_known(spark, "readiness", ["stays"])


def test_overwrite_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string").write.partitionBy("p").parquet(path)
    tb.overwrite_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "p").collect()) == [(1, "a"), (9, "b")]


def test_table_sizes(spark, tmp_path):
    (tmp_path / "big").mkdir()
    (tmp_path / "small").mkdir()
    (tmp_path / "big" / "x").write_bytes(b"0" * 3_000_000)
    (tmp_path / "big" / "y").write_bytes(b"0" * 10)
    (tmp_path / "small" / "z").write_bytes(b"0" * 5)
    rows = tb.table_sizes(spark, {"small": str(tmp_path / "small"), "big": str(tmp_path / "big")}).collect()
    assert [tuple(r) for r in rows] == [("big", 2, 3_000_010, 2.86), ("small", 1, 5, 0.0)]


def test_sections(spark, tmp_path):
    line = '"Keep 30 days, or ""more"".","p.md","MED-STOCK-6505","T","2.1","stocking","A","2026-08-11","true","x; y"\n'
    head = "document,document_file_path,policy_reference_id,policy_title,section_id,policy_type,authority,effective_date,synthetic_policy,applies_to\n"
    (tmp_path / "s.csv").write_text(head + line)
    (row,) = tb.read_sections(spark, str(tmp_path / "s.csv")).collect()
    assert (row.document, row.effective_date, row.synthetic_policy) == ('Keep 30 days, or "more".', dt.date(2026, 8, 11), True)


def test_requests_csv(spark, tmp_path):
    rows = [("e", "t", "r", 0, "finished", 1.23456, None, 200, None), ("e", "t", "r", 1, "error", 2.0, 0.5, None, "bad, \"x\"")]
    schema = "user_email string, thread_id string, run_id string, message_index int, outcome string, total_duration_s double, ttft_s double, http_status int, error_detail string"
    tb.write_requests_csv(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / "out"))
    (path,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    with open(path) as f:
        first, second = sorted(csv.DictReader(f, escapechar="\\"), key=lambda r: r["message_index"])
    assert (first["total_duration_s"], first["ttft_s"], first["http_status"], first["error_detail"]) == ("1.2346", "", "200", "")
    assert (second["ttft_s"], second["http_status"]) == ("0.5000", "")


def test_metrics_need_every_field(spark):
    good = ("s", "m", 1.0, "u", "p", "https://example.org", "n")
    assert provenance_check(tb.reference_metrics(spark, [good])).first().without_source == 0
    with pytest.raises(Exception):
        tb.reference_metrics(spark, [(*good[:5], None, "n")]).collect()
    bad = spark.createDataFrame([(*good[:5], "", "n", True)], "scope string, metric_name string, v double, unit string, period string, source_url string, notes string, made boolean")
    assert tuple(provenance_check(bad, "made").first()) == (1, 1, 1)


def test_literals_and_ranges(spark):
    df = tb.literal_table(spark, [(1, "a", True), (2, "b", False)], ["n", "s", "f"])
    assert [tuple(r) for r in df.collect()] == [(1, "a", True), (2, "b", False)]
    assert [r.k for r in tb.number_range(spark, 3, "k").collect()] == [0, 1, 2]
    days = [r.d for r in tb.date_spine(spark, dt.date(2024, 2, 28), 3, "d").collect()]
    assert days == [dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 1)]


def test_event_envelopes(spark):
    body = {
        "events": [
            {"type": "RUN_STARTED"},
            {"type": "TEXT_MESSAGE_CONTENT", "messageId": "m", "delta": "hi", "timestamp": 1000, "role": None},
            {"type": "TOOL_CALL_START", "toolCallId": "t", "toolCallName": "n", "parentMessageId": "m"},
            {"type": "THINKING_TEXT_MESSAGE_CONTENT", "delta": ["a", "b"]},
            {"type": "RUN_ERROR", "message": "bad", "code": "E"},
            {"type": "RUN_FINISHED"},
        ]
    }
    rows = [("c", "r", 10, json.dumps(body)), ("c", "r", 20, '{"events": null}'), ("c", "r", 30, "junk")]
    df = spark.createDataFrame(rows, "chat_id string, run_id string, base_seq bigint, body string")
    got = en.explode_event_envelopes(df).orderBy("seq").collect()
    assert [(r.seq, r.type) for r in got] == [
        (11, "TEXT_MESSAGE_CONTENT"), (12, "TOOL_CALL_START"), (13, "THINKING_TEXT_MESSAGE_CONTENT"), (14, "RUN_ERROR"),
    ]
    assert (got[0].message_id, got[0].delta, got[0].role, got[0].ts) == ("m", "hi", None, dt.datetime(1970, 1, 1, 0, 0, 1))
    assert (got[1].name, got[1].parent_message_id) == ("n", "m")
    assert (got[2].delta, got[2].delta_list) == (None, ["a", "b"])
    assert (got[3].error_code, got[3].error_message) == ("E", "bad")


def envelope(columns, rows):
    return json.dumps({"statement_response": {"manifest": {"schema": {"columns": columns}}, "result": {"data_array": rows}}})


def test_manifest_rows(spark):
    many = [[str(i), "x"] for i in range(60)]
    rows = [
        (1, envelope([{"name": "a"}, {"type": "s"}, {"name": "c"}], [["1", "2", "3"], ["4"], "no list"])),
        (2, envelope([{"name": "a"}, {"name": "b"}], many)),
        (3, "[1, 2]"),
        (4, '{"statement_response": 5}'),
        (5, "{}"),
        (6, envelope([{"name": "a"}, {"name": "a"}, {"name": "b"}], [["1", "2", "3"]])),
    ]
    out = en.manifest_to_rows(spark.createDataFrame(rows, "id int, body string")).orderBy("id", "row_number").collect()
    first = [r.values for r in out if r.id == 1]
    assert first == [{"a": "1", "column_1": "2", "c": "3"}, {"a": "4", "column_1": None, "c": None}]
    assert [r.values["a"] for r in out if r.id == 2] == [str(i) for i in range(60)]
    assert [r.values for r in out if r.id == 6] == [{"a": "2", "b": "3"}]
    capped = en.manifest_to_rows(spark.createDataFrame(rows[1:2], "id int, body string"), cap=50)
    assert capped.count() == 50
    assert {r.id for r in out} == {1, 2, 6}


def test_json_document(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(60)], "k int, v string")
    doc = json.loads(en.to_json_document(df, "predictions", "which?", ["k"], "text").first().document)
    assert (doc["source"], doc["question"], doc["summary"]) == ("predictions", "which?", "text")
    assert [r["k"] for r in doc["rows"]] == list(range(60)) and doc["rows"][1] == {"k": 1, "v": "v1"}
