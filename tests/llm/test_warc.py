"""Archives as a round trip: what is read back is what the pages say."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from larder.llm import warc

SCHEMA = "page_id long, url string, html string, record string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages():
    big = "<p>é€😀 line\r\n\r\nWARC/1.1\r\n</p>" * 5000
    rows = [
        (3, "http://a/3", "same"), (1, "http://a/1", "same"), (7, "http://a/7\n x ", "same"), (4, None, None), (2, "u", ""), (5, "u", big),
        (6, "u", big), (8, "u", "x" * 200_000), (9, "u", "é" * 64), (10, "u", "\r\n\r\n"), (11, "u", "line\n"),
    ]
    return [(*r, "clash") for r in rows]


@pytest.mark.parametrize("chunk", [4, 100, 1 << 16])
def test_round_trip(spark, tmp_path, chunk):
    rows = [r for r in pages() if chunk > 4 or len(r[2] or "") < 1000]
    path = str(tmp_path / "w")
    out = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(3), path, chunk_bytes=chunk).collect()}
    assert len(out) == len(rows)
    for page_id, _, html, _ in rows:
        first = min(i for i, _, h, _ in rows if (h or "") == (html or ""))
        r = out[page_id]
        assert r["payload_bytes"] == len((html or "").encode())
        assert r["payload_digest"] == digest(html)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == page_id else ("revisit", first))


def test_chunks_carry_running_digests(spark):
    text = "aé" * 1000
    rows = warc.chunk_table(spark.createDataFrame([(1, "u", text, "")], SCHEMA), chunk_bytes=64).collect()
    assert [r["chunk"] for r in rows] == list(range(len(rows))) and len(rows) > 40
    assert "".join(r["payload"] for r in rows) == text
    so_far = b""
    for r in rows:
        so_far += r["payload"].encode()
        assert len(r["payload"].encode()) <= 64
        assert r["bytes_so_far"] == len(so_far)
        assert r["digest_so_far"] == base64.b32encode(hashlib.sha1(so_far).digest()).decode()


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")]
    out = warc.archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), least_bytes=5).collect()
    assert {r["page_id"]: r["refers_to"] for r in out} == {1: None, 2: None, 3: None, 4: 3}


def test_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "u", "ab", ""), (1, "u", "ab", ""), (None, "u", "ab", ""), (None, "u", "cd", ""), (None, None, "cd", "")]
    out = warc.archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w")).collect()
    assert sorted((str(r["page_id"]), r["record_type"]) for r in out) == [("1", "response")] * 2 + [("None", "response")] * 2 + [("None", "revisit")]
    assert warc.archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).collect() == []


def test_archives_are_warc_files(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archives(warc.chunk_table(spark.createDataFrame(pages(), SCHEMA).coalesce(1)), str(path), records=4)
    files = sorted(Path(path).glob("*.gz"))
    assert len(files) > 1
    for f in files:
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            n = int(head.rpartition(b"Content-Length: ")[2])
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]


def test_damage_is_found(spark, tmp_path):
    rows = warc.chunk_table(spark.createDataFrame([(1, "u", "abc", "")], SCHEMA))
    warc.write_archives(rows.selectExpr("* except (digest)", "'WRONG' AS digest").select(rows.columns), str(tmp_path / "w"))
    with pytest.raises(Exception, match="digest"):
        warc.records(warc.read_parts(spark, str(tmp_path / "w"))).collect()
