import datetime as dt
import hashlib
import uuid
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from larder.functions import scalars as sc
from larder.functions import text as tx

U = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"


def column(spark, expr, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[1] for r in sorted(spark.createDataFrame(rows, f"i int, x {kind}").select("i", expr).collect())]


def values(spark, *exprs):
    return list(spark.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first())


def test_duration_seconds(spark):
    given = ["5", "5s", "5.5s", "500ms", " 7 ", "x", "5m", "", None, "1.2.3", "s"]
    want = [5.0, 5.0, 5.5, 0.5, 7.0, None, None, None, None, None, None]
    assert column(spark, tx.duration_seconds("x"), given) == want


def test_language_of(spark):
    given = ["en-US", "PT_br", "ja", "de-DE", None, "", "fr-CA_x"]
    assert column(spark, tx.language_of("x"), given) == ["en", "pt", "ja", "en", "en", "en", "fr"]


def test_dedup_key(spark):
    want = hashlib.sha256("chat\0a\0b".encode()).hexdigest()
    assert values(spark, tx.dedup_key("chat", F.lit("a"), F.lit("b"))) == [want]


def test_encode_segment(spark):
    given = ["a b/c", "x@y.z", "é~*+&", "-_.", "100%"]
    assert column(spark, tx.encode_segment("x"), given) == [quote(v, safe="") for v in given]


def test_chat_title(spark):
    given = ["  Hello there, this is long", "   ", None, "", "short"]
    assert column(spark, tx.chat_title("x"), given) == ["Hello there, this", "New Chat", "New Chat", "New Chat", "short"]


def test_word_count(spark):
    assert column(spark, tx.word_count("x"), ["a b  c", " x\ty\n", "", None, "one"]) == [3, 2, 0, 0, 1]


def test_redact_text(spark):
    given = [
        "access_token=abc, next", "ACCESS_TOKEN='a.b' x", 'refresh_token="q" (access_token=z)', "nothing here", "access_token= x",
    ]
    assert column(spark, tx.redact_text("x"), given) == [
        "access_token=[REDACTED], next", "access_token='[REDACTED]' x",
        'refresh_token="[REDACTED]" (access_token=[REDACTED])', "nothing here", "access_token= x",
    ]


def test_redact_json(spark):
    given = [
        '{"access_token": "a\\"b", "n": 1}', '{"a": {"refresh_token": 5, "k": [{"access_token": null}]}}',
        '{"access_token": {"x": "y"}, "other": "access_token"}', '{"my_access_token_2": "keep"}',
        '{"access_token": {"a": {"b": "secret"}}, "c": [1]}', '[{"access_token": [[1, "s2"], "s3"]}, 7]', '{"access_token": {"cut": "sec', None,
    ]
    assert column(spark, tx.redact_json("x"), given) == [
        '{"access_token": "[REDACTED]", "n": 1}', '{"a": {"refresh_token": "[REDACTED]", "k": [{"access_token": "[REDACTED]"}]}}',
        '{"access_token": "[REDACTED]", "other": "access_token"}', '{"my_access_token_2": "keep"}',
        '{"access_token": "[REDACTED]", "c": [1]}', '[{"access_token": "[REDACTED]"}, 7]', '{"access_token": "[REDACTED]"', None,
    ]


def test_extras_text(spark):
    got = values(spark, tx.extras_text(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))))
    assert got == ["a=1 | b=2"]


def test_error_and_first_text(spark):
    none = F.lit(None).cast("string")
    got = values(spark, tx.error_text(F.lit("E"), F.lit("m")), tx.error_text(none, F.lit("m")), tx.error_text(F.lit(""), F.lit("m")))
    assert got == ["[E] m", "m", "m"]
    given = ['{"content": " a "}', '{"content": "", "text": "b"}', '{"text": "  "}', "{}", '{"content": "c", "text": "d"}']
    assert column(spark, tx.first_text("x"), given) == ["a", "b", None, None, "c"]


def test_ids_from_uuids(spark):
    digest = hashlib.sha256(uuid.UUID(U).bytes).digest()
    want = int.from_bytes(digest[:4], "big") & 0x7FFFFFFF
    assert values(spark, tx.synthetic_id(F.lit(U))) == [want]
    given = ["  507F1F77bcf86cd799439011 ", "short", None, "z" * 24]
    fallback = digest.hex()[:24]
    assert column(spark, tx.participant_id("x", F.lit(U)), given) == ["507f1f77bcf86cd799439011", fallback, fallback, fallback]


def test_times(spark):
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "nope", None]
    got = column(spark, F.date_format(tx.parse_iso("x"), "yyyy-MM-dd HH:mm:ss"), given)
    assert got == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", None, None]
    ms = F.date_format(tx.from_epoch_ms(F.lit(1_700_000_000_123)), "yyyy-MM-dd HH:mm:ss.SSS")
    assert values(spark, ms, tx.probably_seconds(F.lit(1_700_000_000))) == ["2023-11-14 22:13:20.123", True]
    now = F.lit(dt.datetime(2024, 1, 1, 12, 0, 0))
    expiry = [dt.datetime(2024, 1, 1, 12, 1, 0), dt.datetime(2024, 1, 1, 12, 0, 59), None]
    assert column(spark, sc.is_expired("x", now), expiry, "timestamp") == [False, True, False]


def test_placeholder_and_role(spark):
    assert column(spark, tx.strip_placeholder("x"), ["​", None, "", "a"]) == ["", "", "", "a"]
    assert column(spark, tx.add_placeholder("x"), [None, "", "a"]) == ["​", "​", "a"]
    assert column(spark, tx.display_role("x"), ["developer", "tool", "activity", "user"]) == ["system"] * 3 + ["user"]


def test_numbers(spark):
    got = values(
        spark, sc.safe_ratio(F.lit(1), F.lit(0)), sc.safe_ratio(F.lit(1), F.lit(None).cast("int")), sc.safe_ratio(F.lit(1), F.lit(4)),
        sc.pick(["a", "b"], F.lit(-1)), sc.clamp(F.lit(7), 1, 5), sc.round_to(F.lit(0.125), 2), sc.cast_to(F.lit("x"), "int", False),
        sc.hash_fraction(F.lit("k")) == sc.hash_fraction(F.lit("k")), sc.ceil_int(F.lit(1.2)), sc.floor_int(F.lit(-1.2)),
    )
    assert got == [0.0, 0.0, 0.25, "b", 5, 0.13, None, True, 2, -2]
    with pytest.raises(ValueError):
        sc.band("x", [1, 2], ["a"])


def test_padded_id(spark):
    assert column(spark, sc.padded_id("ORD", "x", 5), [0, 42, 99999, 1234567], "bigint") == ["ORD-00000", "ORD-00042", "ORD-99999", "ORD-1234567"]


def test_hash_fraction_is_in_range_and_even(spark):
    r = spark.range(10_000).select(sc.hash_fraction("id").alias("f")).agg(F.min("f"), F.max("f"), F.avg("f")).first()
    assert r[0] >= 0 and r[1] < 1 and abs(r[2] - 0.5) < 0.02
