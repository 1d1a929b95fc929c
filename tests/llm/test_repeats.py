"""Removed bytes against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from larder.llm import repeats

SCHEMA = "doc_id long, text string, kept string, n_chars long"


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def texts(length, n=60):
    rng = random.Random(length)

    def noise(k):
        return "".join(rng.choice("abcdefghij é\n") for _ in range(k))

    passages = [noise(rng.randint(length // 2, 4 * length)) for _ in range(6)]
    out = [None, "", "x" * (length - 1), "y" * length, "z" * (length + 1), "ab" * length, passages[0], passages[0]]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            parts.append(rng.choice([noise(rng.randint(0, 2 * length)), p, p[a:], p[:a], p[a : a + length], p[a : a + length + 3]]))
        out.append("".join(parts))
    copy = noise(6 * length)
    out += [copy, copy[: 3 * length] + "!" + copy[3 * length :], copy[1:], noise(3) + copy + noise(length), copy]
    return out


@pytest.mark.parametrize("length", [2, 3, 20, 64, 400])
def test_removed_bytes(spark, length):
    data = texts(length)
    rows = [(i, t, "clash", 0) for i, t in enumerate(data)]
    out = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), length).collect()}
    assert len(out) == len(rows)
    for i, (n, removed, spans, kept) in enumerate(plain(data, length)):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, removed, spans), (i, data[i])
        assert bytes(r["kept"]) == kept
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    long = "".join(random.Random(1).choices("abcdef", k=900))
    rows = [(1, long, "", 0), (1, long, "", 0), (None, long[::-1], "", 0), (None, None, "", 0), (2, "short", "", 0), (2, long[:450] + "?", "", 0)]
    out = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in out) == [
        ("1", 900, 900), ("1", 900, 900), ("2", 5, 0), ("2", 451, 450), ("None", 0, 0), ("None", 900, 0),
    ]
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_stay_whole_characters(spark):
    passage = "é" * 3 + "".join(random.Random(1).choices("abcdé", k=600))
    rows = [(1, "x€" + passage, "", 5), (2, "y¢" + passage + "end", "", 5), (3, None, "a", None), (4, "other", "", 5)]
    out = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "kept", "n_chars"]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "x€", 2), (2, "y¢end", 5), (3, None, None), (4, "other", 5)]
