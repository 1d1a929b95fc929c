"""Edits against a plain loop, likeness against the exact share of common shingles."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import columns as C
from larder.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, fingerprint string"


def shingles(text, size=5):
    words = (text or "").split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def share(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def rows():
    rng = random.Random(2)
    vocabulary = [f"mot{i}é" for i in range(400)]
    texts = [None, "", "one", "日本語 😀 text", " "] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 700))) for _ in range(150)]
    texts.append("long text " * 20_000)
    ids = rng.sample(range(-1000, 100_000), len(texts))
    return [(i, t, "clash") for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def found(spark):
    data = rows()
    out = fp.near_edits(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    return sorted(data), {r["doc_id"]: r for r in out}, len(out)


def test_edits(found):
    data, out, n = found
    assert n == len(data)
    for k, (i, text, _) in enumerate(data):
        text, after = text or "", data[(k + 1) % len(data)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + (after[1] or "")[:cut]
        r = out[i]
        assert r["next_doc_id"] == after[0]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == (fp.BINS if text.split() else 0)
        assert r["near_edited"] == pytest.approx(share(text, edited), abs=0.16)
        assert r["near_next"] == pytest.approx(share(text, after[1]), abs=0.16)


def test_equal_texts_have_equal_fingerprints(spark):
    data = rows()
    twice = [*data, *[(1_000_000 + i, t, x) for i, t, x in data]]
    by_id = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(spark.createDataFrame(twice, SCHEMA)).collect()}
    assert all(by_id[i] == by_id[1_000_000 + i] for i, _, _ in data)


def test_likeness_is_unbiased():
    rng = random.Random(4)
    make = fp.Fingerprinter()
    for total, common in ((2000, 1600), (2000, 1000), (300, 150), (60, 30)):
        errors = []
        for _ in range(60):
            words = [f"w{rng.random()}" for _ in range(2 * total - common)]
            a, b = " ".join(words[:total]), " ".join(words[total - common :])
            values, some = make(*C.utf8(pa.array([a, b])))
            errors.append(fp.likeness(values[:1], some[:1], values[1:], some[1:])[0] - share(a, b))
        assert abs(np.mean(errors)) < 0.02
        assert np.std(errors) < 0.07


def test_odd_tables(spark):
    assert fp.near_edits(spark.createDataFrame([], SCHEMA)).collect() == []
    out = fp.near_edits(spark.createDataFrame([(7, "a b c d", "")], SCHEMA)).collect()
    assert out[0]["next_doc_id"] == 7 and out[0]["near_next"] == 1.0
    out = fp.near_edits(spark.createDataFrame([(None, "x", ""), (1, "b", ""), (1, "a", ""), (1, "a", "")], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["next_doc_id"])) for r in out) == [("1", "1"), ("1", "1"), ("1", "None"), ("None", "1")]
