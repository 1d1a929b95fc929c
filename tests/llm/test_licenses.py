"""Statements that are planted in texts, whole and with changed words."""

import duckdb
import random

import pytest

from larder.llm import licenses

SCHEMA = "doc_id long, text string, license string"
ALL = [(name, t) for name, texts in licenses.TEMPLATES.items() for t in texts]


@pytest.fixture(scope="module")
def matcher():
    return licenses.Matcher(licenses.TEMPLATES)


@pytest.mark.parametrize("name, text", ALL)
def test_templates_are_found_in_other_text(matcher, name, text):
    whole = f"The quick fox ran home. It was late.\n{text}\nAnd so they lived on."
    found = [(whole[a:b][s:e], n, d) for a, b in licenses.candidates(whole) for s, e, n, _, d in matcher.statements(whole[a:b])]
    assert [(n, d) for _, n, d in found] == [(name, 0)]
    assert found[0][0].split()[:3] == text.split()[:3]


def test_changed_words(matcher):
    text = licenses.TEMPLATES["Apache-2.0"][1]
    few = text.replace("this file", "this script").replace("agreed", "consented")
    assert [(n, d > 0) for _, _, n, _, d in matcher.statements(few)] == [("Apache-2.0", True)]
    words = text.split()
    random.Random(1).shuffle(words)
    assert matcher.statements(" ".join(words)) == []
    assert matcher.statements("Licensed under the Apache License, Version 3.0.") == []
    assert matcher.statements("You need a license to drive, and permission to park.") == []


def test_compression_ranks_the_template_first(matcher):
    for i, (name, text) in enumerate(ALL):
        saved = matcher.reductions(("Notice. " + text).encode())
        assert saved[i] >= max(saved) - 0.01, name


def test_many_statements_in_one_block(matcher):
    """More than a few templates, behind other words, with short statements after long ones that are like each other."""
    long = [(name, t) for name, t in ALL if len(t.split()) >= 20]
    short = [(name, t) for name, t in ALL if len(t.split()) < 20]
    assert len(long) > 4
    for planted in (ALL, ALL[::-1], long + short[:1], [*long, *long, *short[-2:]]):
        block = " ".join(["This project has several licenses.", *[t for _, t in planted]])
        found = matcher.statements(block)
        assert [(n, d) for _, _, n, _, d in found] == [(n, 0) for n, _ in planted]
        assert all(block[a:b] == t.rstrip("./") for (a, b, *_), (_, t) in zip(found, planted))


def test_a_changed_statement_beside_words_it_shares_with_others(matcher):
    text = dict(ALL)["Apache-2.0"]
    few = text.replace("this file", "this script")
    block = f"You may not use it here. {few} " + " ".join(t for n, t in ALL if n != "Apache-2.0")
    assert [(n, d) for _, _, n, _, d in matcher.statements(block)] == [("Apache-2.0", 1), *[(n, 0) for n, _ in ALL if n != "Apache-2.0"]]


def test_texts(spark):
    both = "A. Released under the MIT License. B. Licensed under CC BY-NC 4.0. C"
    rows = [(1, both, ""), (2, None, ""), (3, "", ""), (4, "no such thing", ""), (5, "words. " * 30_000 + "\nLicensed under CC BY 4.0.", ""), (None, both, ""), (1, both, "")]
    out = licenses.statements(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in out) == sorted([("1", "MIT"), ("1", "CC-BY-NC-4.0")] * 2 + [("None", "MIT"), ("None", "CC-BY-NC-4.0"), ("5", "CC-BY-4.0")])
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]].startswith(("Released", "Licensed"))
    assert licenses.statements(spark.createDataFrame([], SCHEMA)).collect() == []


def test_against_plain_search(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    short = [(name, t) for name, t in ALL if len(t.split()) < 20]
    want = sorted((d, name) for d, text in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{path}')").fetchall() for name, t in short for _ in range(text.count(t)))
    assert want
    out = licenses.statements(spark.read.parquet(path)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in out) == want
