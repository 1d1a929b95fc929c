"""The stages in turn, each against plain Python on its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from larder.llm import language, mixing

from .test_near import plain as plain_components
from .test_packing import plain_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows of documents with odd ones among them, and the rows after each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9001, None, "en", "src0", None), (9002, "", None, None, 0), (9003, "12 34 56", "en", "src1", 8), (9004, "жжж щщщ ъъъ " * 80, "en", "src2", 960)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(folder / "documents.parquet"))
    at = spark.read.parquet(str(folder / "documents.parquet"))
    out = [[r.asDict() for r in at.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(folder)).write.parquet(str(folder / name))
        at = spark.read.parquet(str(folder / name))
        out.append([r.asDict() for r in at.collect()])
        assert name == "pack" or at.columns == COLUMNS
    return str(folder), out


def key(rows):
    return sorted(map(str, rows))


def test_language(spark, tables):
    folder, (given, kept, *_) = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rejected = {r["doc_id"] for r in language.annotate(docs, language.learn(docs)).filter("language.rejected").collect()}
    assert rejected >= {9001, 9002, 9003, 9004}
    assert len(rejected) <= 5
    assert key(kept) == key(r for r in given if r["doc_id"] not in rejected)


def test_near_duplicates(tables):
    _, (_, given, kept, *_) = tables
    _, components = plain_components([(r["doc_id"], r["text"]) for r in given], 5)
    assert key(kept) == key(r for r, c in zip(given, components) if r["doc_id"] == c)
    assert len(kept) < len(given)


def plain_cut(texts, length, words):
    """Each text without runs of repeated strings that have so many whole words."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept, at = b"", 0
        for run in re.finditer(rb"\x01+", bytes(gone)):
            inside = [w for w in re.finditer(rb"[^\x20\x09-\x0D]+", x) if run.start() <= w.start() and w.end() <= run.end()]
            if len(inside) >= words:
                kept, at = kept + x[at : run.start()], run.end()
        out.append((kept + x[at:]).decode("utf-8", "ignore"))
    return out


def test_repeats(tables):
    _, (_, _, given, cut, *_) = tables
    by_id = {r["doc_id"]: r for r in cut}
    assert len(by_id) == len(cut) == len(given)
    for r, text in zip(given, plain_cut([r["text"] for r in given], corpus_pipeline.PASSAGE_BYTES, 50)):
        assert by_id[r["doc_id"]] == r | {"text": text, "n_chars": len(text)}


def test_repeats_cut_passages_of_fifty_words_alone(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    planted, short = [prose(rng.randint(51, 80)) for _ in range(10)], prose(42)
    rows = [(i, f"{prose(90)} {planted[i % 10]} {prose(30)}") for i in range(30)] + [(i, f"{prose(100)} {short}") for i in range(30, 40)]
    at = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["repeats"](spark, at, str(tmp_path)).collect()}
    for i, t in rows[:30]:
        assert planted[i % 10] not in cut[i] and 0 <= len(t) - len(planted[i % 10]) - len(cut[i]) <= 8
    assert all(cut[i] == t for i, t in rows[30:])


def test_mix(spark, tables):
    folder, (_, _, _, given, taken, _) = tables
    often = {r["doc_id"]: r["repeats"] for r in mixing.mix(spark.read.parquet(f"{folder}/repeats")).collect()}
    assert Counter(r["doc_id"] for r in taken) == Counter({k: n for k, n in often.items() if n})
    rows = {r["doc_id"]: r for r in given}
    assert all(rows[r["doc_id"]] == r for r in taken)


def test_pack(tables):
    *_, given, packed = tables[1]
    ids = [x + [2] for x in plain_ids([r["text"] for r in given])]
    assert sum(r["length"] for r in packed) == sum(map(len, ids))
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append(r)
    for x in places.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(places) <= 1.02 * sum(map(len, ids)) / 1024 + 1


def test_run_gives_the_same(spark, tables):
    folder, (*_, packed) = tables
    named = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert key([r[k] for k in named] for r in corpus_pipeline.run(spark, folder).collect()) == key([r[k] for k in named] for r in packed)


def test_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_keep_their_text_through_the_repeats_stage(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(200))
    other = " ".join(f"other{i}" for i in range(200))
    rows = [(1, text, "en", "src0", len(text))] * 2 + [(None, other, "en", "src0", len(other))] * 2
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near_duplicates", "repeats"):
        at = stages[name](spark, at, str(tmp_path))
    assert key(tuple(r) for r in at.collect()) == key(set(rows))
