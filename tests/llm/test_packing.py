"""Ids against the tokenizer itself, plans against plain best fit, packed pieces as a round trip."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from larder.llm import columns as C
from larder.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, ids int"
BITS = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "b", "ve", "Re", "1", "22", "!", "...", "é", "日本", "ß", "<|endoftext|>", "\x85", "​", "²", "😀", "͸", "'S", " ", "　"]


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(8000)] + ["", "x" * 5000, " " * 300]
    encode = tokens.Encoder(PATH)

    def ours(texts):
        ids, rows = encode(*C.utf8(pa.array(texts)))
        return [ids[rows[i] : rows[i + 1]].tolist() for i in range(len(texts))]

    want = plain_ids(texts)
    assert ours(texts) == want
    assert ours(texts) == want  # now from memory
    monkeypatch.setattr(tokens, "KEPT_WORDS", 100)
    assert ours(texts[:50]) == want[:50]
    assert ours([]) == [] and ours(["", ""]) == [[], []]


def test_more_different_words_than_slots(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 100)
    monkeypatch.setattr(tokens, "SLOT_BITS", 8)
    encode, text = tokens.Encoder(PATH), " ".join(f"w{i}" for i in range(3000))
    for t in (text, "a b", text):
        assert encode(*C.utf8(pa.array([t])))[0].tolist() == plain_ids([t])[0]


@pytest.mark.parametrize("capacity", [7, 20, 64, 1024])
def test_plan_is_as_good_as_plain_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(60):
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        bins, seen = {}, set()
        for length, first, end, sequence, each, base in packing.plan(counts, capacity):
            for r in range(first, end):
                seen.add((length, r))
                bins.setdefault(sequence + (r - first) // each, []).append((base + (r - first) % each * length, length))
        assert seen == {(n, r) for n, c in counts.items() for r in range(c)}
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
            assert sum(3 * n > capacity for _, n in places) <= 2
        gaps = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
            if fits:
                gaps[min(fits)[1]] -= n
            else:
                gaps.append(capacity - n)
        assert len(bins) <= len(gaps)


def test_plan_size_depends_on_the_capacity_alone():
    small = packing.plan({n: 3 for n in range(1, 1025)}, 1024)
    large = packing.plan({n: 3_000_000 + n * n for n in range(1, 1025)}, 1024)
    assert len(large) < 4 * 1024 and len(small) < 4 * 1024


def test_packed_pieces(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "word " * 5000, "x\n" * 1024] + [" ".join(rng.choice(["the", "naïve", "fox", "1234"]) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[7], (None, "no id", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    packed = packing.pack_documents(docs, PATH, ids=True)
    out = packed.collect()
    want = [x + [2] for x in plain_ids([r[1] or "" for r in rows])]
    by_doc = {}
    for r in out:
        assert len(r["ids"]) == r["length"] <= 1024
        assert zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id in {r[0] for r in rows}:
        copies = [w for r, w in zip(rows, want) if r[0] == doc_id]
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])[:: len(copies)]
        assert len(by_doc[doc_id]) == len(own) * len(copies)
        assert [x for r in own for x in r["ids"]] == copies[0]
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert all(r["length"] == 1024 for r in own[1:])
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append(r)
    for x in places.values():
        at = 0
        for r in sorted(x, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(places) <= -(-sum(r["length"] for r in out) // 1024) * 1.05 + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert sorted(map(len, whole.values())) == sorted(sum(r["length"] for r in x) for x in places.values())
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
