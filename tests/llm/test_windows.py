"""Plans as an exact cover of rests and sequences, pieces as a round trip of the tokenizer's ids."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm import windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, length string, ids int, at string"


def placed(counts, capacity):
    """By rest what is where, by sequence what is in it."""
    rests, sequences = {}, {}
    for length, first, stop, at, size, sequence, place, step in windows.plan(counts, capacity):
        for r in range(first, stop):
            s, offset = divmod(place + (r - first) * step, capacity)
            here = min(size, capacity - offset)
            for a, n, q, o in [(at, here, sequence + s, offset), (at + here, size - here, sequence + s + 1, 0)]:
                if n:
                    rests.setdefault((length, r), []).append((a, n))
                    sequences.setdefault(q, []).append((o, n))
    return rests, sequences


def gapless(parts):
    at = 0
    for a, n in sorted(parts):
        assert a == at and n > 0
        at += n
    return at


@pytest.mark.parametrize("capacity", [1, 8, 64, 1024])
def test_plan_covers_all_without_padding(capacity):
    rng = random.Random(capacity)
    cases = [{}, {1: 1}, {capacity: 3}, {1: 2 * capacity + 3}, {max(1, capacity // 3): 50}]
    cases += [{rng.randint(1, capacity): rng.randint(0, 60) for _ in range(rng.randint(1, 60))} for _ in range(12)]
    for counts in cases:
        rests, sequences = placed(counts, capacity)
        assert {k: gapless(x) for k, x in rests.items()} == {(n, r): n for n, c in counts.items() for r in range(c)}
        total = [gapless(x) for x in sequences.values()]
        assert all(n & (n - 1) == 0 and n <= capacity for n in total)
        assert sorted(sequences) == list(range(len(sequences))) and sum(n < capacity for n in total) <= 10


def test_least_squares_finds_the_mix():
    ways = windows.combinations(np.array([10, 20, 30, 44, 64, 54]), 64)
    assert {tuple(w) for w in ways.tolist()} == {(64, 0, 0), (54, 10, 0), (44, 20, 0), (44, 10, 10)}
    counts = np.zeros(65)
    counts[[64, 54, 10, 44, 20]] = 5, 7, 7 + 6, 3 + 2, 2
    used = np.bincount(ways.ravel(), np.repeat(windows.least_squares(ways, counts, 64), 3), 65)[1:]
    assert np.abs(used - counts[1:]).max() < 0.05 and windows.least_squares(ways, counts, 64).min() >= 0


def test_few_are_cut_and_the_plan_stays_small():
    rng = random.Random(5)
    counts = {n: rng.randint(20, 40) for n in range(1, 1024)}
    rows = windows.plan(counts, 1024)
    line = sum((stop - first) * n for n, first, stop, _, _, _, _, step in rows if step < 1024)
    assert line < 0.25 * sum(n * c for n, c in counts.items())
    assert len(windows.plan({n: c * 10**8 for n, c in counts.items()}, 1024)) < 30_000


def plain_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "word " * 5000, "x\n" * 1024] + [" ".join(rng.choice(["the", "naïve", "fox", "1234"]) for _ in range(rng.randint(0, 900))) for _ in range(150)]
    rows = [(i, t, "clash", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[9]] * 200 + [rows[3], (None, "no id", "", 1, ""), (None, "no id", "", 1, ""), (7, "another text", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = windows.pack_windows(docs, PATH).collect()
    ids = plain_ids([r[1] for r in rows])
    want, have = {}, {}
    for r, x in zip(rows, ids):
        want.setdefault((r[0], len(x)), []).append(x)
    for r in out:
        have.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        x = want[r["doc_id"], r["doc_tokens"]][0][r["start"] : r["start"] + r["length"]]
        assert len(x) == r["length"] and zlib.crc32(struct.pack(f"<{len(x)}I", *x)) == r["ids_crc32"]
    assert set(have) == set(want)
    for k, pieces in have.items():  # each id of each copy once
        covered = np.zeros(k[1], int)
        for r in pieces:
            covered[r["start"] : r["start"] + r["length"]] += 1
        assert (covered == len(want[k])).all()
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(n <= 1024 and n & (n - 1) == 0 for n in map(gapless, sequences.values()))
    assert len(sequences) <= sum(map(len, ids)) // 1024 + 10


def test_a_long_text_and_no_rows(spark):
    text = "".join(f"{i} " for i in range(400_000))
    out = windows.pack_windows(spark.createDataFrame([(1, text, "", 0, "")], SCHEMA), PATH).collect()
    assert gapless((r["start"], r["length"]) for r in out) == len(plain_ids([text])[0])
    assert windows.pack_windows(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    with pytest.raises(ValueError):
        windows.pack_windows(spark.createDataFrame([], SCHEMA), PATH, 1000)
