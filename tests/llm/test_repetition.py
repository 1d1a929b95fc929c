"""Counts and coverage against a text-by-text loop."""

import random
import re
from collections import Counter

import pytest

from larder.llm import repetition

SCHEMA = "doc_id long, text string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    shares = []
    for n in repetition.NGRAM_SHARES:
        seen, cover = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in seen:
                cover |= set(range(i, i + n))
            seen.add(gram)
        shares.append(sum(len(words[i]) for i in cover) / max(chars, 1))
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(dup),
        "n_repeat_words": len(inside), "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words),
        "line_chars": sum(len(w) for x in dup for w in WORD.findall(x)) / max(chars, 1), "shares": shares,
    }


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "\n", "one", "é é é é é é é é", "a b c a b c", "x\n\nx\nx ", "no break a b"]
    for i in range(150):
        vocabulary = ["the", "of", "naïve", "#", "a", "日本", "x|y"][: rng.randint(2, 7)] + [f"w{k}" for k in range(rng.randint(1, 60))]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", " ", "\r\n", " "]) for _ in range(rng.randint(1, 160))))
    out.append("again and again " * 4000)
    return out


@pytest.fixture(scope="module")
def measured(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    out = repetition.quality(spark.createDataFrame([*rows, rows[9]], SCHEMA).repartition(3)).collect()
    return rows, out


def test_counts_and_coverage(measured):
    rows, out = measured
    assert len(out) == len(rows) + 1
    for r in out:
        want = plain(rows[r["doc_id"]][1])
        for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
            assert r[k] == want[k], (k, rows[r["doc_id"]][1])
        assert r["dup_line_char_share"] == pytest.approx(want["line_chars"])
        assert r["dup_ngram_char_shares"] == pytest.approx(want["shares"])
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["failed"])


def test_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(200))
    rows = [(1, clean, ""), (2, clean + "\n" + clean, ""), (3, clean.replace(" ", "### "), ""), (4, None, "")]
    out = {r["doc_id"]: r for r in repetition.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert repetition.quality(spark.createDataFrame([], SCHEMA)).count() == 0
