"""Counts of terms against a plain search, sums of pairs against a plain loop."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import audit
from larder.llm import columns as C

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, count int, p string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_divergence(rows):
    docs = [(lang or "", source or "", Counter(terms(text))) for _, text, lang, source, *_ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in seen.items() if n >= 3]
        count = {s: sum((d[2] for d in mine if d[1] == s), Counter()) for s in {d[1] for d in mine}}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        whole, p = shares(sum(count.values(), Counter())), {s: shares(c) for s, c in count.items()}
        for s in count:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in count if o != s]
            own = [((p[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, 200)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def some_rows(n, rng):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" * rng.choice([1, 1, 3, 5, 12]) for i in range(300)] + ["Ä", "ß" * 8, "日本" * 40, "x" * 400, "AbC", "abc", "don't"]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "xx"])
        source = rng.choice(["s0", "s0", "s1", "é", None, "S"]) if lang != "xx" else "only"
        text = None if i % 23 == 0 else "" if i % 29 == 0 else rng.choice([" ", "\n", "1", "\x00"]).join(rng.choices(words, k=rng.randint(0, 60)))
        rows.append((i, text, lang, source, "clash", 1, "x"))
    rows += [rows[1]] * 3 + [(None, "no id here", "en", "s0", None, None, None), (n, "alone", "zz", "a", "", 0, ""), (n, "?", "zz", "b", "", 0, "")]
    return rows


def test_radix_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 3, 5000, np.uint64), rng.integers(0, 1 << 63, 5000, np.uint64) >> np.uint64(40)]
    assert (audit.radix_order(keys) == np.lexsort(keys[::-1])).all()
    assert len(audit.radix_order([np.zeros(0, np.uint64)])) == 0


def test_counts_of_a_slice():
    rng = random.Random(2)
    letters = ["a", "B", "z", "Z", " ", "é", "日", "@", "[", "`", "{", "\x7f", "0"]
    texts = ["".join(rng.choice(letters) * rng.choice([1, 2, 9, 40]) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", "q" * 100_000, "q" * 100_000]
    group = np.array([rng.randint(0, 4) for _ in texts])
    of, count, found, docs = audit.count_terms(*C.utf8(pa.array(texts)), group)
    want, held = Counter(), Counter()
    for g, t in zip(group.tolist(), texts):
        c = Counter(terms(t))
        want.update({(g, x): n for x, n in c.items()})
        held.update((g, x) for x in c)
    keys = list(zip(of.tolist(), found.to_pylist()))
    assert dict(zip(keys, count.tolist())) == want and dict(zip(keys, docs.tolist())) == held and len(keys) == len(want)
    assert len(audit.count_terms(*C.utf8(pa.array([None, ""], pa.string())), np.zeros(2, int))[0]) == 0


@pytest.mark.parametrize("block, held, sources", [(1 << 16, 1 << 20, 256), (40, 7, 2)])
def test_divergence(spark, monkeypatch, block, held, sources):
    for name, value in (("BLOCK_COUNTS", block), ("HELD_PAIRS", held), ("HELD_SOURCES", sources)):
        monkeypatch.setattr(audit, name, value)
    rows = some_rows(500, random.Random(block))
    out = audit.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [(f.name, f.dataType.simpleString()) for f in out.schema][4:] == [("value", "bigint"), ("rank", "int")]
    listed = [tuple(r) for r in out.collect()]
    assert set(listed) == plain_divergence(rows) and len(listed) == len(set(listed))


def test_a_large_text_and_no_rows(spark, monkeypatch):
    rows = [(i, "Word other " * 300_000 + "end" * i, "en", f"s{i % 2}", "", 0, "") for i in range(4)]
    assert {tuple(r) for r in audit.divergence(spark.createDataFrame(rows, SCHEMA)).collect()} == plain_divergence(rows)
    assert audit.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
