"""The prefix tree against plain dictionaries, with shards and merges of every size."""

import hashlib
import random
import zlib

import pytest

from larder.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, turns string"


def plain_tree(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in own.items()}
    full = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + x[h:])
    nodes = {}
    for c, x in full.items():
        for d in range(len(x) + 1):
            nodes.setdefault(x[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = set()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == p))
        parent = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), parent, len(members), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_rows(n, rng):
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        size = rng.choice([1, 1, 2, 3, 5, 8, 12])
        hot = rng.random() < 0.4
        for t in range(size):
            text = "hello" if hot and t < 3 else rng.choice(["a", "é", "", None, "long " * 50, "b"])
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", None]) if t % 4 == 3 else "user", text, 7, "x"))
    return rows


def found(spark, rows):
    out = trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA))
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 7 + ["string"]
    listed = [tuple(r) for r in out.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


@pytest.mark.parametrize("shard, fan, piece", [(4096, 64, 10_000), (7, 2, 3), (1, 3, 1), (50, 4, 2)])
def test_tree(spark, monkeypatch, shard, fan, piece):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = some_rows(400, random.Random(shard))
    rows += [(None, 1, "user", "no id", 1, ""), (10**12, 5, None, None, None, None), (10**12 + 1, 0, "user", "a", None, None)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows) == plain_tree(rows)


def test_many_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 64)
    rows = [(5 * c, t, "user", f"same {t}", 1, "") for c in range(900) for t in range(4)]
    rows += [(7, t, "user", f"turn {t}", 1, "") for t in range(3000)]
    assert found(spark, rows) == plain_tree(rows)


def test_repeated_rows_are_turns_and_an_empty_table(spark):
    rows = [(0, 1, "user", "a", 1, "")] * 3 + [(25, 1, "user", "a", 1, "")] * 2
    assert found(spark, rows) == plain_tree(rows)
    assert found(spark, rows[:1]) == plain_tree(rows[:1])
    assert trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_conversations(spark):
    from larder.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op13_prefix_tree"](spark, folder)
    assert {tuple(r) for r in out.collect()} == plain_tree(rows)
