"""Links and components against all pairs."""

import random
import re

import pytest

from larder.llm import near
from larder.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(rows, size, percent=80):
    """component of each row, by union of all pairs that are alike."""
    sets = [shingles(t, size) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [len(s) for s in sets], [least.get(root(i)) for i in range(len(rows))]


def rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One\ttwo", "é É", "É É", "long words " * 9000]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 300))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    ids = rng.sample(range(-50, 100_000), len(texts))
    out = [(i, t, "clash", 1) for i, t in zip(ids, texts)]
    return [*out, out[20], out[20], (None, texts[20], "", 0), (None, None, "", 0)]


@pytest.mark.parametrize("size", [2, 5])
def test_components(spark, size):
    data = rows()
    out = near.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(4), size=size).collect()
    sizes, want = plain(data, size)
    expected = sorted((str(r[0]), n, str(c), r[0] == c) for r, n, c in zip(data, sizes, want))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in out) == expected


def test_a_family_whose_members_differ_from_each_other(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(150):
        copy = list(base)
        for j in range(rng.randint(1, 16)):
            copy[rng.randrange(200)] = f"x{i}-{j}"
        texts.append(" ".join(copy))
    data = [(1000 - i, t, "", 0) for i, t in enumerate(texts)]
    out = near.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    _, want = plain(data, 2)
    assert {r["doc_id"]: r["component_id"] for r in out} == {r[0]: c for r, c in zip(data, want)}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    data = [(5, text, "", 0), (3, text + " more", "", 0), (9, "other text", "", 0), (10, None, "", 0), (11, "", "", 0)]
    out = near.deduplicated(spark.createDataFrame(data, SCHEMA))
    assert out.columns == ["doc_id", "text", "component_id", "kept"]
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9, 10, 11]
    assert near.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_stays_of_rows_that_repeat_or_share_an_id_or_have_none(spark):
    def text(word, n=100):
        return " ".join(f"{word}{i}" for i in range(n))

    a, b, c, d, e = map(text, "abcde")
    groups = [
        [(5, a, "x", 1)] * 3 + [(5, a, "w", 2)],
        [(3, b, "", 0), (3, b + " more", "", 0), (8, b, "", 0)],
        [(None, c, "", 0), (None, c, "", 0), (None, c + " more", "", 0)],
        [(9, d, "", 0), (None, d, "", 0), (None, d + " more", "", 0)],
        [(3, e, "", 0)],  # another text under an id of a group
    ]
    empty = [(None, None, "", 0), (None, None, "", 0), (11, "", "", 0)]
    data = [r for g in groups for r in g] + empty
    out = [tuple(r) for r in near.deduplicated(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()]
    assert [sum(r[1] is not None and r[1][:2] == g[0][1][:2] for r in out) for g in groups] == [1] * len(groups)
    assert set(out) <= set(data) and len(out) == len(groups) + len(empty)
    assert (5, a, "w", 2) in out and (9, d, "", 0) in out and (3, e, "", 0) in out


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    nodes = list(range(400))
    rng.shuffle(nodes)
    links = list(zip(nodes[:150], nodes[1:150])) + [(nodes[200], x) for x in nodes[201:300]] + [(nodes[350], nodes[351])] * 2 + [(7, 7)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for group in (nodes[:150], nodes[200:300], nodes[350:352]):
        assert {out[x] for x in group} == {min(group)}
    assert len(out) == 252
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
