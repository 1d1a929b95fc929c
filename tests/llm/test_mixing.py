"""Targets and thresholds of the mix against a plain loop."""

import re

import pytest

from larder.llm import mixing

SCHEMA = "doc_id long, text string, source string, extra int"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > limit * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_of(n):
    sources = ["b", "a", None, "é", "Z", "a"]
    rows = []
    for i in range(n):
        text = None if i % 17 == 3 else " ".join(f"w{j}" for j in range((i * 7919) % 60)) + (" x\n" if i % 3 else "")
        rows.append((i, text, sources[i % 6] if i % 3 else "a", i))
    return [*rows, rows[5], rows[5], (None, "no id here", "b", 1), (None, None, None, 1)]


@pytest.fixture(scope="module")
def mixed_rows(spark):
    rows = rows_of(900)
    return rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()


def test_sizes_and_targets(mixed_rows):
    rows, out = mixed_rows
    assert len(out) == len(rows)
    size = {}
    for _, text, source, _ in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(size)
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])


def test_taken_is_near_the_target(mixed_rows):
    rows, out = mixed_rows
    taken, largest = {}, {}
    for r in out:
        assert r["taken"] == r["repeats"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in taken:
        target = next(r["target"] for r in out if r["source"] == s)
        assert abs(taken[s] - target) <= 1.5 * largest[s]


def test_rerun_agrees(spark, mixed_rows):
    rows, out = mixed_rows
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_rows_are_repeated(spark, mixed_rows):
    rows, out = mixed_rows
    docs = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert docs.columns == ["doc_id", "text", "source", "extra"]
    assert docs.count() == sum(r["repeats"] for r in out)


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, None, "a", 0), (2, " \n", "a", 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2
    out = mixing.mix(spark.createDataFrame([(1, "one", "a", 0)], SCHEMA)).collect()
    assert out[0]["target"] == 1.5 and out[0]["taken"] in (1, 2)
