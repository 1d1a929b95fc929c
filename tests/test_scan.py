import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import scan
from larder.operators.aggregates import concat_deltas


def ffill(values, inclusive=True):
    last, out = None, []
    for v in values:
        if inclusive:
            last = v if v is not None else last
            out.append(last)
        else:
            out.append(last)
            last = v if v is not None else last
    return out


@pytest.mark.parametrize("ranges", [None, 1, 4, 50])
def test_carry_forward_equals_a_loop(spark, ranges):
    rng = random.Random(ranges or 0)
    rows = [(k, i, rng.choice([None, None, rng.randint(0, 9)])) for k in ("a", "b", None) for i in range(20)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq bigint, v int")
    got = scan.carry_forward(df, ["k"], "seq", {"upto": "v"}, {"before": "v"}, ranges=ranges).collect()
    plain = scan.carry_within(df, ["k"], "seq", {"upto": "v"}, {"before": "v"}).collect()
    assert sorted(map(str, got)) == sorted(map(str, plain))
    for k in ("a", "b", None):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.seq)
        assert [r.upto for r in mine] == ffill([r.v for r in mine])
        assert [r.before for r in mine] == ffill([r.v for r in mine], False)


@pytest.mark.parametrize("ranges", [None, 1, 4, 50, 300])
def test_running_totals(spark, ranges):
    """One range, ranges of several groups, and several ranges per group give the same totals."""
    rng = random.Random(ranges or 0)
    rows = [(g, x, rng.randint(1, 5)) for g in (1, 2, None) for x in rng.sample(range(1000), 60)]
    rows += [(3, None, 4), (3, 1, 2)]
    df = spark.createDataFrame(rows, "g int, x int, n int")
    got = scan.running_totals(df, ["g"], "x", {"below": "n"}, {"whole": "n"}, ranges).collect()
    assert len(got) == len(rows)
    for r in got:
        less = [n for g, x, n in rows if g == r.g and r.x is not None and (x is None or x < r.x)]
        assert (r.below, r.whole) == (sum(less), sum(n for g, _, n in rows if g == r.g))
    whole = df.filter("x IS NOT NULL").groupBy("x").agg(F.sum("n").alias("n"))
    for r in scan.running_totals(whole, [], "x", {"below": "n"}, ranges=ranges).collect():
        assert r.below == sum(n for _, x, n in rows if x is not None and x < r.x)


def test_running_totals_is_even_for_a_skewed_distribution(spark):
    """Values crowd into a narrow interval, and one group has nearly all rows; ranges still share them."""
    df = spark.range(20_000).select(
        (F.col("id") % 1000 == 0).cast("int").alias("g"), (F.lit(0.5) + F.col("id") / 1e12).alias("x"), F.lit(1).alias("n")
    )
    sizes = df.repartitionByRange(64, "g", "x").groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 3_000
    got = scan.running_totals(df, ["g"], "x", {"below": "n"}, {"whole": "n"}, 64)
    most = got.groupBy("g").agg(F.max("below").alias("b"), F.max("whole").alias("w")).collect()
    assert sorted(tuple(r) for r in most) == [(0, 19_979, 19_980), (1, 19, 20)]


def test_no_rows_have_no_totals(spark):
    df = spark.createDataFrame([], "g int, x int, n int")
    assert scan.running_totals(df, ["g"], "x", {"below": "n"}, {"whole": "n"}).count() == 0


@pytest.mark.parametrize("ranges", [None, 1, 30])
def test_exact_percentiles_equal_linear_interpolation(spark, ranges):
    rng = random.Random(5)
    rows = [(g, float(rng.choice([1, 2, 2, 7, rng.random() * 50]))) for g in ("a", "b") for _ in range(101)]
    rows.append(("one", 4.0))
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    for r in scan.exact_percentiles(df, "x", probs, ["g"], ranges=ranges).collect():
        xs = [x for g, x in rows if g == r.g]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(xs, p * 100), abs=1e-6)


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_concat_deltas_keeps_order(spark, block):
    text = "".join(chr(97 + i % 26) for i in range(500))
    rows = [("m", i, c) for i, c in enumerate(text)] + [("n", 3, None), ("n", 9, "x")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, seq bigint, d string")
    got = {r.k: r.text for r in concat_deltas(df, ["k"], "seq", "d", "text", block).collect()}
    assert got == {"m": text, "n": "x"}
