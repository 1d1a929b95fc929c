"""Physical plans: pushed filters, narrow scans, early limits, and no join without a key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import requests as rq
from larder.operators import scan
from larder.plans import model as m
from larder.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """Plans as for sides too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


NAMES = [
    "current_position", "escalation", "transfer_candidates", "disruption_days", "alternate_suppliers", "roc_auc",
    "roc_auc_by_month", "latency_by_name", "fold_messages", "psi", "retrieve_top_k", "dedup_messages", "nest_children",
]


@pytest.mark.parametrize("name", NAMES)
def test_every_join_has_a_key(spark, no_broadcast, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan


def test_dates_and_columns_reach_the_scan(spark):
    execution = m.daily_flows(spark, FOLDER)._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(execution, "formatted").splitlines()
    pushed = next(x for x in plan if x.startswith("PushedFilters") and "l_shipdate" in x)
    assert "GreaterThanOrEqual(l_shipdate,1998-01-18T00:00)" in pushed and "LessThan(l_shipdate,2001-07-15T00:00)" in pushed
    read = next(x for x in plan if x.startswith("ReadSchema") and "l_shipdate" in x)
    assert "l_extendedprice" not in read and "l_tax" not in read


def test_top_k_is_limited_before_the_shuffle(spark):
    for name in ("alternate_suppliers", "transfer_candidates", "top_risk_per_region"):
        assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan_of(QUERIES["top_n"](spark, FOLDER))


def test_folding_shuffles_once(spark):
    plan = plan_of(QUERIES["fold_messages"](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 1


def test_only_hot_keys_are_told_apart(spark):
    rows = [("hot", i) for i in range(30)] + [("a", 1), ("b", 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    assert [r.k for r in scan.hot_keys(df, ["k"], 10).collect()] == ["hot"]
    assert scan.hot_keys(df, ["k"], 30) is None


def test_sessions_of_a_hot_user_equal_a_loop(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", start + dt.timedelta(seconds=rng.randint(0, 200_000))) for _ in range(600)]
    rows += [(f"u{i % 9}", start + dt.timedelta(seconds=rng.randint(0, 200_000))) for i in range(300)]
    gap = 600
    want = []
    for user in {u for u, _ in rows}:
        times = sorted(t for u, t in rows if u == user)
        run = [times[0]]
        for t in times[1:]:
            if (t - run[-1]).total_seconds() > gap:
                want.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((user, run[0], run[-1], len(run)))
    df = spark.createDataFrame(rows, "user_id string, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = [(r.user_id, r.first_event, r.last_event, r.events) for r in rq.user_sessions(df, gap).collect()]
    assert sorted(got) == sorted(want)
