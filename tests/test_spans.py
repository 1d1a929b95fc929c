"""Sparse panels against a dense one built day by day in Python, and against the dense operators."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from larder.operators import features as ft
from larder.operators import spans as sn
from larder.operators import status
from larder.operators.joins import panel
from larder.plans import part_queries as pq

FIRST = dt.date(2024, 1, 1)
LAST = FIRST + dt.timedelta(days=89)
FOLDER = "/root/testdata/sf0.001"
KEYS = ["a", "b"]


def day(n):
    return FIRST + dt.timedelta(days=n)


def make_flows(spark, seed=3):
    rng, rows = random.Random(seed), {}
    for a, b in [(0, 0), (0, 1), (1, 0), (2, 5)]:
        for n in rng.sample(range(100), {0: 2, 1: 12, 2: 60}[a]):
            rows[a, b, day(n)] = (rng.randint(0, 9), rng.choice([0, 0, 8, 20]))
    rows[3, 0, day(95)] = (0, 7)  # nothing inside the panel
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "a bigint, b bigint, d date, out bigint, back bigint")
    return df, rows


def changes(df, **more):
    return sn.change_rows(df, KEYS, "d", ["out", "back"], FIRST, LAST, **more)


def with_level(rows):
    stocked = status.stock_ledger(rows.withColumn("opening", F.lit(15).cast("bigint")), KEYS, "d", "back", "out", "opening")
    return stocked.withColumn("level", (F.col("on_hand_units") / 4).cast("decimal(18,2)"))


def levels(rows):
    """Stock on every day, key by key."""
    out = {}
    for a, b in {k[:2] for k in rows}:
        stock = 15
        for n in range(100):
            o, r = rows.get((a, b, day(n)), (0, 0))
            stock += r - o
            out[a, b, n] = max(0, stock) / 4
    return out


def test_rows_are_flows_marks_and_edges(spark):
    df, flows = make_flows(spark)
    got = {(r.a, r.b, r.d): (r.out, r.back) for r in changes(df, at=[FIRST, LAST], shifts={"back": (-14, 5)}).collect()}
    want = dict(flows)
    for a, b, d in flows:
        edges = [d + dt.timedelta(days=k) for k in (-14, 5)] if flows[a, b, d][1] else []
        for e in [FIRST, LAST, *[e for e in edges if FIRST <= e <= LAST]]:
            want.setdefault((a, b, e), (0, 0))
    assert got == want


def test_measures_equal_a_dense_loop(spark):
    df, flows = make_flows(spark)
    rows = sn.with_level_mean(with_level(changes(df, at=[FIRST])), KEYS, "d", "level", 7, FIRST, "mean7").withColumns(
        {
            "flow7": sn.flow_mean(KEYS, "d", "out", 7, FIRST),
            "std30": sn.flow_std(KEYS, "d", "out", 30, FIRST),
            "min30": sn.level_min(KEYS, "d", "level", 30),
            "ahead": sn.flag_ahead(KEYS, "d", F.col("level") < 2, 30, LAST),
        }
    )
    stock, seen = levels(flows), 0
    for r in rows.filter(F.col("d") <= F.lit(LAST)).collect():
        n = (r.d - FIRST).days
        week, month = range(max(0, n - 6), n + 1), range(max(0, n - 29), n + 1)
        out = [flows.get((r.a, r.b, day(i)), (0, 0))[0] for i in month]
        mean = sum(out) / len(out)
        assert float(r.level) == stock[r.a, r.b, n]
        assert math.isclose(r.mean7, sum(stock[r.a, r.b, i] for i in week) / len(week), abs_tol=1e-9)
        assert float(r.min30) == min(stock[r.a, r.b, i] for i in month)
        assert math.isclose(r.flow7, sum(flows.get((r.a, r.b, day(i)), (0, 0))[0] for i in week) / len(week))
        assert math.isclose(r.std30, math.sqrt(sum((x - mean) ** 2 for x in out) / len(out)), abs_tol=1e-9)
        known = n + 30 <= 89
        assert r.ahead == (int(any(stock[r.a, r.b, i] < 2 for i in range(n + 1, n + 31))) if known else None)
        seen += 1
    assert seen > 70


def test_spans_cover_the_panel_once_and_hold_the_dense_level(spark):
    df, flows = make_flows(spark)
    rows = with_level(changes(df, at=[FIRST])).filter(F.col("d") <= F.lit(LAST))
    rows = sn.changes_only(rows, KEYS, "d", ["level"]).withColumn("until", sn.valid_until(KEYS, "d", LAST))
    stock, covered = levels(flows), {}
    spans = sorted(tuple(r) for r in rows.select(*KEYS, "d", "until", F.col("level").cast("double")).collect())
    for a, b, start, end, level in spans:
        for n in range((start - FIRST).days, (end - FIRST).days + 1):
            assert (a, b, n) not in covered
            covered[a, b, n] = level
    assert covered == {k: v for k, v in stock.items() if k[2] <= 89}
    assert all(x[4] != y[4] for x, y in zip(spans, spans[1:]) if x[:2] == y[:2])


def test_no_flows_give_no_rows(spark):
    df, _ = make_flows(spark)
    rows = changes(df.filter("a > 9"), at=[FIRST])
    assert with_level(rows).count() == 0


def test_part_features_equal_the_dense_operator(spark):
    """The same stock laid out day by day and measured by the operator for dense panels."""
    spans = pq.part_inventory(spark, FOLDER).select(*pq.KEYS, "valid_from", "valid_to", "on_hand_units", "on_order_units", "days_of_supply", "minimum_days_supply")
    days = panel(spans.select(*pq.KEYS).distinct(), pq.m.START, pq.m.AS_OF)
    dense = days.join(spans, pq.KEYS).filter(F.col("snapshot_date").between(F.col("valid_from"), F.col("valid_to")))
    issued = pq.part_flows(spark, FOLDER).select(*pq.KEYS, "snapshot_date", F.col("issues").alias("daily_demand_units"))
    dense = dense.join(issued, [*pq.KEYS, "snapshot_date"], "left").fillna({"daily_demand_units": 0})
    spec = ft.PanelSpec(keys=tuple(pq.KEYS))
    names = [
        "avg_daily_demand_7d", "avg_daily_demand_30d", "demand_stddev_30d", "avg_days_of_supply_7d", "min_days_of_supply_30d",
        "demand_growth_7_vs_30", "demand_cv_30d", "inventory_gap_days", "on_order_coverage_days",
    ]
    want = {(r.item_index, r.location_index, r.snapshot_date): [r[n] for n in names] for r in ft.rolling_features(dense, spec).collect()}
    got = pq.part_features(spark, FOLDER, [pq.m.AS_OF]).select(*pq.KEYS, "snapshot_date", *names).collect()
    assert len(got) > 2000
    for r in got:
        assert want[r.item_index, r.location_index, r.snapshot_date] == [r[n] for n in names]


def test_one_exchange_by_part_serves_sums_master_and_frames(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pq.part_features(spark, FOLDER, label_horizon=30)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_part = [x for x in plan.splitlines() if "Exchange hashpartitioning(item_index" in x or "Exchange hashpartitioning(p_partkey" in x]
    # Daily totals by key and day, the change rows by part, and the master.
    assert len(by_part) <= 3 and "NestedLoop" not in plan


def test_stored_spans_are_read_by_month_and_meet_without_an_exchange(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS spans_test")
    try:
        pq.store_spans(pq.part_inventory(spark, FOLDER), "spans_test.held", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        moves = pq.status_moves(spark, "spans_test.held", pq.MOVED_SINCE, pq.m.AS_OF)
        plan = moves._jdf.queryExecution().executedPlan().toString()
        assert plan.count("PartitionFilters: [isnotnull(until_month") == 2
        # The only exchange is that of the few statuses.
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(from_status" in plan
        positions = pq.part_days(spark, FOLDER).select(*pq.KEYS).distinct().count()
        assert moves.agg(F.sum("positions")).first()[0] == positions
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP SCHEMA spans_test CASCADE")


def test_positions_of_a_part_with_very_many_lines(spark, tmp_path):
    """A third of all lines are of one part and supplier: at most a row per day reaches the exchange by part."""
    import shutil

    for name in ("supplier", "part", "nation", "region", "orders"):
        shutil.copy(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    hot = lines.withColumns({"l_partkey": F.lit(1).cast("bigint"), "l_suppkey": F.lit(1).cast("bigint")})
    lines.unionByName(hot).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.catalog.clearCache()
    flows = pq.part_flows(spark, str(tmp_path))
    busiest = flows.groupBy(*pq.KEYS).count().agg(F.max("count")).first()[0]
    assert busiest <= 556  # the panel and the inbound days, with the warm-up on the first
    plain = {(r.item_id, r.location_id, r.valid_from): r.on_hand_units for r in pq.part_inventory(spark, FOLDER).filter("item_index <> 1").collect()}
    mixed = pq.part_inventory(spark, str(tmp_path)).filter("item_index <> 1").collect()
    assert plain == {(r.item_id, r.location_id, r.valid_from): r.on_hand_units for r in mixed}


def test_late_orders_of_parts_are_those_of_part_types(spark):
    """The narrow read of the orders loses nothing: units per nation are those of the lines read whole."""
    from larder.operators.supply import late_orders

    whole = late_orders(pq.m.order_lines(spark, FOLDER), ("location_id",)).select("location_id", "backordered_orders", "late_inbound_units", "waiting_since")
    narrow = pq.part_late_orders(spark, FOLDER).join(pq.m.locations(spark, FOLDER), "location_index").groupBy("location_id")
    narrow = narrow.agg(F.sum("backordered_orders"), F.sum("late_inbound_units"), F.min("waiting_since"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, narrow.collect())) != []


def test_tasks_of_part_panels_grow_with_lines(spark, tmp_path, monkeypatch):
    day = F.lit(pq.m.START).cast("timestamp")
    spark.range(25).select(F.col("id").alias("l_suppkey"), day.alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(pq.m, "SCHEMAS", {})
    monkeypatch.setattr(pq, "TASK_LINES", 10)
    assert pq.part_tasks(spark, str(tmp_path)) == 3
    flows = [(1, 1, FIRST, 1, 0)]
    df = spark.createDataFrame(flows, "item long, place long, d date, out long, back long")
    assert sn.change_rows(df, ["item", "place"], "d", ["out", "back"], FIRST, LAST, by=["item"], tasks=3).rdd.getNumPartitions() == 3
