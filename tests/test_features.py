import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import features as ft
from larder.operators import status as st
from larder.operators import windows as wn
from larder.operators.checks import panel_gaps
from larder.operators.joins import panel

DAY0 = dt.date(2024, 1, 1)
SPEC = ft.PanelSpec(keys=("k",), demand_scale=2)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def make_panel(spark, days=90, keys=("a", "b"), skip=()):
    rng = random.Random(3)
    rows = [
        (k, day(i), float(rng.randint(0, 9)), rng.randint(0, 4000) / 100, 14, rng.randint(0, 50))
        for k in keys
        for i in range(days)
        if i not in skip
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, "k string, snapshot_date date, daily_demand_units double, days_of_supply double, minimum_days_supply int, on_order_units int"
    )
    return df, rows


@pytest.mark.parametrize("skip", [(), tuple(range(20, 45)) + (60, 61)])
def test_label_equals_brute_force(spark, skip):
    df, rows = make_panel(spark, skip=skip)
    got = {(r.k, r.snapshot_date): r.future_shortage_flag for r in ft.shortage_label(df, SPEC).collect()}
    for k, d, *_ in rows:
        later = [x for x in rows if x[0] == k and 1 <= (x[1] - d).days <= 30]
        want = None if not later else int(any(x[3] < x[4] for x in later))
        assert got[k, d] == want


@pytest.mark.parametrize("skip", [(), tuple(range(20, 45))])
def test_trailing_measures_equal_brute_force(spark, skip):
    df, rows = make_panel(spark, skip=skip)
    for r in ft.rolling_features(df, SPEC).collect():
        last = {
            n: [x for x in rows if x[0] == r.k and 0 <= (r.snapshot_date - x[1]).days < n] for n in (7, 30)
        }
        demand = [x[2] for x in last[30]]
        mean = sum(demand) / len(demand)
        std = (sum((x - mean) ** 2 for x in demand) / len(demand)) ** 0.5
        assert r.avg_daily_demand_30d == pytest.approx(mean)
        assert r.demand_stddev_30d == pytest.approx(std, abs=1e-6)
        assert r.avg_days_of_supply_7d == pytest.approx(sum(x[3] for x in last[7]) / len(last[7]))
        assert r.min_days_of_supply_30d == pytest.approx(min(x[3] for x in last[30]))


def test_row_and_day_frames_agree_on_a_dense_panel_only(spark):
    dense, _ = make_panel(spark)
    rows_spec = ft.PanelSpec(keys=("k",), demand_scale=2, rows=True)

    def values(df, spec):
        return sorted(map(str, ft.rolling_features(df, spec, label_horizon=30).collect()))

    assert values(dense, SPEC) == values(dense, rows_spec)
    assert panel_gaps(dense, ["k"], day(0), day(89)).count() == 0
    holes, _ = make_panel(spark, skip=(5, 6))
    assert values(holes, SPEC) != values(holes, rows_spec)
    assert panel_gaps(holes, ["k"], day(0), day(89)).count() == 4


def test_features_do_not_see_the_future(spark):
    df, _ = make_panel(spark)
    cut = day(50)
    full = ft.rolling_features(df, SPEC).filter(F.col("snapshot_date") <= F.lit(cut))
    early = ft.rolling_features(df.filter(F.col("snapshot_date") <= F.lit(cut)), SPEC)
    assert sorted(map(str, full.collect())) == sorted(map(str, early.collect()))


def test_bounded_slice_equals_full_history(spark):
    df, _ = make_panel(spark)
    full = ft.rolling_features(df, SPEC, label_horizon=30).filter(F.col("snapshot_date") == F.lit(day(55)))
    cut = ft.rolling_features(df, SPEC, first=day(55), last=day(55), label_horizon=30)
    assert sorted(map(str, full.collect())) == sorted(map(str, cut.collect()))


def test_bounded_slice_reads_only_the_months_it_needs(spark, tmp_path):
    df, _ = make_panel(spark, days=200)
    path = str(tmp_path / "panel")
    df.withColumn("month", F.trunc("snapshot_date", "month")).write.partitionBy("month").parquet(path)
    spec = ft.PanelSpec(keys=("k",), demand_scale=2, month="month")
    stored = spark.read.parquet(path)
    cut = ft.rolling_features(stored, spec, first=day(100), last=day(100))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    full = ft.rolling_features(df, SPEC).filter(F.col("snapshot_date") == F.lit(day(100)))
    columns = full.columns
    assert sorted(map(str, cut.select(columns).collect())) == sorted(map(str, full.collect()))


def test_result_does_not_depend_on_partitions(spark):
    df, _ = make_panel(spark)
    one = sorted(map(str, ft.rolling_features(df.coalesce(1), SPEC, label_horizon=30).collect()))
    many = sorted(map(str, ft.rolling_features(df.repartition(13), SPEC, label_horizon=30).collect()))
    assert one == many


def test_days_to_shortage(spark):
    df, rows = make_panel(spark)
    short = F.col("days_of_supply") < F.col("minimum_days_supply")
    for r in wn.days_to_shortage(df, ["k"], "snapshot_date", short, 30).collect():
        later = [(x[1] - r.snapshot_date).days for x in rows if x[0] == r.k and x[3] < x[4]]
        later = [n for n in later if 1 <= n <= 30]
        assert r.days_to_shortage == (min(later) if later else None)


def test_first_row_is_its_own_window(spark):
    df = spark.createDataFrame([("a", DAY0, 4.0)], "k string, d date, x double")
    r = wn.trailing_std(wn.trailing_avg(df, ["k"], "d", "x", 30, "m"), ["k"], "d", "x", 30, "s").first()
    assert (r.m, r.s) == (4.0, 0.0)


def test_zero_demand_gives_zero_not_null(spark):
    df = spark.createDataFrame(
        [("a", DAY0, 0.0, 5.0, 14, 3)],
        "k string, snapshot_date date, daily_demand_units double, days_of_supply double, minimum_days_supply int, on_order_units int",
    )
    r = ft.rolling_features(df, SPEC).first()
    assert (r.demand_growth_7_vs_30, r.demand_cv_30d, r.on_order_coverage_days) == (0.0, 0.0, 0.0)


def test_training_rows_follow_all_guards(spark):
    df, _ = make_panel(spark)
    features = ft.rolling_features(df, SPEC, label_horizon=30)
    as_of = day(80)
    rows = ft.training_rows(features, SPEC, DAY0, as_of, 30, 7).collect()
    assert rows
    for r in rows:
        assert (r.snapshot_date - DAY0).days % 7 == 0
        assert r.snapshot_date <= as_of - dt.timedelta(days=30)
        assert r.days_of_supply >= r.minimum_days_supply
        assert r.future_shortage_flag is not None


def test_leakage_report(spark):
    assert ft.leakage_report((*ft.trailing_measures(), *ft.compared_measures())) == {}
    found = ft.leakage_report(["a", "_latent", "future_shortage_flag", "secret"], forbidden=["secret"])
    assert found == {"_latent": "private", "future_shortage_flag": "future", "secret": "forbidden"}


def test_panel_has_every_day_once(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    rows = panel(keys, day(0), day(9)).collect()
    assert len(rows) == len(set(rows)) == 20


def status_of(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_inventory_status_precedence(spark):
    rows = [(0, 50.0, 14), (5, 13.99, 14), (5, 14.0, 14), (5, 20.99, 14), (5, 21.0, 14)]
    got = status_of(spark, st.inventory_status("h", "d", "m"), rows, "h int, d double, m int")
    assert got == ["STOCKOUT", "BELOW_MINIMUM", "WATCH", "WATCH", "HEALTHY"]


def test_order_status_precedence(spark):
    now = dt.date(2024, 6, 1)
    before, after = now - dt.timedelta(days=1), now + dt.timedelta(days=1)
    rows = [
        (True, before, before, before),
        (False, now, before, before),
        (False, after, before, before),
        (False, after, now, now),
        (False, after, after, after),
    ]
    got = status_of(spark, st.order_status(now, "c", "a", "p", "s"), rows, "c boolean, a date, p date, s date")
    assert got == ["CANCELLED", "DELIVERED", "BACKORDERED", "IN_TRANSIT", "OPEN"]


def test_shipment_modes(spark):
    now = dt.date(2024, 6, 10)
    d = lambda n: now + dt.timedelta(days=n)
    rows = [("early", d(-5), d(-6)), ("late", d(-5), d(-2)), ("overdue", d(-5), d(9)), ("due", d(5), d(9))]
    df = spark.createDataFrame(rows, "id string, promised_delivery_date date, actual_delivery_date date")
    known = {r.id: r for r in st.shipment_status(df, now).collect()}
    final = {r.id: r for r in st.shipment_status(df, now, "reference").collect()}
    shape = lambda r: (r.shipment_status, r.days_late, r.on_time_flag)
    assert shape(known["early"]) == shape(final["early"]) == ("DELIVERED", 0, True)
    assert shape(known["late"]) == shape(final["late"]) == ("DELIVERED", 3, False)
    assert shape(known["overdue"]) == ("LATE", 5, False)
    assert shape(final["overdue"]) == ("LATE", 14, False)
    assert shape(known["due"]) == ("IN_TRANSIT", None, None)
    assert shape(final["due"]) == ("IN_TRANSIT", 4, False)
    assert known["overdue"].actual_delivery_date is None and final["due"].actual_delivery_date is None
    with pytest.raises(ValueError):
        st.shipment_status(df, now, "other")


def test_quantities(spark):
    rows = [("DELIVERED", 10, False), ("DELIVERED", 10, True), ("OPEN", 10, False)]
    got = status_of(spark, st.delivered_units("s", "u", "p"), rows, "s string, u bigint, p boolean")
    assert got == [10, 8, 0]
    got = status_of(spark, st.unmet_units("r", "a"), [(10, 4), (4, 10)], "r bigint, a bigint")
    assert got == [6, 0]
    got = status_of(spark, st.minimum_days("b", "c", "p"), [(21, "HIGH", 4), (30, "MISSION_CRITICAL", 3), (14, "ROUTINE", 5)], "b int, c string, p int")
    assert got == [27, 37, 17]
    got = status_of(spark, st.order_priority("c", "p"), [("ROUTINE", 5), ("MISSION_CRITICAL", 1), ("ROUTINE", 4), ("HIGH", 1), ("ROUTINE", 3)], "c string, p int")
    assert got == ["URGENT", "URGENT", "HIGH", "HIGH", "ROUTINE"]


def test_expiring_units(spark):
    now = dt.date(2024, 6, 1)
    d = lambda n: now + dt.timedelta(days=n)
    rows = [("a", d(-10), 100, 5), ("a", d(-10), 101, 7), ("a", d(-400), 365, 9), ("a", d(1), 5, 11), ("a", d(-10), 10, 2)]
    lots = spark.createDataFrame(rows, "k string, receipt_date date, shelf_life_days int, units int")
    r = st.expiring_units(lots, ["k"], now).first()
    assert (r.expiring_lots, r.expiring_units) == (2, 7)
