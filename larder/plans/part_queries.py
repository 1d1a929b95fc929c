"""Readiness by part and nation: the panel of every position that has lines, as rows where something changes.

Rows grow with the lines. They are daily totals before the first exchange by position, and that exchange, by part,
serves their sum, the part master and all frames. A part with a third of all lines is at most one row per nation, day
and frame edge there.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.scalars import add_days, month_of, padded_id, pmod, safe_ratio
from larder.operators import spans as sn
from larder.operators import status
from larder.operators.escalation import escalation, transfer_candidates
from larder.operators.ordering import top_n
from larder.operators.risk import PROBABILITY, high_risk_by_supplier, risk_by
from larder.operators.supply import Evidence, current_position, late_orders
from larder.operators.windows import frame
from larder.plans import model as m
from larder.plans.queries import _FIRED as FIRED
from larder.plans.queries import _NEAR as NEAR
from larder.plans.queries import _RISK as RISK
from larder.plans.registry import query
from larder.sources import tables as tb

KEYS = ["item_index", "location_index"]
DAY = "snapshot_date"
FLOWS = ["issues", "receipts", "warm_up_units"]
#: Days after a receipt on which it starts and stops to count as expiring within 90 days.
EXPIRING = (m.SHELF_LIFE_DAYS - 90, m.SHELF_LIFE_DAYS + 1)
#: Buckets of the stored spans; a setting of the build, like the partitions of a shuffle.
BUCKETS = 8
#: Lines behind the rows of one task, and tasks whose rows make a bucket once there are more than these buckets.
TASK_LINES, BUCKET_TASKS = 100_000, 8
_AS_OF, _START = f"DATE '{m.AS_OF}'", f"DATE '{m.START}'"


def part_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines of the days that the panel and its frames reach."""
    return m.table(spark, folder, "lineitem").filter(
        m._between("l_shipdate", m.START - dt.timedelta(days=m.WARMUP_DAYS), m.AS_OF + dt.timedelta(days=m.INBOUND_DAYS))
    )


def part_tasks(spark: SparkSession, folder: str) -> int:
    """Tasks for the panel, by a count of its lines, which reads their dates alone."""
    return max(1, -(-part_lines(spark, folder).count() // TASK_LINES))


def part_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Units per part, nation and day. Issues of the warm-up are a column of the first day."""
    q, day = F.col("l_quantity").cast("bigint"), F.to_date("l_shipdate")
    lines = part_lines(spark, folder).select("l_suppkey", "l_partkey", day.alias("__day"), "l_linestatus", q.alias("q"))
    where = m.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("location_index")
    )
    early, issued = F.col("__day") < F.lit(m.START), F.col("l_linestatus") == "O"

    def units(which: Column) -> Column:
        return F.sum(F.when(which, F.col("q")).otherwise(F.lit(0).cast("bigint")))

    return (
        lines.join(where, "l_suppkey")
        .groupBy(F.col("l_partkey").alias("item_index"), "location_index", F.greatest("__day", F.lit(m.START)).alias(DAY))
        .agg(
            units(issued & ~early).alias("issues"),
            units((F.col("l_linestatus") == "F") & ~early).alias("receipts"),
            units(issued & early).alias("warm_up_units"),
            F.min("l_suppkey").alias("supplier_index"),
        )
    )


def with_stock(rows: DataFrame, positions_by: Sequence[str]) -> DataFrame:
    """Stock, orders and supply of change rows with minimum and target days, cost and whether the item is kept cold."""
    everything = Window.partitionBy(*positions_by)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("baseline_daily_demand", F.sum("warm_up_units").over(everything) / F.lit(float(m.WARMUP_DAYS)))
    opening = F.floor(F.col("target_days_supply") * F.col("baseline_daily_demand")).cast("bigint")
    rows = status.stock_ledger(rows.withColumn("opening_units", opening), positions_by, DAY, "receipts", "issues", "opening_units")
    inbound = F.sum("receipts").over(frame(positions_by, DAY, 1, m.INBOUND_DAYS))
    aged = F.sum("receipts").over(frame(positions_by, DAY, -m.SHELF_LIFE_DAYS, 90 - m.SHELF_LIFE_DAYS))
    required = F.floor(F.col("minimum_days_supply") * F.col("baseline_daily_demand")).cast("bigint")
    return rows.withColumns({"on_order_units": F.coalesce(inbound, zero), "__aged": F.coalesce(aged, zero)}).withColumns(
        {
            "days_of_supply": status.days_of_supply("on_hand_units", "baseline_daily_demand"),
            "backordered_units": status.unmet_units(required, F.col("on_hand_units") + F.col("on_order_units")),
            "expiring_within_90_days_units": F.when(F.col("cold_chain_required"), F.least("on_hand_units", "__aged")).otherwise(zero),
        }
    ).drop("__aged")


def part_days(spark: SparkSession, folder: str, at: Sequence[dt.date] = (), shifts=None) -> DataFrame:
    """Change rows of every position with its stock."""
    rows = sn.change_rows(
        part_flows(spark, folder), KEYS, DAY, FLOWS, m.START, m.AS_OF, [m.START, *at], shifts, ["supplier_index"], ["item_index"],
        part_tasks(spark, folder),
    )
    cold = F.broadcast(m.commodities(spark).select("commodity_group", "cold_chain_required"))  # six rows
    parts = m.part_items(spark, folder).join(cold, "commodity_group").select(
        "item_index", "item_id", "commodity_group", "criticality", "base_min_days", "unit_cost_usd", "cold_chain_required"
    )
    sites = F.broadcast(m.locations(spark, folder).select("location_index", "location_id", "region", "mission_priority"))  # the nations
    minimum = status.minimum_days("base_min_days", "criticality", "mission_priority")
    rows = rows.join(parts, "item_index").join(sites, "location_index").withColumn("minimum_days_supply", minimum)
    target = F.col("minimum_days_supply") + 9 + pmod(F.col("location_index") * 7 + F.col("item_index") * 5, 11)
    supplier = F.min("supplier_index").over(Window.partitionBy(*KEYS))
    rows = rows.withColumns(
        {"target_days_supply": target.cast("int"), "preferred_supplier_id": padded_id("SUP", supplier + 1, 5)}
    )
    return with_stock(rows, KEYS)


def short() -> Column:
    return F.col("days_of_supply") < F.col("minimum_days_supply")


STOCK = ["on_hand_units", "on_order_units", "backordered_units", "expiring_within_90_days_units"]


def part_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Stock of every position as spans in which nothing changes; they cover the panel without gap or overlap."""
    rows = part_days(spark, folder, shifts={"receipts": (-m.INBOUND_DAYS, *EXPIRING)}).filter(F.col(DAY) <= F.lit(m.AS_OF))
    rows = sn.changes_only(rows, KEYS, DAY, STOCK).withColumns(
        {
            "valid_to": sn.valid_until(KEYS, DAY, m.AS_OF),
            "inventory_value_usd": status.extended_value("on_hand_units", "unit_cost_usd"),
            "inventory_status": status.inventory_status("on_hand_units", "days_of_supply", "minimum_days_supply"),
        }
    )
    return rows.withColumnRenamed(DAY, "valid_from")


def part_features(spark: SparkSession, folder: str, at: Sequence[dt.date] = (), label_horizon: int | None = None) -> DataFrame:
    """Trailing measures on the days of flows and on the days ``at``, optionally with the forward label."""
    rows = part_days(spark, folder, at)
    measures = {
        "avg_daily_demand_7d": sn.flow_mean(KEYS, DAY, "issues", 7, m.START),
        "avg_daily_demand_30d": sn.flow_mean(KEYS, DAY, "issues", 30, m.START),
        "demand_stddev_30d": sn.flow_std(KEYS, DAY, "issues", 30, m.START),
        "min_days_of_supply_30d": sn.level_min(KEYS, DAY, "days_of_supply", 30).cast("double"),
    }
    if label_horizon:
        measures["future_shortage_flag"] = sn.flag_ahead(KEYS, DAY, short(), label_horizon, m.AS_OF)
    rows = sn.with_level_mean(rows, KEYS, DAY, "days_of_supply", 7, m.START, "avg_days_of_supply_7d").withColumns(measures)
    mean30 = F.col("avg_daily_demand_30d")
    moved = (F.col("issues") > 0) | (F.col("receipts") > 0) | F.col(DAY).isin(list(at))
    return rows.filter(moved & (F.col(DAY) <= F.lit(m.AS_OF))).withColumns(
        {
            "demand_growth_7_vs_30": F.when(mean30 > 0, F.col("avg_daily_demand_7d") / mean30 - 1.0).otherwise(0.0),
            "demand_cv_30d": safe_ratio("demand_stddev_30d", mean30),
            "inventory_gap_days": (F.col("days_of_supply") - F.col("minimum_days_supply")).cast("double"),
            "on_order_coverage_days": safe_ratio("on_order_units", mean30),
        }
    )


# --- SQL: states by joins with the flows, days listed one by one -------------------------------------

_ISSUE = f"l_linestatus = 'O' AND CAST(l_shipdate AS DATE) >= {_START}"

PART_TABLES = {
    "pfl": f"""SELECT l_partkey AS item_index, CAST(s_nationkey AS BIGINT) AS location_index,
        greatest(CAST(l_shipdate AS DATE), {_START}) AS day,
        sum(CASE WHEN {_ISSUE} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS issues,
        sum(CASE WHEN l_linestatus = 'F' AND CAST(l_shipdate AS DATE) >= {_START} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS receipts,
        sum(CASE WHEN l_linestatus = 'O' AND CAST(l_shipdate AS DATE) < {_START} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS warm,
        min(l_suppkey) AS supplier_index
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE CAST(l_shipdate AS DATE) BETWEEN {_START} - {m.WARMUP_DAYS} AND {_AS_OF} + {m.INBOUND_DAYS} GROUP BY ALL""",
    "ppo": f"""SELECT *, CAST(minimum_days_supply + 9 + (location_index * 7 + item_index * 5) % 11 AS INTEGER) AS target_days_supply
        FROM (SELECT p.*, i.item_id, i.criticality, i.commodity_group, i.unit_cost_usd, c.cold_chain_required, l.location_id, l.region,
            CAST(i.base_min_days + CASE i.criticality WHEN 'MISSION_CRITICAL' THEN 7 WHEN 'HIGH' THEN 3 ELSE 0 END
                + CASE WHEN l.mission_priority >= 4 THEN 3 ELSE 0 END AS INTEGER) AS minimum_days_supply
            FROM (SELECT item_index, location_index, CAST(sum(warm) AS DOUBLE) / {m.WARMUP_DAYS}e0 AS base,
                printf('SUP-%05d', min(supplier_index) + 1) AS preferred_supplier_id FROM pfl GROUP BY ALL) p
            JOIN prt i USING (item_index) JOIN com c USING (commodity_group) JOIN loc l USING (location_index)) t""",
    "pcd": f"""SELECT item_index, location_index, day FROM pfl WHERE day <= {_AS_OF}
        UNION SELECT item_index, location_index, {_START} FROM pfl
        UNION SELECT item_index, location_index, day + k FROM pfl CROSS JOIN (VALUES (-{m.INBOUND_DAYS}), ({EXPIRING[0]}), ({EXPIRING[1]})) t(k)
        WHERE receipts > 0 AND day + k BETWEEN {_START} AND {_AS_OF}""",
    "psm": f"""SELECT x.item_index, x.location_index, x.day,
        CAST(coalesce(sum(f.receipts - f.issues) FILTER (f.day <= x.day), 0) AS BIGINT) AS moved_units,
        CAST(coalesce(sum(f.receipts) FILTER (f.day > x.day AND f.day <= x.day + {m.INBOUND_DAYS}), 0) AS BIGINT) AS on_order_units,
        CAST(coalesce(sum(f.receipts) FILTER (f.day BETWEEN x.day - {m.SHELF_LIFE_DAYS} AND x.day - {EXPIRING[0]}), 0) AS BIGINT) AS aged
        FROM pcd x JOIN pfl f ON f.item_index = x.item_index AND f.location_index = x.location_index GROUP BY ALL""",
    "pst0": """SELECT p.*, s.day, s.on_order_units, s.aged,
        greatest(0, CAST(floor(p.target_days_supply * p.base) AS BIGINT) + s.moved_units) AS on_hand_units
        FROM psm s JOIN ppo p USING (item_index, location_index)""",
    "pst": """SELECT * EXCLUDE (aged), CASE WHEN cold_chain_required THEN least(on_hand_units, aged) ELSE 0 END AS expiring_within_90_days_units,
        greatest(0, CAST(floor(minimum_days_supply * base) AS BIGINT) - on_hand_units - on_order_units) AS backordered_units,
        CAST(CASE WHEN base > 0 THEN floor(on_hand_units / base * 100e0 + 0.5e0) / 100e0 ELSE 0 END AS DECIMAL(18,2)) AS days_of_supply
        FROM pst0""",
    "pch": """SELECT * FROM (SELECT *, row(on_hand_units, on_order_units, expiring_within_90_days_units, backordered_units) AS state,
        lag(row(on_hand_units, on_order_units, expiring_within_90_days_units, backordered_units)) OVER w AS before FROM pst
        WINDOW w AS (PARTITION BY item_index, location_index ORDER BY day)) t WHERE before IS NULL OR state <> before""",
    "piv": f"""SELECT item_id, location_id, day AS valid_from, coalesce(lead(day) OVER w - 1, {_AS_OF}) AS valid_to, preferred_supplier_id,
        on_hand_units, on_order_units, backordered_units, expiring_within_90_days_units, days_of_supply, minimum_days_supply,
        CAST(on_hand_units * unit_cost_usd AS DECIMAL(28,2)) AS inventory_value_usd, criticality, region,
        CASE WHEN on_hand_units <= 0 THEN 'STOCKOUT' WHEN days_of_supply < minimum_days_supply THEN 'BELOW_MINIMUM'
            WHEN days_of_supply < minimum_days_supply + 7 THEN 'WATCH' ELSE 'HEALTHY' END AS inventory_status
        FROM pch WINDOW w AS (PARTITION BY item_index, location_index ORDER BY day)""",
    "pxd": f"""SELECT item_index, location_index, day FROM pfl WHERE day <= {_AS_OF} AND (issues > 0 OR receipts > 0)
        UNION SELECT item_index, location_index, {_AS_OF} FROM pfl""",
    "pdl": """SELECT x.item_index, x.location_index, x.day, g.n, s.days_of_supply, s.minimum_days_supply
        FROM (SELECT *, day + n AS at FROM pxd CROSS JOIN (SELECT CAST(unnest(generate_series(-29, 30)) AS INTEGER) AS n) q) x
        JOIN (SELECT CAST(unnest(generate_series(-29, 30)) AS INTEGER) AS n) g ON g.n = x.n
        ASOF JOIN pst s ON s.item_index = x.item_index AND s.location_index = x.location_index AND x.at >= s.day""",
    "plv": f"""SELECT item_index, location_index, day,
        CAST(sum(days_of_supply) FILTER (n BETWEEN -6 AND 0) AS DOUBLE) / count(*) FILTER (n BETWEEN -6 AND 0) AS avg_days_of_supply_7d,
        CAST(min(days_of_supply) FILTER (n <= 0) AS DOUBLE) AS min_days_of_supply_30d,
        CASE WHEN day + 30 <= {_AS_OF} THEN max(CASE WHEN days_of_supply < minimum_days_supply THEN 1 ELSE 0 END) FILTER (n >= 1) END
            AS future_shortage_flag FROM pdl GROUP BY item_index, location_index, day""",
    "pdm": f"""SELECT x.item_index, x.location_index, x.day, CAST(least(7, x.day - {_START} + 1) AS DOUBLE) AS n7,
        CAST(least(30, x.day - {_START} + 1) AS DOUBLE) AS n30,
        CAST(coalesce(sum(f.issues) FILTER (f.day > x.day - 7), 0) AS DOUBLE) AS d7, CAST(coalesce(sum(f.issues), 0) AS DOUBLE) AS d30,
        CAST(coalesce(sum(f.issues * f.issues), 0) AS DOUBLE) AS s30
        FROM pxd x LEFT JOIN pfl f ON f.item_index = x.item_index AND f.location_index = x.location_index
            AND f.day BETWEEN x.day - 29 AND x.day GROUP BY ALL""",
    "pft": """SELECT *, CASE WHEN avg_daily_demand_30d > 0 THEN avg_daily_demand_7d / avg_daily_demand_30d - 1e0 ELSE 0e0 END AS demand_growth_7_vs_30,
        CASE WHEN avg_daily_demand_30d > 0 THEN demand_stddev_30d / avg_daily_demand_30d ELSE 0e0 END AS demand_cv_30d,
        CASE WHEN avg_daily_demand_30d > 0 THEN on_order_units / avg_daily_demand_30d ELSE 0e0 END AS on_order_coverage_days
        FROM (SELECT s.item_id, s.location_id, x.day AS snapshot_date, s.preferred_supplier_id, s.on_hand_units, s.days_of_supply,
            s.minimum_days_supply, s.criticality, s.commodity_group, s.region, v.avg_days_of_supply_7d, v.min_days_of_supply_30d,
            v.future_shortage_flag, d.d7 / d.n7 AS avg_daily_demand_7d, d.d30 / d.n30 AS avg_daily_demand_30d,
            sqrt(greatest(0e0, d.n30 * d.s30 - d.d30 * d.d30)) / d.n30 AS demand_stddev_30d,
            CAST(s.days_of_supply - s.minimum_days_supply AS DOUBLE) AS inventory_gap_days,
            CAST(coalesce(o.on_order_units, 0) AS BIGINT) AS on_order_units, CAST(x.moved AS BOOLEAN) AS moved
            FROM (SELECT t.*, f.day IS NOT NULL AS moved FROM pxd t
                LEFT JOIN (SELECT * FROM pfl WHERE issues > 0 OR receipts > 0) f USING (item_index, location_index, day)) x
            JOIN plv v USING (item_index, location_index, day) JOIN pdm d USING (item_index, location_index, day)
            LEFT JOIN (SELECT x.item_index, x.location_index, x.day, sum(f.receipts) AS on_order_units FROM pxd x JOIN pfl f
                ON f.item_index = x.item_index AND f.location_index = x.location_index
                AND f.day > x.day AND f.day <= x.day + 14 GROUP BY ALL) o USING (item_index, location_index, day)
            ASOF JOIN pst s ON s.item_index = x.item_index AND s.location_index = x.location_index AND x.day >= s.day) t""",
}

PART_TABLES |= {
    "plt": """SELECT printf('PRT-%08d', l_partkey + 1) AS item_id, location_id, count(*) AS backordered_orders,
        CAST(sum(ordered_units) AS BIGINT) AS late_inbound_units, min(promised_delivery_date) AS waiting_since
        FROM ord1 WHERE order_status = 'BACKORDERED' GROUP BY ALL""",
    "pps": f"""SELECT v.* EXCLUDE (valid_from, valid_to), CAST(v.days_of_supply - v.minimum_days_supply AS DECIMAL(18,2)) AS days_above_minimum,
        {_AS_OF} + CAST(ceil(v.days_of_supply) AS INTEGER) AS runs_out_on, k.cold_chain_required, l.location_name, l.cold_storage_flag,
        p.supplier_name, p.actual_ontime_rate_90d, coalesce(o.backordered_orders, 0) AS backordered_orders,
        coalesce(o.late_inbound_units, 0) AS late_inbound_units, coalesce(a.active_events, 0) AS active_events,
        coalesce(a.active_event_types, []) AS active_event_types,
        4e0 * v.minimum_days_supply / (4e0 * v.minimum_days_supply + CAST(v.days_of_supply AS DOUBLE)) AS shortage_probability_30d
        FROM piv v JOIN (SELECT item_id, location_id, cold_chain_required FROM ppo) k USING (item_id, location_id)
        JOIN (SELECT location_id, location_name, cold_storage_flag FROM loc) l USING (location_id)
        LEFT JOIN perf p ON p.supplier_id = v.preferred_supplier_id LEFT JOIN plt o USING (item_id, location_id)
        LEFT JOIN active a ON a.supplier_id = v.preferred_supplier_id WHERE v.valid_to = {_AS_OF}""",
}

_SPAN = """item_id, location_id, valid_from, valid_to, preferred_supplier_id, on_hand_units, on_order_units, backordered_units,
    expiring_within_90_days_units, days_of_supply, minimum_days_supply, inventory_value_usd, inventory_status"""
_MEASURED = """item_id, location_id, snapshot_date, on_hand_units, days_of_supply, minimum_days_supply, avg_daily_demand_7d,
    avg_daily_demand_30d, demand_stddev_30d, avg_days_of_supply_7d, min_days_of_supply_30d, demand_growth_7_vs_30, demand_cv_30d,
    inventory_gap_days, on_order_coverage_days"""
_DESCRIBED = f"{_MEASURED}, preferred_supplier_id, criticality, commodity_group, region"


def _names(listed: str) -> list[str]:
    return [c.strip() for c in listed.split(",")]


@query("part_inventory", f"SELECT {_SPAN} FROM piv", PART_TABLES)
def _(spark, d):
    return part_inventory(spark, d).select(*_names(_SPAN))


@query("part_features", f"SELECT {_MEASURED} FROM pft WHERE moved", PART_TABLES)
def _(spark, d):
    return part_features(spark, d).select(*_names(_MEASURED))


@query("part_shortage_label", "SELECT item_id, location_id, snapshot_date, future_shortage_flag FROM pft WHERE moved", PART_TABLES)
def _(spark, d):
    return part_features(spark, d, label_horizon=30).select("item_id", "location_id", DAY, "future_shortage_flag")


@query(
    "part_training_set",
    f"""SELECT {_DESCRIBED}, future_shortage_flag AS shortage_within_30d FROM pft
    WHERE moved AND future_shortage_flag IS NOT NULL AND days_of_supply >= minimum_days_supply""",
    PART_TABLES,
)
def _(spark, d):
    """An example for each change of a position that isn't short and whose next 30 days are known."""
    rows = part_features(spark, d, label_horizon=30).filter(F.col("future_shortage_flag").isNotNull() & ~short())
    return rows.select(*_names(_DESCRIBED), F.col("future_shortage_flag").alias("shortage_within_30d"))


@query(
    "part_scoring_set",
    f"""SELECT {_DESCRIBED}, days_of_supply < minimum_days_supply AS currently_below_minimum FROM pft WHERE snapshot_date = {_AS_OF}""",
    PART_TABLES,
)
def _(spark, d):
    rows = part_features(spark, d, [m.AS_OF]).filter(F.col(DAY) == F.lit(m.AS_OF))
    return rows.select(*_names(_DESCRIBED), short().alias("currently_below_minimum"))


def current_stock(spark: SparkSession, folder: str) -> DataFrame:
    """The span that holds on the as-of date, one per position."""
    return part_inventory(spark, folder).filter(F.col("valid_to") == F.lit(m.AS_OF))


@query(
    "part_health_summary",
    f"""SELECT inventory_status, region, count(*) AS positions, CAST(sum(inventory_value_usd) AS DECIMAL(28,2)) AS value_usd
    FROM piv WHERE valid_to = {_AS_OF} GROUP BY ALL""",
    PART_TABLES,
)
def _(spark, d):
    return current_stock(spark, d).groupBy("inventory_status", "region").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("inventory_value_usd").cast("decimal(28,2)").alias("value_usd")
    )


@query(
    "part_watch_list",
    f"""SELECT item_id, location_id, criticality, days_of_supply, minimum_days_supply, backordered_units, preferred_supplier_id,
    CAST(days_of_supply - minimum_days_supply AS DECIMAL(18,2)) AS days_above_minimum
    FROM piv WHERE valid_to = {_AS_OF} ORDER BY days_above_minimum, backordered_units DESC, item_id, location_id LIMIT 25""",
    PART_TABLES,
)
def _(spark, d):
    margin = (F.col("days_of_supply") - F.col("minimum_days_supply")).cast("decimal(18,2)")
    rows = current_stock(spark, d).withColumn("days_above_minimum", margin)
    return top_n(rows, ["days_above_minimum", "-backordered_units", "item_id", "location_id"], 25).select(
        "item_id", "location_id", "criticality", "days_of_supply", "minimum_days_supply", "backordered_units",
        "preferred_supplier_id", "days_above_minimum",
    )


#: The longest lead time and the longest delay of the order lines.
LONGEST_LEAD, LONGEST_DELAY = 69, 18


def part_late_orders(spark: SparkSession, folder: str) -> DataFrame:
    """What each position waits for. An order promised and late on the as-of date has a date within a few months of
    it, so only those months of the orders are read."""
    heads = m.table(spark, folder, "orders").filter(
        m._between("o_orderdate", m.AS_OF - dt.timedelta(days=LONGEST_LEAD + LONGEST_DELAY), m.AS_OF)
    ).select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("order_date"))
    where = m.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("location_index")
    )
    lines = m.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("ordered_units")
    )
    rows = lines.join(heads, "l_orderkey").withColumn("promised_delivery_date", add_days("order_date", m.lead_days(F.col("l_suppkey"))))
    rows = rows.withColumns(
        {
            "__actual": add_days("promised_delivery_date", m._delay()),
            "__shipped": add_days("order_date", pmod(F.col("l_linenumber"), 4) + 1),
            "__cancelled": m._cancelled(),
            # Nothing of a backordered line has come.
            "delivered_units": F.lit(0).cast("bigint"),
        }
    )
    state = status.order_status(m.AS_OF, "__cancelled", "__actual", "promised_delivery_date", "__shipped")
    rows = rows.withColumn("order_status", state).filter(F.col("order_status") == "BACKORDERED").join(where, "l_suppkey")
    return late_orders(rows.withColumnsRenamed({"l_partkey": "item_index", "l_orderkey": "order_id"}), KEYS)


def part_position(spark: SparkSession, folder: str) -> DataFrame:
    """Current stock of every position with what is known of its site, its supplier and its late orders, and its risk."""
    known = [
        Evidence(m.locations(spark, folder), {"location_id": "location_id"}, ["location_name", "cold_storage_flag"], required=True),
        Evidence(m.performance(spark, folder), {"preferred_supplier_id": "supplier_id"}, ["supplier_name", "actual_ontime_rate_90d"]),
        Evidence(
            part_late_orders(spark, folder), {k: k for k in KEYS}, ["backordered_orders", "late_inbound_units"],
            {"backordered_orders": 0, "late_inbound_units": 0},
        ),
    ]
    stock = current_stock(spark, folder).withColumn(DAY, F.lit(m.AS_OF))
    risk = m.risk_score("days_of_supply", "minimum_days_supply")
    return current_position(stock, m.AS_OF, known).withColumn(PROBABILITY, risk)


_POSITION = """item_id, location_id, preferred_supplier_id, on_hand_units, on_order_units, backordered_units, days_of_supply,
    minimum_days_supply, days_above_minimum, runs_out_on, inventory_status, inventory_value_usd, criticality, cold_chain_required,
    region, location_name, supplier_name, actual_ontime_rate_90d, backordered_orders, late_inbound_units, shortage_probability_30d"""


@query("part_position", f"SELECT {_POSITION} FROM pps", PART_TABLES)
def _(spark, d):
    return part_position(spark, d).select(*_names(_POSITION))


@query(
    "part_escalation",
    f"""SELECT location_id, item_id, criticality, days_above_minimum, shortage_probability_30d,
    CAST(greatest({", ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in FIRED.values())}) AS INTEGER) AS escalation_level,
    list_filter([{", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, (c, _) in FIRED.items())}], lambda x: x IS NOT NULL) AS rule_ids
    FROM pps""",
    PART_TABLES,
)
def _(spark, d):
    return escalation(part_position(spark, d), None, m.supplier_events(spark, d), m.AS_OF)


@query(
    "part_transfers",
    f"""SELECT * FROM (SELECT r.item_id, r.location_id, r.own_risk, dn.donor_location_id, dn.donor_risk, dn.donor_surplus_days,
        CAST(row_number() OVER (PARTITION BY r.item_id, r.location_id
            ORDER BY donor_risk, donor_surplus_days DESC, donor_location_id) AS INTEGER) AS rank
        FROM (SELECT location_id, item_id, shortage_probability_30d AS own_risk FROM pps
            WHERE days_of_supply < minimum_days_supply OR ({NEAR})) r
        JOIN (SELECT location_id AS donor_location_id, item_id, shortage_probability_30d AS donor_risk,
            CAST(days_of_supply - minimum_days_supply AS DOUBLE) AS donor_surplus_days FROM pps
            WHERE days_of_supply > minimum_days_supply AND (NOT cold_chain_required OR cold_storage_flag)) dn
        ON dn.item_id = r.item_id AND dn.donor_risk < r.own_risk) WHERE rank <= 3""",
    PART_TABLES,
)
def _(spark, d):
    return transfer_candidates(part_position(spark, d), None, 3)


@query("part_risk_by", f"SELECT region, criticality, {RISK} FROM pps GROUP BY ALL", PART_TABLES)
def _(spark, d):
    return risk_by(part_position(spark, d), ["region", "criticality"])


@query(
    "part_high_risk_by_supplier",
    "SELECT preferred_supplier_id, count(*) AS positions_over FROM pps WHERE shortage_probability_30d >= 0.7 GROUP BY 1",
    PART_TABLES,
)
def _(spark, d):
    return high_risk_by_supplier(part_position(spark, d))


def store_spans(spans: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Spans by the month in which they end, in buckets of the position: a day reads the months from its own on, and
    two days of the same table meet without an exchange."""
    rows = spans.withColumn("until_month", month_of("valid_to"))
    keys = ("item_id", "location_id")
    tb.write_table(rows, name, layout=tb.Layout(("until_month",), keys, buckets), comment="Spans of stock by month of their end")


def stored_at(spark: SparkSession, name: str, on: dt.date) -> DataFrame:
    """The spans that hold on a day, from the months that can have them."""
    rows = tb.read_table(spark, name).filter(F.col("until_month") >= F.lit(on.replace(day=1)))
    return rows.filter((F.col("valid_from") <= F.lit(on)) & (F.col("valid_to") >= F.lit(on)))


def status_moves(spark: SparkSession, name: str, before: dt.date, on: dt.date) -> DataFrame:
    """Positions by their status on two days."""
    old = stored_at(spark, name, before).select("item_id", "location_id", F.col("inventory_status").alias("from_status"))
    now = stored_at(spark, name, on).select("item_id", "location_id", F.col("inventory_status").alias("to_status"))
    both = old.join(now, ["item_id", "location_id"])
    return both.groupBy("from_status", "to_status").agg(F.count(F.lit(1)).alias("positions"))


MOVED_SINCE = m.AS_OF - dt.timedelta(days=90)


@query(
    "part_status_moves",
    f"""SELECT o.inventory_status AS from_status, n.inventory_status AS to_status, count(*) AS positions
    FROM piv o JOIN piv n USING (item_id, location_id) WHERE n.valid_to = {_AS_OF}
    AND o.valid_from <= DATE '{MOVED_SINCE}' AND o.valid_to >= DATE '{MOVED_SINCE}' GROUP BY ALL""",
    PART_TABLES,
)
def _(spark, d):
    """The build job: spans written once, in a schema of its own, and read back for two days."""
    schema, before = f"readiness_{uuid.uuid4().hex}", spark.catalog.currentDatabase()
    tb.ensure_schema(spark, schema)
    spark.catalog.setCurrentDatabase(before)
    buckets = max(BUCKETS, -(-part_tasks(spark, d) // BUCKET_TASKS))
    store_spans(part_inventory(spark, d), f"{schema}.part_spans", buckets)
    return status_moves(spark, f"{schema}.part_spans", MOVED_SINCE, m.AS_OF)
