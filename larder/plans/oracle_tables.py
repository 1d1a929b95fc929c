"""The same derived tables in plain SQL, for checking results with another engine."""

from __future__ import annotations

import re
from collections.abc import Mapping

from larder.plans import model as m

_AS_OF = f"DATE '{m.AS_OF}'"
_START = f"DATE '{m.START}'"
_COMMODITIES = ", ".join(
    f"({i}, '{g}', '{f}', {b}, {str(c).lower()}, {s}, {u})" for i, g, f, b, c, s, u in m.COMMODITIES
)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def _criticality(index: str) -> str:
    value = f"(({index}) * 5 + 4) % 6"
    return f"CASE WHEN {value} < 1 THEN 'MISSION_CRITICAL' WHEN {value} < 3 THEN 'HIGH' ELSE 'ROUTINE' END"


def _crit_days(c: str) -> str:
    return f"CASE {c} WHEN 'MISSION_CRITICAL' THEN 7 WHEN 'HIGH' THEN 3 ELSE 0 END"


def rnd(x: str, digits: int) -> str:
    s = f"1e{digits}"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


_DELAY = """CASE WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3) % 100 < 70 + l_suppkey % 30
    THEN -((l_orderkey + l_partkey) % 3) ELSE 1 + (l_orderkey + l_partkey) % 18 END"""
_DAY_SHIP = "CAST(l_shipdate AS DATE)"


def _shipments(mode: str) -> str:
    if mode == "as_known":
        late = f"""CASE WHEN actual <= {_AS_OF} THEN date_diff('day', promised_delivery_date, actual)
            WHEN promised_delivery_date < {_AS_OF} THEN date_diff('day', promised_delivery_date, {_AS_OF}) END"""
    else:
        late = "date_diff('day', promised_delivery_date, actual)"
    return f"""SELECT shipment_id, order_id, ship_date, supplier_id, shipped_units, promised_delivery_date,
        CASE WHEN actual <= {_AS_OF} THEN actual END AS actual_delivery_date,
        CASE WHEN actual <= {_AS_OF} THEN 'DELIVERED' WHEN promised_delivery_date < {_AS_OF} THEN 'LATE'
            ELSE 'IN_TRANSIT' END AS shipment_status,
        CASE WHEN delay IS NOT NULL THEN CAST(greatest(0, delay) AS INTEGER) END AS days_late, delay <= 0 AS on_time_flag,
        CAST(date_trunc('month', ship_date) AS DATE) AS ship_month
    FROM (SELECT *, {late} AS delay FROM shipments_raw) t"""


def _performance(mode: str, source: str) -> str:
    upper = f"AND ship_date <= {_AS_OF}" if mode == "as_known" else ""
    rate = "CAST(count(*) FILTER (on_time_flag) AS DOUBLE) / nullif(count(on_time_flag), 0)"
    late = "CAST(sum(days_late) AS DOUBLE) / nullif(count(days_late), 0)"
    return f"""SELECT p.*, s.supplier_name, s.supplier_region, s.contract_lead_time_days
    FROM (SELECT supplier_id, count(*) AS shipments_90d, {rnd(rate, 4)} AS actual_ontime_rate_90d,
            {rnd(late, 2)} AS avg_days_late_90d, max(days_late) AS max_days_late_90d,
            count(*) FILTER (shipment_status = 'LATE') AS late_shipments_90d
        FROM {source} WHERE ship_date >= {_AS_OF} - 90 {upper} GROUP BY supplier_id) p
    JOIN sup s USING (supplier_id)"""


_EVENT_TYPES = [
    "MANUFACTURING_CONSTRAINT", "TRANSPORT_DELAY", "QUALITY_HOLD", "COLD_CHAIN_EXCEPTION",
    "RAW_MATERIAL_SHORTAGE", "CAPACITY_REDUCTION",
]

TABLES = {
    "com": f"""SELECT * FROM (VALUES {_COMMODITIES}) t(item_index, commodity_group, family_code, base_min_days,
        cold_chain_required, shelf_life_days, unit_cost_usd)""",
    "itm": f"""SELECT CAST(item_index AS BIGINT) AS item_index, commodity_group, family_code,
        CAST(base_min_days AS INTEGER) AS base_min_days, cold_chain_required,
        CAST(shelf_life_days AS INTEGER) AS shelf_life_days, CAST(unit_cost_usd AS DECIMAL(18,2)) AS unit_cost_usd,
        printf('ITM-%06d', item_index + 1) AS item_id,
        lower(commodity_group) || '/' || family_code || '/' || item_index AS item_name,
        {_criticality('item_index')} AS criticality,
        'MED-STOCK-' || family_code AS policy_reference_id,
        CAST(base_min_days + {_crit_days(_criticality('item_index'))} AS INTEGER) AS policy_min_days_supply
        FROM com""",
    "prt": f"""SELECT printf('PRT-%08d', p_partkey + 1) AS item_id, p_partkey AS item_index,
        c.commodity_group, c.family_code, CAST(c.base_min_days AS INTEGER) AS base_min_days,
        {_criticality('p_partkey')} AS criticality,
        CAST(p_retailprice AS DECIMAL(18,2)) AS unit_cost_usd
        FROM part JOIN com c ON p_type = c.commodity_group""",
    "loc": f"""SELECT CAST(n_nationkey AS BIGINT) AS location_index,
        printf('LOC-%05d', n_nationkey + 1) AS location_id, n_name AS location_name, r_name AS region,
        {_pick(m.SITE_KINDS, 'n_nationkey + n_regionkey')} AS site_kind,
        CAST(1 + (n_nationkey // 5) % 5 AS INTEGER) AS mission_priority, n_nationkey % 3 <> 0 AS cold_storage_flag
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "sup": f"""SELECT s_suppkey AS supplier_index, printf('SUP-%05d', s_suppkey + 1) AS supplier_id,
        s_name AS supplier_name, r_name AS supplier_region,
        {_pick(m.SUPPLIER_KINDS, 's_suppkey')} AS supplier_kind,
        CAST(7 + (s_suppkey * 29 + 3) % 63 AS INTEGER) AS contract_lead_time_days,
        CAST(floor(s_acctbal) AS BIGINT) AS account_balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "prs": """SELECT l.location_id, l.location_index, i.item_id, i.item_index, i.commodity_group, i.criticality,
        i.cold_chain_required, i.unit_cost_usd,
        printf('SUP-%05d', (i.item_index * 17 + l.location_index * 13) % (SELECT count(*) FROM supplier) + 1)
            AS preferred_supplier_id,
        CAST(i.policy_min_days_supply + CASE WHEN l.mission_priority >= 4 THEN 3 ELSE 0 END AS INTEGER)
            AS minimum_days_supply,
        CAST(i.policy_min_days_supply + CASE WHEN l.mission_priority >= 4 THEN 3 ELSE 0 END + 9
            + (l.location_index * 7 + i.item_index * 5) % 11 AS INTEGER) AS target_days_supply
        FROM loc l CROSS JOIN itm i""",
    "flows": f"""SELECT printf('LOC-%05d', s_nationkey + 1) AS location_id, i.item_id,
        {_DAY_SHIP} AS snapshot_date,
        CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS issues,
        CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS receipts
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
        JOIN itm i ON p_type = i.commodity_group
        WHERE {_DAY_SHIP} BETWEEN {_START} - {m.WARMUP_DAYS} AND {_AS_OF} + {m.INBOUND_DAYS} GROUP BY ALL""",
    "led": f"""SELECT d.*, coalesce(f.issues, 0) AS issues, coalesce(f.receipts, 0) AS receipts,
        CAST(floor(d.target_days_supply * d.baseline_daily_demand) AS BIGINT) AS opening_units,
        CAST(floor(d.target_days_supply * d.baseline_daily_demand) AS BIGINT)
            + CAST(sum(coalesce(f.receipts, 0) - coalesce(f.issues, 0)) OVER (PARTITION BY d.location_id, d.item_id
                ORDER BY d.snapshot_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_units
        FROM (SELECT p.*, coalesce(b.base, 0.0) AS baseline_daily_demand, CAST(g.day AS DATE) AS snapshot_date
            FROM prs p LEFT JOIN (SELECT location_id, item_id, CAST(sum(issues) AS DOUBLE) / {m.WARMUP_DAYS}e0 AS base
                FROM flows WHERE snapshot_date < {_START} GROUP BY ALL) b USING (location_id, item_id)
            CROSS JOIN (SELECT unnest(generate_series({_START}, {_AS_OF} + {m.INBOUND_DAYS}, INTERVAL 1 DAY)) AS day) g) d
        LEFT JOIN flows f ON f.location_id = d.location_id AND f.item_id = d.item_id
            AND f.snapshot_date = d.snapshot_date""",
    "inv0": f"""SELECT *, greatest(0, balance_units) AS on_hand_units,
        CAST(coalesce(sum(receipts) OVER (PARTITION BY location_id, item_id ORDER BY snapshot_date
            RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL {m.INBOUND_DAYS} DAY FOLLOWING), 0) AS BIGINT)
            AS on_order_units,
        CAST(coalesce(sum(receipts) OVER (PARTITION BY location_id, item_id ORDER BY snapshot_date
            RANGE BETWEEN INTERVAL {m.SHELF_LIFE_DAYS} DAY PRECEDING
            AND INTERVAL {m.SHELF_LIFE_DAYS - 90} DAY PRECEDING), 0) AS BIGINT) AS aged
        FROM led""",
    "inv1": f"""SELECT snapshot_date, CAST(date_trunc('month', snapshot_date) AS DATE) AS snapshot_month,
        location_id, item_id, preferred_supplier_id, issues AS daily_demand_units, on_hand_units, on_order_units,
        greatest(0, CAST(floor(minimum_days_supply * baseline_daily_demand) AS BIGINT)
            - on_hand_units - on_order_units) AS backordered_units,
        CASE WHEN cold_chain_required THEN least(on_hand_units, aged) ELSE 0 END AS expiring_within_90_days_units,
        CAST(CASE WHEN baseline_daily_demand > 0
            THEN floor(on_hand_units / baseline_daily_demand * 100e0 + 0.5e0) / 100e0 ELSE 0 END AS DECIMAL(18,2))
            AS days_of_supply,
        minimum_days_supply, target_days_supply,
        CAST(on_hand_units * unit_cost_usd AS DECIMAL(28,2)) AS inventory_value_usd
        FROM inv0 WHERE snapshot_date <= {_AS_OF}""",
    "inv": """SELECT *, CASE WHEN on_hand_units <= 0 THEN 'STOCKOUT'
        WHEN days_of_supply < minimum_days_supply THEN 'BELOW_MINIMUM'
        WHEN days_of_supply < minimum_days_supply + 7 THEN 'WATCH' ELSE 'HEALTHY' END AS inventory_status FROM inv1""",
    "shipments_raw": f"""SELECT printf('SHP-%010d', l_orderkey) AS shipment_id,
        printf('ORD-%010d', l_orderkey) AS order_id, {_DAY_SHIP} AS ship_date,
        printf('SUP-%05d', l_suppkey + 1) AS supplier_id, CAST(l_quantity AS BIGINT) AS shipped_units,
        {_DAY_SHIP} + CAST(5 + l_linenumber AS INTEGER) AS promised_delivery_date,
        {_DAY_SHIP} + CAST(5 + l_linenumber AS INTEGER) + CAST({_DELAY} AS INTEGER) AS actual
        FROM lineitem WHERE (l_orderkey * 7 + l_linenumber * 3) % 200 <> 0""",
    "shp": _shipments("as_known"),
    "shp_ref": _shipments("reference"),
    "perf": _performance("as_known", "shp"),
    "perf_ref": _performance("reference", "shp_ref"),
    "ord0": f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS ordered_units,
        CAST(o_orderdate AS DATE) AS order_date, printf('LOC-%05d', s_nationkey + 1) AS location_id, i.item_id,
        i.criticality, i.unit_cost_usd, l.mission_priority,
        CAST(o_orderdate AS DATE) + CAST(7 + (l_suppkey * 29 + 3) % 63 AS INTEGER) AS promised_delivery_date,
        CAST(o_orderdate AS DATE) + CAST(1 + l_linenumber % 4 AS INTEGER) AS ship_date,
        (l_orderkey * 7 + l_linenumber * 3) % 200 = 0 AS cancelled,
        (l_orderkey * 3 + l_partkey) % 25 = 0 AS part_fill,
        CAST(o_orderdate AS DATE) + CAST(7 + (l_suppkey * 29 + 3) % 63 AS INTEGER) + CAST({_DELAY} AS INTEGER) AS actual
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN part ON l_partkey = p_partkey JOIN itm i ON p_type = i.commodity_group
        JOIN loc l ON l.location_index = s_nationkey""",
    "ord1": f"""SELECT *, CASE WHEN cancelled THEN 'CANCELLED' WHEN actual <= {_AS_OF} THEN 'DELIVERED'
        WHEN promised_delivery_date < {_AS_OF} THEN 'BACKORDERED' WHEN ship_date <= {_AS_OF} THEN 'IN_TRANSIT'
        ELSE 'OPEN' END AS order_status FROM ord0""",
    "ord": """SELECT printf('ORD-%010d', l_orderkey) AS order_id, order_date,
        CAST(date_trunc('month', order_date) AS DATE) AS order_month, location_id, item_id,
        printf('SUP-%05d', l_suppkey + 1) AS supplier_id,
        CASE WHEN criticality = 'MISSION_CRITICAL' OR mission_priority >= 5 THEN 'URGENT'
            WHEN criticality = 'HIGH' OR mission_priority >= 4 THEN 'HIGH' ELSE 'ROUTINE' END AS order_priority,
        ordered_units,
        CASE WHEN order_status = 'DELIVERED' THEN CAST(floor(ordered_units * CASE WHEN part_fill THEN 0.75e0
            ELSE 1e0 END + 0.5e0) AS BIGINT) ELSE 0 END AS delivered_units,
        order_status, promised_delivery_date,
        CAST(ordered_units * unit_cost_usd AS DECIMAL(28,2)) AS extended_value_usd FROM ord1""",
    "late": """SELECT location_id, item_id, count(*) AS backordered_orders,
        CAST(sum(ordered_units - delivered_units) AS BIGINT) AS late_inbound_units,
        min(promised_delivery_date) AS waiting_since
        FROM ord WHERE order_status = 'BACKORDERED' GROUP BY ALL""",
    "evt": f"""SELECT printf('EVT-%06d', s_suppkey * 2 + k + 1) AS event_id,
        printf('SUP-%05d', s_suppkey + 1) AS supplier_id,
        {_pick(_EVENT_TYPES, 's_suppkey * 5 + k + 1')} AS event_type,
        CASE WHEN (s_suppkey + k) % 10 < 2 THEN 'SEVERE' WHEN (s_suppkey + k) % 10 < 6 THEN 'MODERATE' ELSE 'LOW' END AS severity,
        {_START} + CAST((s_suppkey * 97 + k * 211 + 13) % 520 AS INTEGER) AS start_date,
        {_START} + CAST((s_suppkey * 97 + k * 211 + 13) % 520 AS INTEGER)
            + CAST(5 + (s_suppkey * 17 + k * 7) % 36 AS INTEGER) AS end_date,
        CAST(5 + (s_suppkey * 17 + k * 7) % 36 AS INTEGER) AS duration_days
        FROM supplier CROSS JOIN (VALUES (0), (1)) t(k)""",
    "active": f"""SELECT supplier_id, count(*) AS active_events,
        list_sort(list_distinct(list(event_type))) AS active_event_types
        FROM evt WHERE start_date <= {_AS_OF} AND end_date >= {_AS_OF} GROUP BY supplier_id""",
    "pos": f"""SELECT v.*, CAST(v.days_of_supply - v.minimum_days_supply AS DECIMAL(18,2)) AS days_above_minimum,
        v.snapshot_date + CAST(ceil(v.days_of_supply) AS INTEGER) AS runs_out_on,
        i.item_name, i.commodity_group, i.criticality, i.cold_chain_required, i.policy_reference_id,
        l.location_name, l.region, l.mission_priority, p.supplier_name, p.contract_lead_time_days, p.actual_ontime_rate_90d,
        coalesce(o.backordered_orders, 0) AS backordered_orders, coalesce(o.late_inbound_units, 0) AS late_inbound_units
        FROM inv v JOIN itm i USING (item_id) JOIN loc l USING (location_id)
        LEFT JOIN perf p ON p.supplier_id = v.preferred_supplier_id
        LEFT JOIN late o USING (location_id, item_id) WHERE v.snapshot_date = {_AS_OF}""",
    "posx": """SELECT pos.*, coalesce(a.active_events, 0) AS active_events,
        coalesce(a.active_event_types, []) AS active_event_types, lc.cold_storage_flag
        FROM pos LEFT JOIN active a ON a.supplier_id = pos.preferred_supplier_id
        JOIN (SELECT location_id, cold_storage_flag FROM loc) lc USING (location_id)""",
    "feat0": """SELECT *,
        CAST(sum(daily_demand_units) OVER w7 AS DOUBLE) / count(*) OVER w7 AS avg_daily_demand_7d,
        CAST(sum(daily_demand_units) OVER w30 AS DOUBLE) / count(*) OVER w30 AS avg_daily_demand_30d,
        sqrt(greatest(0e0, CAST(count(*) OVER w30 AS DOUBLE)
            * CAST(sum(daily_demand_units * daily_demand_units) OVER w30 AS DOUBLE)
            - CAST(sum(daily_demand_units) OVER w30 AS DOUBLE) * CAST(sum(daily_demand_units) OVER w30 AS DOUBLE)))
            / CAST(count(*) OVER w30 AS DOUBLE) AS demand_stddev_30d,
        CAST(sum(days_of_supply) OVER w7 AS DOUBLE) / count(*) OVER w7 AS avg_days_of_supply_7d,
        CAST(min(days_of_supply) OVER w30 AS DOUBLE) AS min_days_of_supply_30d,
        max(CASE WHEN days_of_supply < minimum_days_supply THEN 1 ELSE 0 END) OVER (PARTITION BY location_id, item_id
            ORDER BY snapshot_date RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING)
            AS future_shortage_flag
        FROM inv WINDOW
        w7 AS (PARTITION BY location_id, item_id ORDER BY snapshot_date
            RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
        w30 AS (PARTITION BY location_id, item_id ORDER BY snapshot_date
            RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""",
    "feat": """SELECT *,
        CASE WHEN avg_daily_demand_30d > 0 THEN avg_daily_demand_7d / avg_daily_demand_30d - 1e0 ELSE 0e0 END
            AS demand_growth_7_vs_30,
        CASE WHEN avg_daily_demand_30d > 0 THEN demand_stddev_30d / avg_daily_demand_30d ELSE 0e0 END AS demand_cv_30d,
        CAST(days_of_supply - minimum_days_supply AS DOUBLE) AS inventory_gap_days,
        CASE WHEN avg_daily_demand_30d > 0 THEN on_order_units / avg_daily_demand_30d ELSE 0e0 END
            AS on_order_coverage_days FROM feat0""",
    "feat_x": """SELECT f.* EXCLUDE (snapshot_month, daily_demand_units, demand_stddev_30d, inventory_status, inventory_value_usd),
        i.commodity_group, i.criticality, i.unit_cost_usd, i.cold_chain_required, l.region, l.site_kind, l.mission_priority,
        s.supplier_kind, s.supplier_region, s.contract_lead_time_days, s.account_balance
        FROM feat f JOIN itm i USING (item_id) JOIN loc l USING (location_id)
        JOIN sup s ON s.supplier_id = f.preferred_supplier_id""",
    "trn": f"""SELECT * EXCLUDE (future_shortage_flag), CAST(future_shortage_flag AS INTEGER) AS shortage_within_30d
        FROM feat_x WHERE date_diff('day', {_START}, snapshot_date) % 7 = 0 AND snapshot_date <= {_AS_OF} - 30
        AND days_of_supply >= minimum_days_supply AND future_shortage_flag IS NOT NULL""",
    "scr": f"""SELECT * EXCLUDE (future_shortage_flag), days_of_supply < minimum_days_supply
        AS currently_below_minimum FROM feat_x WHERE snapshot_date = {_AS_OF}""",
    "pred": """SELECT snapshot_date, location_id, item_id, preferred_supplier_id, region, site_kind, commodity_group,
        criticality, supplier_kind, supplier_region, mission_priority, cold_chain_required, 4e0 * minimum_days_supply / (4e0 * minimum_days_supply
            + CAST(days_of_supply AS DOUBLE)) AS shortage_probability_30d FROM scr""",
    "trs": """SELECT *, 4e0 * minimum_days_supply / (4e0 * minimum_days_supply
        + CAST(days_of_supply AS DOUBLE)) AS p FROM trn""",
    "lab": """SELECT doc_id, quality, toxic, CAST((doc_id * 7919) % 1000 + 300 * quality AS DOUBLE) / 1300e0 AS p
        FROM labels""",
    "req": """SELECT event_id, user_id AS thread_id, ts, event_type AS name,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'finished' END AS outcome, value AS duration_s,
        CASE WHEN event_type = 'error' THEN props END AS error_detail FROM events""",
    "msg": """SELECT conv_id AS chat_id, 'm-' || conv_id || '-' || turn AS message_id, turn AS seq, role, text AS content,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS INTEGER)) AS created_at
        FROM conversations""",
    "cht": """SELECT chat_id, arg_min(content, seq) AS first_message, min(created_at) AS created_at FROM msg GROUP BY 1
        UNION ALL SELECT -c_custkey - 1, NULL, TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST(c_custkey AS INTEGER))
        FROM customer""",
}


def with_tables(body: str, more: Mapping[str, str] | None = None) -> str:
    """Put the derived tables that a query names, and those they name, in front of it."""
    tables = {**TABLES, **(more or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in tables.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    order = [n for n in tables if n in needed]
    return "WITH " + ",\n".join(f"{n} AS ({tables[n]})" for n in order) + "\n" + body
