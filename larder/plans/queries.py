"""Registered queries over the readiness tables, each with its SQL."""

from __future__ import annotations

import uuid

import datetime as dt
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import scalars as sc
from larder.functions import text as tx
from larder.operators import aggregates as ag
from larder.operators import checks as ck
from larder.operators import conversations as cv
from larder.operators import escalation as es
from larder.operators import features as ft
from larder.operators import joins as jn
from larder.operators import model_quality as mq
from larder.operators import ordering as od
from larder.operators import predicates as pr
from larder.operators import requests as rq
from larder.operators import retrieval as rt
from larder.operators import risk as rk
from larder.operators import status as st
from larder.operators import supply as sp
from larder.operators import windows as wn
from larder.plans import model as m
from larder.plans.oracle_tables import rnd
from larder.plans.registry import query
from larder.session import materialise, scratch_folder
from larder.sources import tables as tb
from larder.streaming import jobs as sj

AS_OF, START = m.AS_OF, m.START
_AS_OF, _START = f"DATE '{m.AS_OF}'", f"DATE '{m.START}'"
KEYS = m.LEDGER_KEYS
TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
FOLD_CUTS = [dt.date(2000, 6, 1), dt.date(2000, 10, 1), dt.date(2001, 2, 1)]


def _short() -> Column:
    return F.col("days_of_supply") < F.col("minimum_days_supply")


# --- sources ---------------------------------------------------------------------------------------


@query(
    "stored_table",
    """SELECT p_brand AS part_of, p_type AS name, count(*) AS parts FROM part WHERE p_brand IN (SELECT min(p_brand) FROM part) GROUP BY ALL
    UNION ALL SELECT 'tables left', t.name, (SELECT count(*) FROM part) FROM (VALUES ('stored_parts')) t(name)""",
)
def _(spark, d):
    """A schema of its own, a table replaced by one with more columns, one of two tables dropped; a partition read back."""
    schema, before = f"readiness_{uuid.uuid4().hex}", spark.catalog.currentDatabase()
    parts = m.table(spark, d, "part")
    tb.ensure_schema(spark, schema)
    spark.catalog.setCurrentDatabase(before)
    stored, other = f"{schema}.stored_parts", f"{schema}.other_parts"
    tb.write_table(parts.select("p_partkey"), stored)
    tb.write_table(parts.select("p_partkey", "p_type", "p_brand"), stored, ["p_brand"], "Parts by brand")
    tb.write_table(parts.select("p_partkey"), other)
    tb.drop_known(spark, schema, ["other_parts", "never_there"])
    rows = tb.read_table(spark, stored)
    first = parts.agg(F.min("p_brand").alias("least"))
    some = rows.join(first, F.col("p_brand") == F.col("least")).groupBy(F.col("p_brand").alias("part_of"), F.col("p_type").alias("name"))
    some = some.agg(F.count(F.lit(1)).alias("parts"))
    left = tb.list_tables(spark, schema).join(tb.table_counts({"stored_parts": rows}), "table_name")
    return some.unionByName(left.select(F.lit("tables left").alias("part_of"), F.col("table_name").alias("name"), F.col("rows").alias("parts")))


@query(
    "request_results",
    """SELECT CAST(user_id AS VARCHAR) AS thread_id, CAST(event_id AS VARCHAR) AS run_id,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'finished' END AS outcome,
    CASE WHEN event_type <> 'error' THEN printf('%.4f', value) END AS total_duration_s,
    CASE WHEN event_type = 'error' THEN nullif(props, '') END AS error_detail FROM events""",
)
def _(spark, d):
    """All requests written as CSV and read back as text."""
    failed, none = F.col("outcome") == "error", F.lit(None).cast("string")
    rows = m.requests(spark, d).select(
        none.alias("user_email"), F.col("thread_id"), F.col("event_id").alias("run_id"), F.lit(0).alias("message_index"), "outcome",
        F.when(~failed, F.col("duration_s")).alias("total_duration_s"), F.lit(None).cast("double").alias("ttft_s"),
        F.when(failed, 500).otherwise(200).alias("http_status"), "error_detail",
    )
    path = scratch_folder(spark, "requests")
    tb.write_requests_csv(rows, path)
    text = ", ".join(f"{c} string" for c in tb.REQUEST_FIELDS)
    back = spark.read.schema(text).option("header", True).option("multiLine", True).csv(path)
    return back.select("thread_id", "run_id", "outcome", "total_duration_s", "error_detail")


@query(
    "sections_csv",
    """SELECT 'SEC-' || item_id AS section_id, 'RULE-' || item_id % 7 AS policy_reference_id, text AS policy_title,
    item_id % 2 = 0 AS synthetic_policy, DATE '2001-01-01' + CAST(item_id % 28 AS INTEGER) AS effective_date FROM benchmark""",
)
def _(spark, d):
    """The benchmark passages as rule sections: written as quoted CSV, read back by the schema of sections."""
    item = F.col("item_id")
    made = {
        "policy_title": F.col("text"),
        "section_id": F.concat(F.lit("SEC-"), item),
        "policy_reference_id": F.concat(F.lit("RULE-"), item % 7),
        "synthetic_policy": item % 2 == 0,
        "effective_date": F.date_add(F.lit(dt.date(2001, 1, 1)), (item % 28).cast("int")),
    }
    names = [f.split()[0] for f in tb.SECTION_SCHEMA.split(", ")]
    rows = m.table(spark, d, "benchmark").select(*[made.get(c, F.lit("of the benchmark")).alias(c) for c in names])
    path = scratch_folder(spark, "sections")
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return tb.read_sections(spark, path).select("section_id", "policy_reference_id", "policy_title", "synthetic_policy", "effective_date")


@query("read_table", "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
def _(spark, d):
    tb.read_table(spark, "orders", d).createOrReplaceTempView("larder_orders")
    return ag.group_count(tb.read_table(spark, "larder_orders"), ["o_orderstatus"], "orders")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLE_NAMES))
def _(spark, d):
    return tb.table_counts({t: m.table(spark, d, t) for t in TABLE_NAMES})


@query("table_size_properties", " UNION ALL ".join(f"SELECT '{t}' AS table_name, true AS has_files, true AS megabytes_match" for t in TABLE_NAMES))
def _(spark, d):
    """What must hold of any inventory of files, whatever their number."""
    sizes = tb.table_sizes(spark, {t: f"{d}/{t}.parquet" for t in TABLE_NAMES})
    matches = F.abs(F.col("megabytes") - F.col("bytes") / 1048576) <= 0.005
    return sizes.select("table_name", ((F.col("files") >= 1) & (F.col("bytes") > 0)).alias("has_files"), matches.alias("megabytes_match"))


@query("table_sizes")
def _(spark, d):
    return tb.table_sizes(spark, {t: f"{d}/{t}.parquet" for t in TABLE_NAMES})


@query(
    "literal_table",
    "SELECT c.commodity_group, c.family_code, count(p_partkey) AS parts FROM com c LEFT JOIN part ON p_type = c.commodity_group GROUP BY ALL",
)
def _(spark, d):
    parts = m.table(spark, d, "part").groupBy(F.col("p_type").alias("commodity_group")).agg(F.count("p_partkey").alias("parts"))
    return m.commodities(spark).select("commodity_group", "family_code").join(parts, "commodity_group", "left").fillna({"parts": 0})


@query(
    "number_range",
    "SELECT g.id AS o_orderkey FROM range(0, (SELECT max(o_orderkey) + 1 FROM orders)) g(id) ANTI JOIN lineitem ON l_orderkey = g.id",
)
def _(spark, d):
    last = m.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    lines = m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return tb.number_range(spark, last + 1, "o_orderkey").join(lines, "o_orderkey", "left_anti")


@query(
    "date_spine",
    f"""SELECT CAST(g.day AS DATE) AS snapshot_date, count(o_orderkey) AS orders
    FROM (SELECT unnest(generate_series({_START}, {_AS_OF}, INTERVAL 1 DAY)) AS day) g
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(g.day AS DATE) GROUP BY 1""",
)
def _(spark, d):
    orders = m.table(spark, d, "orders").filter(m._between("o_orderdate", START, AS_OF))
    daily = orders.groupBy(F.to_date("o_orderdate").alias("snapshot_date")).agg(F.count("o_orderkey").alias("orders"))
    return tb.date_spine(spark, START, m.PANEL_DAYS).join(daily, "snapshot_date", "left").fillna({"orders": 0})


@query("prediction_view", "SELECT * FROM pred")
def _(spark, d):
    scoring = materialise(_scoring(spark, d))
    raw = m.raw_predictions(scoring, "days_of_supply")
    rk.prediction_view(scoring, raw, m.RAW_PREDICTION, "shortage_risk_predictions")
    return spark.table("shortage_risk_predictions")


def _stock(spark, d):
    """The inventory as a table of its own, for queries that read it more than once."""
    return materialise(m.inventory(spark, d))


def _scoring(spark, d, stock=None):
    stock = m.inventory(spark, d) if stock is None else stock
    return ft.scoring_set(stock, m.described(spark, d), AS_OF)


def _training(spark, d):
    return ft.training_set(m.inventory(spark, d), m.described(spark, d), START, AS_OF)


def _predictions(spark, d, stock=None):
    scoring = materialise(_scoring(spark, d, stock))  # the stand-in predictions are made from it too
    return rk.prediction_view(scoring, m.raw_predictions(scoring, "days_of_supply"), m.RAW_PREDICTION)


def _scored_training(spark, d):
    return _training(spark, d).withColumn("p", m.risk_score("days_of_supply", "minimum_days_supply"))


# --- projections and predicates --------------------------------------------------------------------


@query(
    "derived_columns",
    """SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(l_shipdate AS DATE) AS ship_date,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS ship_month,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,2))
        AS DOUBLE) AS net_price FROM lineitem""",
)
def _(spark, d):
    lines = m.table(spark, d, "lineitem").withColumns(
        {
            "ship_date": F.to_date("l_shipdate"),
            "ship_month": sc.month_of(F.to_date("l_shipdate")),
            "_factor": (F.lit(1) - F.col("l_discount").cast("decimal(18,2)")).cast("decimal(18,2)"),
        }
    ).withColumn("net_price", (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("_factor")).cast("double"))
    named = lines.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), "ship_date", "ship_month", "net_price", "_factor")
    return pr.publish(named)


@query("at_date", f"SELECT location_id, item_id, on_hand_units, inventory_status FROM inv WHERE snapshot_date = {_AS_OF}")
def _(spark, d):
    now = pr.at_date(m.inventory(spark, d), "snapshot_date", AS_OF, "snapshot_month")
    return now.select("location_id", "item_id", "on_hand_units", "inventory_status")


@query("trailing", f"SELECT supplier_id, count(*) AS shipments FROM shp WHERE ship_date >= {_AS_OF} - 90 GROUP BY 1")
def _(spark, d):
    return ag.group_count(pr.trailing(m.shipments(spark, d), "ship_date", AS_OF, 90, "ship_month"), ["supplier_id"], "shipments")


@query("label_complete", f"SELECT snapshot_date, count(*) AS positions FROM inv WHERE snapshot_date <= {_AS_OF} - 30 GROUP BY 1")
def _(spark, d):
    rows = pr.label_complete(m.inventory(spark, d), "snapshot_date", AS_OF, 30, "snapshot_month")
    return ag.group_count(rows, ["snapshot_date"], "positions")


@query(
    "every_k_days",
    f"SELECT snapshot_date, count(*) AS positions FROM inv WHERE date_diff('day', {_START}, snapshot_date) % 7 = 0 GROUP BY 1",
)
def _(spark, d):
    return ag.group_count(pr.every_k_days(m.inventory(spark, d), "snapshot_date", START, 7), ["snapshot_date"], "positions")


@query(
    "predicates",
    """SELECT order_status, order_priority, count(*) AS lines FROM ord WHERE order_status <> 'CANCELLED'
    AND order_priority IN ('URGENT', 'HIGH') AND (delivered_units < ordered_units OR order_status = 'OPEN')
    AND promised_delivery_date IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    rows = m.order_lines(spark, d).filter(
        (F.col("order_status") != "CANCELLED")
        & F.col("order_priority").isin("URGENT", "HIGH")
        & ((F.col("delivered_units") < F.col("ordered_units")) | (F.col("order_status") == "OPEN"))
        & F.col("promised_delivery_date").isNotNull()
    )
    return ag.group_count(rows, ["order_status", "order_priority"], "lines")


@query(
    "fill_nulls",
    """SELECT location_id, item_id, coalesce(backordered_orders, 0) AS backordered_orders,
    coalesce(late_inbound_units, 0) AS late_inbound_units FROM prs LEFT JOIN late USING (location_id, item_id)""",
)
def _(spark, d):
    late = sp.late_orders(m.order_lines(spark, d)).drop("waiting_since")
    both = m.pairs(spark, d).select(*KEYS).join(late, KEYS, "left")
    return pr.fill_nulls(both, {"backordered_orders": 0, "late_inbound_units": 0})


# --- joins -----------------------------------------------------------------------------------------


@query(
    "enrich",
    """SELECT region, supplier_kind, commodity_group, CAST(sum(on_hand_units) AS BIGINT) AS on_hand_units
    FROM inv JOIN (SELECT item_id, commodity_group FROM itm) i USING (item_id) JOIN loc USING (location_id)
    JOIN sup ON supplier_id = preferred_supplier_id GROUP BY ALL""",
)
def _(spark, d):
    out = jn.enrich(m.inventory(spark, d), m.items(spark), "item_id", ["commodity_group"])
    out = jn.enrich(out, m.locations(spark, d), "location_id", ["region"])
    out = jn.enrich(out, m.suppliers(spark, d), "preferred_supplier_id", ["supplier_kind"], dim_key="supplier_id")
    return out.groupBy("region", "supplier_kind", "commodity_group").agg(F.sum("on_hand_units").alias("on_hand_units"))


@query(
    "join_dropping",
    "SELECT o_orderpriority, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def _(spark, d):
    both = jn.join_dropping(m.table(spark, d, "lineitem"), m.table(spark, d, "orders"), "l_orderkey", "o_orderkey")
    return ag.group_count(both, ["o_orderpriority"], "lines")


@query(
    "composite_join",
    """SELECT p.location_id, p.item_id, p.minimum_days_supply, CAST(sum(o.ordered_units) AS BIGINT) AS ordered_units
    FROM ord o JOIN prs p ON o.location_id = p.location_id AND o.item_id = p.item_id GROUP BY ALL""",
)
def _(spark, d):
    lines = m.order_lines(spark, d).groupBy(*KEYS).agg(F.sum("ordered_units").alias("ordered_units"))
    return jn.enrich(lines, m.pairs(spark, d), KEYS, ["minimum_days_supply"])


@query(
    "left_join_filled",
    """SELECT supplier_id, supplier_name, coalesce(shipments_90d, 0) AS shipments_90d, actual_ontime_rate_90d
    FROM sup LEFT JOIN (SELECT supplier_id, shipments_90d, actual_ontime_rate_90d FROM perf) p USING (supplier_id)""",
)
def _(spark, d):
    measured = m.performance(spark, d).select("supplier_id", "shipments_90d", "actual_ontime_rate_90d")
    return jn.left_join_filled(
        m.suppliers(spark, d).select("supplier_id", "supplier_name"), measured, ["supplier_id"], {"shipments_90d": 0}
    )


@query("orphans", "SELECT DISTINCT o_custkey FROM orders ANTI JOIN (SELECT DISTINCT conv_id FROM conversations) c ON o_custkey = c.conv_id")
def _(spark, d):
    return jn.orphans(m.table(spark, d, "orders"), m.table(spark, d, "conversations"), "o_custkey", "conv_id")


@query(
    "panel",
    """SELECT location_id, item_id, CAST(date_trunc('month', snapshot_date) AS DATE) AS month, count(*) AS days,
    count(*) FILTER (issues > 0) AS demand_days FROM led GROUP BY ALL""",
)
def _(spark, d):
    rows = m.ledger(spark, d)
    return rows.groupBy(*KEYS, F.trunc("snapshot_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("issues") > 0).alias("demand_days")
    )


@query(
    "modular_bridge",
    """SELECT s_suppkey, CAST(slot AS INTEGER) AS slot, p_partkey, p_type
    FROM (SELECT s_suppkey, slot, (s_suppkey * 29 + slot * 61) % (SELECT count(*) FROM part) AS k
        FROM supplier CROSS JOIN range(0, 5) t(slot)) b JOIN part ON p_partkey = k""",
)
def _(spark, d):
    parts = m.table(spark, d, "part")
    bridge = jn.modular_bridge(m.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 5, parts.count(), 29, 61)
    return jn.enrich(bridge, parts, "target_index", ["p_type"], dim_key="p_partkey").withColumnRenamed("target_index", "p_partkey")


@query("active_disruptions", f"SELECT * FROM evt WHERE start_date <= {_AS_OF} AND end_date >= {_AS_OF}")
def _(spark, d):
    return jn.active_disruptions(m.supplier_events(spark, d), AS_OF)


@query("attach_active", "SELECT location_id, item_id, preferred_supplier_id, active_events, active_event_types FROM posx")
def _(spark, d):
    pairs = m.pairs(spark, d).select(*KEYS, "preferred_supplier_id")
    return jn.attach_active(pairs, m.supplier_events(spark, d), AS_OF)


@query(
    "disruption_days",
    """SELECT v.location_id, v.item_id, v.snapshot_date, count(DISTINCT a.day) AS disrupted_days
    FROM inv v LEFT JOIN (SELECT DISTINCT supplier_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
        FROM evt) a ON a.supplier_id = v.preferred_supplier_id AND a.day BETWEEN v.snapshot_date - 29 AND v.snapshot_date
    GROUP BY ALL""",
)
def _(spark, d):
    daily = m.inventory(spark, d).select(*KEYS, "preferred_supplier_id", "snapshot_date")
    return jn.disruption_days(daily, m.supplier_events(spark, d), 30).drop("preferred_supplier_id")


@query(
    "disruption_days_ahead",
    """SELECT v.location_id, v.item_id, v.snapshot_date, count(DISTINCT a.day) AS disrupted_days
    FROM inv v LEFT JOIN (SELECT DISTINCT supplier_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
        FROM evt) a ON a.supplier_id = v.preferred_supplier_id AND a.day BETWEEN v.snapshot_date + 1 AND v.snapshot_date + 30
    GROUP BY ALL""",
)
def _(spark, d):
    """The next 30 days, without today."""
    daily = m.inventory(spark, d).select(*KEYS, "preferred_supplier_id", "snapshot_date")
    return jn.disruption_days(daily, m.supplier_events(spark, d), 0, ahead=30).drop("preferred_supplier_id")


# --- aggregates ------------------------------------------------------------------------------------


@query(
    "basic_aggregates",
    f"""SELECT shipment_status, count(*) AS shipments, count(actual_delivery_date) AS arrived,
    {rnd("CAST(count(*) FILTER (on_time_flag) AS DOUBLE) / nullif(count(on_time_flag), 0)", 4)} AS on_time_rate,
    {rnd("CAST(sum(days_late) AS DOUBLE) / nullif(count(days_late), 0)", 2)} AS avg_days_late,
    max(days_late) AS max_days_late, count(*) FILTER (days_late > 7) AS very_late, min(ship_date) AS first_ship_date
    FROM shp GROUP BY 1""",
)
def _(spark, d):
    return m.shipments(spark, d).groupBy("shipment_status").agg(
        F.count(F.lit(1)).alias("shipments"),
        F.count("actual_delivery_date").alias("arrived"),
        sc.round_to(ag.rate("on_time_flag"), 4).alias("on_time_rate"),
        sc.round_to(ag.exact_mean("days_late"), 2).alias("avg_days_late"),
        F.max("days_late").alias("max_days_late"),
        F.count_if(F.col("days_late") > 7).alias("very_late"),
        F.min("ship_date").alias("first_ship_date"),
    )


@query(
    "sum_money",
    """SELECT order_status, CAST(sum(ordered_units - delivered_units) AS BIGINT) AS open_units,
    CAST(sum(extended_value_usd) AS DECIMAL(28,2)) AS value_usd FROM ord GROUP BY 1""",
)
def _(spark, d):
    return m.order_lines(spark, d).groupBy("order_status").agg(
        F.sum(F.col("ordered_units") - F.col("delivered_units")).alias("open_units"),
        ag.money("extended_value_usd").alias("value_usd"),
    )


@query("distinct_keys", "SELECT DISTINCT location_id, item_id FROM ord")
def _(spark, d):
    return m.order_lines(spark, d).select(*KEYS).distinct()


@query("share", "SELECT l_returnflag, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1")
def _(spark, d):
    return wn.share(m.table(spark, d, "lineitem"), ["l_returnflag"])


_RISK = f"""count(*) AS positions,
    {rnd("CAST(sum(CAST(shortage_probability_30d AS DECIMAL(28,12))) AS DOUBLE) / count(*)", 9)} AS avg_probability_of_positions,
    max(shortage_probability_30d) AS max_probability_of_positions"""


@query("risk_by", f"SELECT region, criticality, {_RISK} FROM pred GROUP BY ALL")
def _(spark, d):
    return rk.risk_by(_predictions(spark, d), ["region", "criticality"])


@query("risk_by_rollup", f"SELECT region, criticality, {_RISK} FROM pred GROUP BY ROLLUP (region, criticality)")
def _(spark, d):
    return rk.risk_by(_predictions(spark, d), ["region", "criticality"], "rollup")


@query("risk_by_cube", f"SELECT supplier_kind, site_kind, {_RISK} FROM pred GROUP BY CUBE (supplier_kind, site_kind)")
def _(spark, d):
    return rk.risk_by(_predictions(spark, d), ["supplier_kind", "site_kind"], "cube")


@query("count_over", "SELECT region, count(*) FILTER (shortage_probability_30d >= 0.7) AS positions_over FROM pred GROUP BY 1")
def _(spark, d):
    return rk.count_over(_predictions(spark, d), ["region"], 0.70)


def _latency(extra: str = "", tail: str = "") -> str:
    return f"""SELECT {extra} count(*) AS requests, min(duration_s) AS min, max(duration_s) AS max,
    {rnd("CAST(sum(CAST(duration_s AS DECIMAL(28,6))) AS DOUBLE) / count(*)", 6)} AS mean,
    {rnd("quantile_cont(duration_s, 0.5)", 6)} AS p50, {rnd("quantile_cont(duration_s, 0.9)", 6)} AS p90,
    {rnd("quantile_cont(duration_s, 0.99)", 6)} AS p99 FROM req {tail}"""


@query("latency_summary", _latency())
def _(spark, d):
    return rq.latency_summary(m.requests(spark, d))


@query("latency_by_name", _latency("name,", "GROUP BY name"))
def _(spark, d):
    return rq.latency_summary(m.requests(spark, d), by=["name"])


@query("outcomes", "SELECT outcome, count(*) AS count FROM req GROUP BY 1")
def _(spark, d):
    return rq.outcomes(m.requests(spark, d))


@query(
    "throughput",
    f"""SELECT requests, finished, failed, wall_s, {rnd("requests / wall_s", 9)} AS requests_per_s FROM (
    SELECT count(*) AS requests, count(*) FILTER (outcome = 'finished') AS finished,
    count(*) FILTER (outcome <> 'finished') AS failed,
    CAST(date_diff('microsecond', min(ts), max(ts)) AS DOUBLE) / 1000000e0 AS wall_s FROM req)""",
)
def _(spark, d):
    return rq.throughput(m.requests(spark, d), "ts", "ts")


@query(
    "span_stats",
    """SELECT name, outcome = 'finished' AS success,
    CAST(CASE WHEN duration_s < 0 THEN 0 WHEN duration_s >= 100 THEN 11 ELSE floor(duration_s / 100e0 * 10) + 1 END AS INTEGER) AS bucket,
    count(*) AS spans, CAST(sum(CAST(duration_s AS DECIMAL(18,6))) AS DOUBLE) AS total_s FROM req GROUP BY ALL""",
)
def _(spark, d):
    spans = m.requests(spark, d).withColumn("success", F.col("outcome") == "finished")
    return rq.span_stats(spans)


@query(
    "progress",
    """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS errors,
    count(*) AS total, bool_and(event_type = 'purchase') AS all_done, bool_or(event_type = 'error') AS any_error
    FROM events GROUP BY 1""",
)
def _(spark, d):
    e = m.table(spark, d, "events")
    return ag.progress(e, ["user_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("concat_deltas", "SELECT chat_id, string_agg(content, '' ORDER BY seq) AS text FROM msg GROUP BY 1")
def _(spark, d):
    return ag.concat_deltas(m.messages(spark, d), ["chat_id"], "seq", "content", "text")


@query("latest_time", "SELECT chat_id, max(created_at) AS update_time FROM msg GROUP BY 1")
def _(spark, d):
    return m.messages(spark, d).groupBy("chat_id").agg(F.max("created_at").alias("update_time"))


# --- windows ---------------------------------------------------------------------------------------

_W = "PARTITION BY location_id, item_id ORDER BY snapshot_date RANGE BETWEEN"


@query("trailing_avg", "SELECT location_id, item_id, snapshot_date, avg_daily_demand_7d FROM feat0")
def _(spark, d):
    out = wn.trailing_avg(m.inventory(spark, d), KEYS, "snapshot_date", "daily_demand_units", 7, "avg_daily_demand_7d", 0)
    return out.select(*KEYS, "snapshot_date", "avg_daily_demand_7d")


@query("trailing_std", "SELECT location_id, item_id, snapshot_date, demand_stddev_30d FROM feat0")
def _(spark, d):
    out = wn.trailing_std(m.inventory(spark, d), KEYS, "snapshot_date", "daily_demand_units", 30, "demand_stddev_30d", 0)
    return out.select(*KEYS, "snapshot_date", "demand_stddev_30d")


@query(
    "trailing_min",
    f"""SELECT location_id, item_id, snapshot_date, min(on_hand_units) OVER ({_W} INTERVAL 29 DAY PRECEDING AND CURRENT ROW)
    AS min_on_hand_30d FROM inv""",
)
def _(spark, d):
    out = wn.trailing_min(m.inventory(spark, d), KEYS, "snapshot_date", "on_hand_units", 30, "min_on_hand_30d")
    return out.select(*KEYS, "snapshot_date", "min_on_hand_30d")


@query(
    "future_flag",
    f"""SELECT location_id, item_id, snapshot_date, max(CASE WHEN inventory_status = 'STOCKOUT' THEN 1 ELSE 0 END)
    OVER ({_W} INTERVAL 1 DAY FOLLOWING AND INTERVAL 14 DAY FOLLOWING) AS stockout_within_14d FROM inv""",
)
def _(spark, d):
    hit = F.col("inventory_status") == "STOCKOUT"
    out = wn.future_flag(m.inventory(spark, d), KEYS, "snapshot_date", hit, 14, "stockout_within_14d")
    return out.select(*KEYS, "snapshot_date", "stockout_within_14d")


@query(
    "days_to_shortage",
    f"""SELECT location_id, item_id, snapshot_date, CAST(date_diff('day', snapshot_date, min(CASE WHEN days_of_supply < minimum_days_supply THEN snapshot_date END)
    OVER ({_W} INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING)) AS INTEGER) AS days_to_shortage FROM inv""",
)
def _(spark, d):
    out = wn.days_to_shortage(m.inventory(spark, d), KEYS, "snapshot_date", _short(), 30)
    return out.select(*KEYS, "snapshot_date", "days_to_shortage")


@query(
    "latest_per",
    """SELECT chat_id, message_id, seq, role, content, created_at FROM msg
    QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, seq DESC) = 1""",
)
def _(spark, d):
    return wn.latest_per(m.messages(spark, d), ["chat_id"], ["created_at", "seq"])


@query(
    "active_id",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS active_id FROM events""",
)
def _(spark, d):
    e = m.table(spark, d, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("own")
    )
    return cv.active_id(e, ["user_id"], "event_id", "own").drop("own")


@query(
    "part_demand",
    f"""SELECT l_partkey, day, units, CAST(sum(units) OVER w30 AS DOUBLE) / count(*) OVER w30 AS avg_units_30d,
    min(units) OVER w30 AS min_units_30d, coalesce(max(CASE WHEN units >= 50 THEN 1 ELSE 0 END) OVER n30, 0) AS large_within_30d
    FROM (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units
        FROM lineitem GROUP BY ALL)
    WINDOW w30 AS (PARTITION BY l_partkey ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW),
    n30 AS (PARTITION BY l_partkey ORDER BY day RANGE BETWEEN INTERVAL 1 DAY FOLLOWING AND INTERVAL 30 DAY FOLLOWING)""",
)
def _(spark, d):
    """Trailing and forward windows at part level, over days with demand only: as many rows as the lines make."""
    daily = m.table(spark, d, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("units")
    )
    out = wn.trailing_avg(daily, ["l_partkey"], "day", "units", 30, "avg_units_30d", 0)
    out = wn.trailing_min(out, ["l_partkey"], "day", "units", 30, "min_units_30d")
    out = wn.future_flag(out, ["l_partkey"], "day", F.col("units") >= 50, 30, "large_within_30d")
    return out.fillna({"large_within_30d": 0})


_TOP = "ORDER BY shortage_probability_30d DESC, location_id, item_id"


@query("top_risk", f"SELECT * FROM pred {_TOP} LIMIT 20")
def _(spark, d):
    return rk.top_risk(_predictions(spark, d), 20)


@query(
    "top_risk_per_region",
    f"SELECT *, CAST(row_number() OVER (PARTITION BY region {_TOP}) AS INTEGER) AS rank FROM pred QUALIFY rank <= 3",
)
def _(spark, d):
    return rk.top_risk(_predictions(spark, d), 3, ["region"])


# --- ordering --------------------------------------------------------------------------------------

_LINE_ORDER = "l_extendedprice DESC, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"


@query("top_n", f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' ORDER BY {_LINE_ORDER} LIMIT 30")
def _(spark, d):
    spec = ["-l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    lines = m.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
    return od.top_n(lines, spec, 30).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("order_desc", "SELECT order_priority, count(*) AS lines FROM ord GROUP BY 1")
def _(spark, d):
    return od.order_desc(ag.group_count(m.order_lines(spark, d), ["order_priority"], "lines"), "lines", "order_priority")


@query("first_row", "SELECT * FROM sup ORDER BY contract_lead_time_days, supplier_id LIMIT 1")
def _(spark, d):
    return od.first_row(m.suppliers(spark, d), ["contract_lead_time_days", "supplier_id"])


@query("cap_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def _(spark, d):
    return od.cap_rows(m.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, ["o_orderkey"])


@query("page", "SELECT chat_id, created_at FROM cht ORDER BY created_at, chat_id LIMIT 100 OFFSET 200")
def _(spark, d):
    return od.page(m.chats(spark, d).select("chat_id", "created_at"), ["created_at", "chat_id"], 200, 100)


@query("page_after", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return od.page_after(m.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


@query("newest_chats", "SELECT chat_id, created_at FROM cht ORDER BY created_at DESC, chat_id")
def _(spark, d):
    return od.newest_chats(m.chats(spark, d).select("chat_id", "created_at"))


@query(
    "error_samples",
    "SELECT event_id, name, substr(error_detail, 1, 200) AS error_detail FROM req WHERE error_detail <> '' ORDER BY event_id LIMIT 5",
)
def _(spark, d):
    return rq.error_samples(m.requests(spark, d), ["event_id"]).select("event_id", "name", "error_detail")


# --- scalar functions ------------------------------------------------------------------------------


@query(
    "id_functions",
    """SELECT printf('CUST-%05d', c_custkey + 1) AS customer_id, c_mktsegment || '/' || c_name AS label,
    substr(c_name, 10, 20) AS tail, lower(replace(c_mktsegment || '_SEGMENT', '_', ' ')) AS words,
    substr(sha256('chat' || chr(0) || c_custkey || chr(0) || c_name), 1, 64) AS dedup FROM customer""",
)
def _(spark, d):
    return m.table(spark, d, "customer").select(
        sc.padded_id("CUST", F.col("c_custkey") + 1, 5).alias("customer_id"),
        F.concat("c_mktsegment", F.lit("/"), "c_name").alias("label"),
        F.substring("c_name", 10, 20).alias("tail"),
        tx.humanise(F.concat("c_mktsegment", F.lit("_SEGMENT"))).alias("words"),
        tx.dedup_key("chat", "c_custkey", "c_name").alias("dedup"),
    )


@query(
    "number_functions",
    """SELECT p_partkey, ['A', 'B', 'C'][CAST((p_partkey * 5 + 2) % 3 AS INTEGER) + 1] AS picked, (p_partkey * 7 + 3) % 12 AS remainder,
    CASE WHEN (p_partkey * 37 + 11) % 100 < 18 THEN 'MISSION_CRITICAL' WHEN (p_partkey * 37 + 11) % 100 < 55 THEN 'HIGH' ELSE 'ROUTINE' END AS banded,
    floor(p_retailprice / 7e0 * 100e0 + 0.5e0) / 100e0 AS rounded, CAST(ceil(p_retailprice / 7e0) AS INTEGER) AS up,
    CAST(floor(p_retailprice / 7e0) AS INTEGER) AS down, least(1500e0, greatest(950e0, p_retailprice)) AS clamped,
    CASE WHEN p_size - 25 > 0 THEN p_retailprice / (p_size - 25) ELSE 0e0 END AS ratio,
    TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS brand_number, TRY_CAST(p_brand AS INTEGER) AS no_number,
    CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'medium' ELSE 'small' END AS size_class FROM part""",
)
def _(spark, d):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return m.table(spark, d, "part").select(
        "p_partkey",
        sc.pick(["A", "B", "C"], k * 5 + 2).alias("picked"),
        sc.pmod(k * 7 + 3, 12).alias("remainder"),
        sc.band(sc.pmod(k * 37 + 11, 100), [18, 55], ["MISSION_CRITICAL", "HIGH", "ROUTINE"]).alias("banded"),
        sc.round_to(price / 7.0, 2).alias("rounded"),
        sc.ceil_int(price / 7.0).alias("up"),
        sc.floor_int(price / 7.0).alias("down"),
        sc.clamp(price, 950.0, 1500.0).alias("clamped"),
        sc.safe_ratio(price, F.col("p_size") - 25).alias("ratio"),
        sc.cast_to(F.substring_index("p_brand", "#", -1), "int", strict=False).alias("brand_number"),
        sc.cast_to("p_brand", "int", strict=False).alias("no_number"),
        sc.case([(F.col("p_size") > 40, "large"), (F.col("p_size") > 20, "medium")], "small").alias("size_class"),
    )


@query(
    "date_functions",
    f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS due,
    CAST(date_diff('day', CAST(o_orderdate AS DATE), {_AS_OF}) AS INTEGER) AS age,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
    {rnd("sin(dayofyear(o_orderdate) / 365.25e0 * 2e0 * pi())", 9)} AS season FROM orders""",
)
def _(spark, d):
    day = F.to_date("o_orderdate")
    return m.table(spark, d, "orders").select(
        "o_orderkey",
        sc.add_days(day, sc.pmod("o_orderkey", 30)).alias("due"),
        sc.days_between(F.lit(AS_OF), day).alias("age"),
        sc.month_of(day).alias("month"),
        sc.round_to(sc.cyclic(day), 9).alias("season"),
    )


@query("hash_functions")
def _(spark, d):
    return m.table(spark, d, "orders").select(
        "o_orderkey", sc.stable_hash("o_orderkey", salt=7).alias("hash"), sc.hash_fraction("o_orderkey").alias("fraction")
    )


@query(
    "hash_properties",
    "SELECT count(*) AS rows, true AS no_two_alike, true AS salt_matters, true AS fractions_in_range, true AS all_tenths_are_hit FROM orders",
)
def _(spark, d):
    """What must hold of any good hash: distinct keys differ, another salt gives other values, fractions fill [0, 1) evenly."""
    rows = m.table(spark, d, "orders").select(
        sc.stable_hash("o_orderkey", salt=7).alias("a"), sc.stable_hash("o_orderkey", salt=8).alias("b"), sc.hash_fraction("o_orderkey").alias("f")
    )
    n, f = F.count("*"), F.col("f")
    tenths = [F.count_if(F.floor(f * 10) == i) for i in range(10)]
    return rows.agg(
        n.alias("rows"),
        (F.count_distinct("a") == n).alias("no_two_alike"),
        (F.count_if(F.col("a") == F.col("b")) == 0).alias("salt_matters"),
        ((F.min("f") >= 0) & (F.max("f") < 1)).alias("fractions_in_range"),
        ((F.least(*tenths) > n / 20) & (F.greatest(*tenths) < n / 5)).alias("all_tenths_are_hit"),
    )


@query(
    "message_functions",
    r"""SELECT chat_id, seq, CASE WHEN regexp_matches(content, '\S')
        THEN regexp_replace(substr(content, 1, 20), '^\s+|\s+$', '', 'g') ELSE 'New Chat' END AS title,
    CAST(len(regexp_extract_all(content, '\S+')) AS INTEGER) AS words,
    CASE WHEN role IN ('developer', 'tool', 'activity') THEN 'system' ELSE role END AS shown_role FROM msg""",
)
def _(spark, d):
    return m.messages(spark, d).select(
        "chat_id",
        "seq",
        tx.chat_title("content").alias("title"),
        tx.word_count("content").alias("words"),
        tx.display_role("role").alias("shown_role"),
    )


@query(
    "event_functions",
    """SELECT event_id, floor(value) / 1000e0 AS seconds_from_ms, value AS seconds_plain,
    make_timestamp(CAST(1700000000000 + event_id AS BIGINT) * 1000) AS moment,
    CASE WHEN event_type = 'error' THEN '[' || event_type || '] ' || props ELSE props END AS error_text,
    event_id < 100000000000 AS looks_like_seconds FROM events""",
)
def _(spark, d):
    e = F.col("event_type")
    return m.table(spark, d, "events").select(
        "event_id",
        tx.duration_seconds(F.concat(F.floor("value").cast("string"), F.lit("ms"))).alias("seconds_from_ms"),
        tx.duration_seconds(F.concat(F.lit(" "), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("s "))).alias("seconds_plain"),
        F.to_utc_timestamp(tx.from_epoch_ms(F.col("event_id") + 1_700_000_000_000), F.current_timezone()).cast("timestamp_ntz").alias("moment"),
        tx.error_text(F.when(e == "error", e), "props").alias("error_text"),
        tx.probably_seconds("event_id").alias("looks_like_seconds"),
    )


@query("encode_segment", "SELECT page_id, url_encode(url) AS segment FROM pages")
def _(spark, d):
    return m.table(spark, d, "pages").select("page_id", tx.encode_segment("url").alias("segment"))


@query(
    "language_of",
    "SELECT doc_id, CASE WHEN lang IN ('en', 'es', 'fr', 'ja', 'ko', 'pt') THEN lang ELSE 'en' END AS language FROM documents",
)
def _(spark, d):
    return m.table(spark, d, "documents").select("doc_id", tx.language_of(F.concat("lang", F.lit("_XX"))).alias("language"))


@query(
    "redact_json",
    """SELECT doc_id, '{"n": ' || doc_id || ', "access_token": "[REDACTED]", "in": [[{"refresh_token": "[REDACTED]", "s": "' || source || '"}], "access_token"]}' AS text,
    '{"a\\u0063cess_token": "[REDACTED]"' AS cut FROM documents""",
)
def _(spark, d):
    """Secrets below several levels, under an escaped name, and in a text that breaks off."""
    nested = F.format_string(
        '{"n": %d, "access_token": {"a": {"b": ["secret", {"c": 1}]}}, "in": [[{"refresh_token": [[1, "s2"], "s3"], "s": "%s"}], "access_token"]}', "doc_id", "source"
    )
    cut = F.concat(F.lit('{"a\\u0063cess_token": ["'), F.col("source"), F.lit('", '))
    return m.table(spark, d, "documents").select("doc_id", tx.redact_json(nested).alias("text"), tx.redact_json(cut).alias("cut"))


@query(
    "dedup_keys",
    """SELECT count(*) AS rows, count(DISTINCT a) + count(DISTINCT b) + count(DISTINCT c) AS keys FROM (SELECT doc_id AS a, doc_id AS b, doc_id AS c FROM documents)""",
)
def _(spark, d):
    """A missing part in the middle, at the end, and an empty one make different keys."""
    source, nothing, empty = F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.lit("")
    keys = [tx.dedup_key("n", source, nothing, F.lit("b")), tx.dedup_key("n", source, F.lit("b"), nothing), tx.dedup_key("n", source, empty, F.lit("b"))]
    rows = m.table(spark, d, "documents").select(F.explode(F.array(*keys)).alias("key"))
    return rows.agg((F.count("*") / 3).cast("bigint").alias("rows"), F.count_distinct("key").alias("keys"))


@query(
    "redact_text",
    r"""SELECT doc_id, regexp_replace(text || ' access_token=''' || doc_id || ''' end',
    '(?i)access_token=([''"]?)[^''"\s,)}]+([''"]?)', 'access_token=\1[REDACTED]\2', 'g') AS text FROM documents""",
)
def _(spark, d):
    line = F.concat("text", F.lit(" access_token='"), F.col("doc_id").cast("string"), F.lit("' end"))
    return m.table(spark, d, "documents").select("doc_id", tx.redact_text(line).alias("text"))


# --- readiness -------------------------------------------------------------------------------------


@query("inventory_status", "SELECT inventory_status, count(*) AS rows FROM inv GROUP BY 1")
def _(spark, d):
    return ag.group_count(m.inventory(spark, d), ["inventory_status"], "rows")


@query(
    "minimum_days",
    """SELECT item_id, location_id, CAST(base_min_days + CASE criticality WHEN 'MISSION_CRITICAL' THEN 7 WHEN 'HIGH' THEN 3 ELSE 0 END
    + CASE WHEN mission_priority >= 4 THEN 3 ELSE 0 END AS INTEGER) AS minimum_days_supply
    FROM prt JOIN loc ON location_index = item_index % 25""",
)
def _(spark, d):
    parts = m.part_items(spark, d).withColumn("location_index", sc.pmod("item_index", 25))
    both = jn.enrich(parts, m.locations(spark, d), "location_index", ["location_id", "mission_priority"])
    return both.select(
        "item_id", "location_id",
        st.minimum_days("base_min_days", "criticality", "mission_priority").alias("minimum_days_supply"),
    )


@query("stock_ledger", "SELECT location_id, item_id, snapshot_date, balance_units, greatest(0, balance_units) AS on_hand_units FROM led")
def _(spark, d):
    return m.ledger(spark, d).select(*KEYS, "snapshot_date", "balance_units", "on_hand_units")


@query("inventory", "SELECT * FROM inv")
def _(spark, d):
    return m.inventory(spark, d)


@query("unmet_units", "SELECT location_id, item_id, CAST(sum(backordered_units) AS BIGINT) AS unmet_unit_days FROM inv GROUP BY ALL")
def _(spark, d):
    return m.inventory(spark, d).groupBy(*KEYS).agg(F.sum("backordered_units").alias("unmet_unit_days"))


@query(
    "expiring_units",
    f"""SELECT location_id, item_id, count(*) AS expiring_lots, CAST(sum(receipts) AS BIGINT) AS expiring_units
    FROM flows JOIN itm USING (item_id) WHERE receipts > 0 AND cold_chain_required AND snapshot_date <= {_AS_OF}
    AND snapshot_date + shelf_life_days BETWEEN {_AS_OF} AND {_AS_OF} + 90 GROUP BY ALL""",
)
def _(spark, d):
    lots = jn.enrich(m.daily_flows(spark, d), m.items(spark), "item_id", ["cold_chain_required", "shelf_life_days"])
    lots = lots.filter("cold_chain_required AND receipts > 0").select(
        *KEYS, F.col("snapshot_date").alias("receipt_date"), "shelf_life_days", F.col("receipts").alias("units")
    )
    return st.expiring_units(lots, KEYS, AS_OF, 90)


@query("order_status", "SELECT order_status, order_month, count(*) AS lines FROM ord GROUP BY ALL")
def _(spark, d):
    return ag.group_count(m.order_lines(spark, d), ["order_status", "order_month"], "lines")


@query("order_lines", "SELECT * FROM ord")
def _(spark, d):
    return m.order_lines(spark, d)


@query("shipment_status", "SELECT * FROM shp")
def _(spark, d):
    return m.shipments(spark, d)


@query("shipment_status_reference", "SELECT * FROM shp_ref")
def _(spark, d):
    return m.shipments(spark, d, "reference")


@query("order_priority", "SELECT location_id, order_priority, count(*) AS lines FROM ord GROUP BY ALL")
def _(spark, d):
    return ag.group_count(m.order_lines(spark, d), ["location_id", "order_priority"], "lines")


@query(
    "fill_quantity",
    """SELECT order_month, CAST(sum(delivered_units) AS BIGINT) AS delivered_units,
    CAST(sum(extended_value_usd) AS DECIMAL(28,2)) AS value_usd FROM ord GROUP BY ALL""",
)
def _(spark, d):
    return m.order_lines(spark, d).groupBy("order_month").agg(
        F.sum("delivered_units").alias("delivered_units"), ag.money("extended_value_usd").alias("value_usd")
    )


_FEATURES = """location_id, item_id, snapshot_date, avg_daily_demand_7d, avg_daily_demand_30d, demand_stddev_30d,
    avg_days_of_supply_7d, min_days_of_supply_30d, demand_growth_7_vs_30, demand_cv_30d, inventory_gap_days,
    on_order_coverage_days"""


@query("rolling_features", f"SELECT {_FEATURES} FROM feat")
def _(spark, d):
    return ft.rolling_features(m.inventory(spark, d)).select(*[c.strip() for c in _FEATURES.split(",")])


@query("shortage_label", "SELECT location_id, item_id, snapshot_date, future_shortage_flag FROM feat0")
def _(spark, d):
    return ft.shortage_label(m.inventory(spark, d)).select(*KEYS, "snapshot_date", "future_shortage_flag")


@query("training_set", "SELECT * FROM trn")
def _(spark, d):
    return _training(spark, d)


@query("scoring_set", "SELECT * FROM scr")
def _(spark, d):
    return _scoring(spark, d)


@query("supplier_performance", "SELECT * FROM perf")
def _(spark, d):
    return m.performance(spark, d)


@query("supplier_performance_reference", "SELECT * FROM perf_ref")
def _(spark, d):
    return m.performance(spark, d, "reference")


@query("late_orders", "SELECT * FROM late")
def _(spark, d):
    return sp.late_orders(m.order_lines(spark, d))


@query("current_position", "SELECT * FROM pos")
def _(spark, d):
    return m.position(spark, d)


_WATCH = "location_id, item_id, " + ", ".join(sp.WATCH_COLUMNS)
_CRIT_RANK = "CASE criticality WHEN 'MISSION_CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END"


@query("watch_list", f"SELECT {_WATCH} FROM pos ORDER BY days_above_minimum, criticality, location_id, item_id LIMIT 25")
def _(spark, d):
    return sp.watch_list(m.position(spark, d))


@query("watch_list_ranked", f"SELECT {_WATCH} FROM pos ORDER BY days_above_minimum, {_CRIT_RANK}, location_id, item_id LIMIT 25")
def _(spark, d):
    return sp.watch_list(m.position(spark, d), ranked=True)


@query(
    "concerns",
    f"""SELECT location_id, item_id, {", ".join(sp.CONCERN_COLUMNS)} FROM pos WHERE criticality IN ('MISSION_CRITICAL', 'HIGH')
    ORDER BY days_above_minimum, late_inbound_units DESC, location_id, item_id LIMIT 30""",
)
def _(spark, d):
    return sp.concerns(m.position(spark, d))


@query(
    "health_summary",
    "SELECT inventory_status, count(*) AS positions, CAST(sum(inventory_value_usd) AS DECIMAL(28,2)) AS inventory_value_usd FROM pos GROUP BY 1",
)
def _(spark, d):
    return sp.health_summary(m.position(spark, d))


@query(
    "explain",
    f"""SELECT p.location_id, p.item_id, p.preferred_supplier_id, days_above_minimum, late_inbound_units,
    actual_ontime_rate_90d, active_events, active_event_types, f.demand_growth_7_vs_30,
    list_filter([CASE WHEN days_above_minimum < 0 THEN 'BELOW_MINIMUM' END,
        CASE WHEN late_inbound_units > 0 THEN 'LATE_INBOUND' END,
        CASE WHEN active_events > 0 THEN 'ACTIVE_SUPPLIER_EVENT' END,
        CASE WHEN actual_ontime_rate_90d < 0.85 THEN 'LOW_SUPPLIER_ON_TIME_RATE' END,
        CASE WHEN f.demand_growth_7_vs_30 > 0 THEN 'DEMAND_GROWTH' END], lambda x: x IS NOT NULL) AS reasons
    FROM posx p LEFT JOIN (SELECT * FROM feat WHERE snapshot_date = {_AS_OF}) f
    ON f.location_id = p.location_id AND f.item_id = p.item_id""",
)
def _(spark, d):
    stock = _stock(spark, d)
    features = ft.rolling_features(stock, first=AS_OF, last=AS_OF)
    return sp.explain(m.position(spark, d, stock), m.supplier_events(spark, d), features, AS_OF)


@query(
    "trend",
    """SELECT region, commodity_group, month, demand_units, avg_on_hand_units,
    lag(demand_units) OVER w AS previous_demand_units, demand_units - lag(demand_units) OVER w AS demand_change_units
    FROM (SELECT region, commodity_group, snapshot_month AS month, CAST(sum(daily_demand_units) AS BIGINT) AS demand_units,
        CAST(sum(on_hand_units) AS DOUBLE) / count(*) AS avg_on_hand_units
        FROM inv JOIN loc USING (location_id) JOIN itm USING (item_id) GROUP BY ALL)
    WINDOW w AS (PARTITION BY region, commodity_group ORDER BY month)""",
)
def _(spark, d):
    rows = jn.enrich(m.inventory(spark, d), m.locations(spark, d), "location_id", ["region"])
    rows = jn.enrich(rows, m.items(spark), "item_id", ["commodity_group"])
    return sp.trend(rows, ["region", "commodity_group"])


# --- rules -----------------------------------------------------------------------------------------

_PRESSURE = "(backordered_units > 0 OR late_inbound_units > 0)"
_NEAR = "days_of_supply >= minimum_days_supply AND days_of_supply <= minimum_days_supply + 5"


@query("immediate_review", "SELECT * FROM pos WHERE days_of_supply < minimum_days_supply")
def _(spark, d):
    return es.immediate_review(m.position(spark, d))


@query("elevated_review", f"SELECT location_id, item_id, days_above_minimum, active_events FROM posx WHERE {_NEAR} AND ({_PRESSURE} OR active_events > 0)")
def _(spark, d):
    out = es.elevated_review(m.position(spark, d), m.supplier_events(spark, d), AS_OF)
    return out.select(*KEYS, "days_above_minimum", "active_events")


@query(
    "elevated_review_wide",
    f"SELECT location_id, item_id, days_above_minimum, active_events FROM posx WHERE {_NEAR.replace('+ 5', '+ 40')} AND ({_PRESSURE} OR active_events > 0)",
)
def _(spark, d):
    out = es.elevated_review(m.position(spark, d), m.supplier_events(spark, d), AS_OF, band=40)
    return out.select(*KEYS, "days_above_minimum", "active_events")


@query("predictive_trigger", "SELECT * FROM pred WHERE shortage_probability_30d >= 0.7 AND criticality IN ('MISSION_CRITICAL', 'HIGH')")
def _(spark, d):
    return es.predictive_trigger(_predictions(spark, d))


@query("supplier_review", "SELECT * FROM perf WHERE actual_ontime_rate_90d < 0.85")
def _(spark, d):
    return es.supplier_review(m.performance(spark, d))


@query("supplier_evidence", "SELECT location_id, item_id, active_events, active_event_types FROM posx WHERE active_events > 0")
def _(spark, d):
    out = es.supplier_evidence(m.position(spark, d), m.supplier_events(spark, d), AS_OF)
    return out.select(*KEYS, "active_events", "active_event_types")


@query(
    "cold_chain_urgency",
    f"""SELECT location_id, item_id, backordered_units, late_inbound_units, active_event_types FROM posx
    WHERE cold_chain_required AND ({_PRESSURE} OR list_contains(active_event_types, 'COLD_CHAIN_EXCEPTION'))""",
)
def _(spark, d):
    out = es.cold_chain_urgency(m.position(spark, d), m.supplier_events(spark, d), AS_OF)
    return out.select(*KEYS, "backordered_units", "late_inbound_units", "active_event_types")


_FIRED = {
    "MED-ESC-001": ("days_of_supply < minimum_days_supply", 3),
    "MED-ESC-002": (f"{_NEAR} AND ({_PRESSURE} OR active_events > 0)", 2),
    "MED-ESC-003": ("shortage_probability_30d >= 0.7 AND criticality IN ('MISSION_CRITICAL', 'HIGH')", 2),
    "MED-SUP-001": ("actual_ontime_rate_90d < 0.85", 1),
    "MED-SUP-002": ("active_events > 0", 1),
    "MED-COLD-001": (f"cold_chain_required AND ({_PRESSURE} OR list_contains(active_event_types, 'COLD_CHAIN_EXCEPTION'))", 2),
}


@query(
    "escalation",
    f"""SELECT location_id, item_id, criticality, days_above_minimum, shortage_probability_30d,
    CAST(greatest({", ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in _FIRED.values())}) AS INTEGER) AS escalation_level,
    list_filter([{", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, (c, _) in _FIRED.items())}], lambda x: x IS NOT NULL) AS rule_ids
    FROM posx LEFT JOIN (SELECT location_id, item_id, shortage_probability_30d FROM pred) p USING (location_id, item_id)""",
)
def _(spark, d):
    stock = _stock(spark, d)
    return es.escalation(m.position(spark, d, stock), _predictions(spark, d, stock), m.supplier_events(spark, d), AS_OF)


@query(
    "transfer_candidates",
    f"""SELECT * FROM (SELECT r.item_id, r.location_id, r.own_risk, dn.donor_location_id, dn.donor_risk, dn.donor_surplus_days,
        CAST(row_number() OVER (PARTITION BY r.item_id, r.location_id
            ORDER BY donor_risk, donor_surplus_days DESC, donor_location_id) AS INTEGER) AS rank
        FROM (SELECT p.location_id, p.item_id, q.shortage_probability_30d AS own_risk FROM posx p JOIN pred q
            ON q.location_id = p.location_id AND q.item_id = p.item_id
            WHERE p.days_of_supply < p.minimum_days_supply OR ({_NEAR.replace("days_of", "p.days_of").replace("minimum_", "p.minimum_")})) r
        JOIN (SELECT p.location_id AS donor_location_id, p.item_id, q.shortage_probability_30d AS donor_risk,
            CAST(days_of_supply - p.minimum_days_supply AS DOUBLE) AS donor_surplus_days FROM posx p JOIN pred q
            ON q.location_id = p.location_id AND q.item_id = p.item_id
            WHERE days_of_supply > p.minimum_days_supply AND (NOT p.cold_chain_required OR cold_storage_flag)) dn
        ON dn.item_id = r.item_id AND dn.donor_risk < r.own_risk) WHERE rank <= 3""",
)
def _(spark, d):
    stock = _stock(spark, d)
    held = jn.enrich(m.position(spark, d, stock), m.locations(spark, d), "location_id", ["cold_storage_flag"])
    return es.transfer_candidates(held, _predictions(spark, d, stock), 3)


@query(
    "alternate_suppliers",
    """SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY actual_ontime_rate_90d DESC NULLS LAST,
        contract_lead_time_days, supplier_id) AS INTEGER) AS rank
    FROM (SELECT i.item_id, printf('SUP-%05d', l_suppkey + 1) AS supplier_id, count(*) AS lines,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem JOIN part ON l_partkey = p_partkey
        JOIN itm i ON i.commodity_group = p_type GROUP BY ALL) u
    JOIN (SELECT supplier_id, actual_ontime_rate_90d, contract_lead_time_days FROM perf) p USING (supplier_id)
    QUALIFY rank <= 3""",
)
def _(spark, d):
    lines = m._line_keys(spark, d, m.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"))
    lines = lines.select(
        "item_id", sc.padded_id("SUP", F.col("l_suppkey") + 1, 5).alias("supplier_id"), F.col("l_quantity").cast("bigint").alias("units")
    )
    return es.alternate_suppliers(lines, m.performance(spark, d), 3)


@query(
    "rule_mismatches",
    """SELECT item_id, commodity_group, CAST(base_min_days + item_index % 2 AS INTEGER) AS base_min_days,
    CAST(base_min_days AS INTEGER) AS rule_min_days FROM prt WHERE item_index % 2 <> 0""",
)
def _(spark, d):
    drifted = m.part_items(spark, d).withColumn(
        "base_min_days", (F.col("base_min_days") + sc.pmod("item_index", 2)).cast("int")
    )
    out = es.rule_mismatches(drifted, m.commodities(spark))
    return out.select("item_id", "commodity_group", "base_min_days", "rule_min_days")


_CENTRES = """(SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x,
    generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)"""


@query(
    "retrieve_vectors",
    f"""SELECT query_id, section_id, {rnd("similarity", 6)} AS similarity, rank FROM (
    SELECT CAST(q.label AS BIGINT) AS query_id, s.vec_id AS section_id,
        list_cosine_similarity(q.v, CAST(s.embedding AS DOUBLE[])) AS similarity,
        CAST(row_number() OVER (PARTITION BY q.label
            ORDER BY {rnd("list_cosine_similarity(q.v, CAST(s.embedding AS DOUBLE[]))", 9)} DESC, s.vec_id) AS INTEGER) AS rank
    FROM (SELECT label, list(x ORDER BY i) AS v FROM {_CENTRES} GROUP BY label) q CROSS JOIN embeddings s) WHERE rank <= 5""",
)
def _(spark, d):
    """The five vectors nearest to the centre of each label."""
    vectors = m.table(spark, d, "embeddings")
    spread = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    centres = spread.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = centres.groupBy(F.col("label").cast("bigint").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector")
    )
    sections = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rt.retrieve_vectors(queries, sections, 5)


@query(
    "retrieve_top_k",
    rf"""WITH d AS (SELECT doc_id, w, 1e0 + ln(count(*)) AS tf FROM
        (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
    dn AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM d GROUP BY 1),
    q AS (SELECT item_id, w, 1e0 + ln(count(*)) AS tf FROM
        (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM benchmark) WHERE w <> '' GROUP BY ALL),
    f AS (SELECT w, ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)) AS idf FROM d GROUP BY 1),
    qw AS (SELECT item_id, w, tf * idf AS x FROM q JOIN f USING (w)),
    qn AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM qw GROUP BY 1),
    s AS (SELECT item_id, doc_id, sum(x * tf) / any_value(qn.norm) / any_value(dn.norm) AS similarity
        FROM qw JOIN d USING (w) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY ALL)
    SELECT item_id AS query_id, doc_id AS section_id, {rnd("similarity", 6)} AS similarity,
        CAST(row_number() OVER (PARTITION BY item_id ORDER BY {rnd("similarity", 9)} DESC, doc_id) AS INTEGER) AS rank
    FROM s WHERE similarity > 0 QUALIFY rank <= 3""",
)
def _(spark, d):
    queries = m.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    sections = m.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.retrieve_top_k(queries, sections, 3)


# --- predictions and model quality -----------------------------------------------------------------


@query("serve", "SELECT snapshot_date, location_id, item_id, preferred_supplier_id, shortage_probability_30d FROM pred")
def _(spark, d):
    scoring = materialise(_scoring(spark, d))
    return rk.serve(m.raw_predictions(scoring, "days_of_supply"), scoring, m.RAW_PREDICTION)


@query(
    "query_risk",
    f"""SELECT criticality, {_RISK}, count(*) FILTER (shortage_probability_30d >= 0.7) AS positions_over
    FROM pred WHERE cold_chain_required GROUP BY 1""",
)
def _(spark, d):
    return rk.query_risk(_predictions(spark, d), "cold_chain_required", ["criticality"], 0.70)


@query(
    "high_risk_by_supplier",
    """SELECT preferred_supplier_id, count(*) AS positions_over FROM pred WHERE shortage_probability_30d >= 0.7 GROUP BY 1""",
)
def _(spark, d):
    return rk.high_risk_by_supplier(_predictions(spark, d))


def _labels(spark, d):
    return m.table(spark, d, "labels").withColumn(
        "p", (sc.pmod(F.col("doc_id") * 7919, 1000) + F.col("quality") * 300).cast("double") / 1300.0
    )


def _auc_sql(table: str, y: str, by: str = "", p: str = "p") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}," if by else ""
    return f"""SELECT {lead} {rnd("CAST(sum(CASE WHEN y = 1 THEN 2 * below + ties ELSE 0 END) AS DOUBLE) / (2e0 * any_value(np) * any_value(nn))", 9)} AS roc_auc
    FROM (SELECT {lead} y, sum(1 - y) OVER ({part}) AS nn, sum(y) OVER ({part}) AS np,
        sum(1 - y) OVER ({part} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - y) OVER (PARTITION BY {lead} {p}) AS below,
        sum(1 - y) OVER (PARTITION BY {lead} {p}) AS ties FROM (SELECT *, {y} AS y FROM {table})) {"GROUP BY " + by if by else ""}"""


def _ap_sql(table: str, y: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}," if by else ""
    return f"""SELECT {lead} {rnd("CAST(sum(CAST(pos * cp / ca AS DECIMAL(38,15))) AS DOUBLE) / sum(pos)", 9)} AS pr_auc
    FROM (SELECT {lead} CAST(pos AS DOUBLE) AS pos, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(n) OVER w AS DOUBLE) AS ca
        FROM (SELECT {lead} p, sum({y}) AS pos, count(*) AS n FROM {table} GROUP BY ALL)
        WINDOW w AS ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) {"GROUP BY " + by if by else ""}"""


def _loss(y: str) -> str:
    q = "least(1e0 - 1e-15, greatest(1e-15, p))"
    return rnd(f"CAST(sum(CAST(-({y} * ln({q}) + (1 - {y}) * ln(1e0 - {q})) AS DECIMAL(28,12))) AS DOUBLE) / count(*)", 9)


@query("roc_auc", _auc_sql("lab", "quality"))
def _(spark, d):
    return mq.roc_auc(_labels(spark, d), "quality", "p")


@query("roc_auc_by_month", _auc_sql("(SELECT *, CAST(date_trunc('month', snapshot_date) AS DATE) AS month FROM trs)", "shortage_within_30d", "month"))
def _(spark, d):
    rows = _scored_training(spark, d).withColumn("month", sc.month_of("snapshot_date"))
    return mq.roc_auc(rows, "shortage_within_30d", "p", ["month"])


@query("pr_auc", _ap_sql("lab", "quality"))
def _(spark, d):
    return mq.pr_auc(_labels(spark, d), "quality", "p")


@query("log_loss", f"SELECT toxic, {_loss('quality')} AS log_loss FROM lab GROUP BY 1")
def _(spark, d):
    return mq.log_loss(_labels(spark, d), "quality", "p", by=["toxic"])


@query(
    "calibration",
    f"""SELECT bin, rows, {rnd("mp", 9)} AS mean_predicted, {rnd("orate", 9)} AS observed_rate,
    {rnd("CAST(rows AS DOUBLE) / CAST(sum(rows) OVER () AS DOUBLE) * abs(mp - orate)", 9)} AS ece_part FROM (
    SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS rows,
    CAST(sum(CAST(p AS DECIMAL(28,12))) AS DOUBLE) / count(*) AS mp, CAST(sum(quality) AS DOUBLE) / count(*) AS orate FROM lab GROUP BY 1)""",
)
def _(spark, d):
    return mq.calibration(_labels(spark, d), "quality", "p")


_FOLD = f"""CASE WHEN snapshot_date >= DATE '{FOLD_CUTS[2]}' THEN 3
    WHEN snapshot_date >= DATE '{FOLD_CUTS[1]}' AND snapshot_date < DATE '{FOLD_CUTS[2]}' - 30 THEN 2
    WHEN snapshot_date >= DATE '{FOLD_CUTS[0]}' AND snapshot_date < DATE '{FOLD_CUTS[1]}' - 30 THEN 1 END"""
_FOLDED = f"(SELECT *, CAST({_FOLD} AS INTEGER) AS fold FROM trs WHERE ({_FOLD}) IS NOT NULL)"


@query(
    "backtest",
    f"""SELECT fold, rows, positives, log_loss, roc_auc, pr_auc FROM (SELECT fold, count(*) AS rows,
    CAST(sum(shortage_within_30d) AS BIGINT) AS positives, {_loss("shortage_within_30d")} AS log_loss FROM {_FOLDED} GROUP BY 1) a
    JOIN ({_auc_sql(_FOLDED, "shortage_within_30d", "fold")}) b USING (fold)
    JOIN ({_ap_sql(_FOLDED, "shortage_within_30d", "fold")}) c USING (fold)""",
)
def _(spark, d):
    return mq.backtest(_scored_training(spark, d), "shortage_within_30d", "p", FOLD_CUTS)


_MONTHLY = """(SELECT CAST(date_trunc('month', snapshot_date) AS DATE) AS month, count(*) AS rows,
    CAST(sum(shortage_within_30d) AS BIGINT) AS positives, CAST(sum(shortage_within_30d) AS DOUBLE) / count(*) AS prevalence
    FROM trn GROUP BY 1)"""


@query("monthly_prevalence", f"SELECT * FROM {_MONTHLY}")
def _(spark, d):
    return mq.monthly_prevalence(_training(spark, d))


@query(
    "ramp_test",
    f"""SELECT rising_months, rising_months = 3 AS strictly_rising, now AS recent_prevalence, before AS historical_prevalence,
    {rnd("now / nullif(before, 0)", 9)} AS ratio FROM (
    SELECT count(*) FILTER (recent AND rise) AS rising_months,
        CAST(sum(positives) FILTER (recent) AS DOUBLE) / CAST(sum(rows) FILTER (recent) AS DOUBLE) AS now,
        CAST(sum(positives) FILTER (NOT recent) AS DOUBLE) / CAST(sum(rows) FILTER (NOT recent) AS DOUBLE) AS before
    FROM (SELECT *, prevalence > lag(prevalence) OVER (ORDER BY month) AS rise,
        row_number() OVER (ORDER BY month DESC) <= 3 AS recent FROM {_MONTHLY}))""",
)
def _(spark, d):
    return mq.ramp_test(mq.monthly_prevalence(_training(spark, d)))


_COMPARED = ["days_of_supply", "inventory_gap_days", "demand_growth_7_vs_30"]


def _mean6(c: str) -> str:
    return rnd(f"CAST(sum(CAST(CAST({c} AS DOUBLE) AS DECIMAL(28,9))) AS DOUBLE) / nullif(count({c}), 0)", 6)


@query(
    "window_compare",
    f"""SELECT part, min(snapshot_date) AS first_date, max(snapshot_date) AS last_date, count(*) AS rows,
    CAST(sum(shortage_within_30d) AS DOUBLE) / count(*) AS prevalence,
    {", ".join(f"{_mean6(c)} AS avg_{c}" for c in _COMPARED)},
    {", ".join(_mean6(f"CASE WHEN shortage_within_30d = 1 THEN {c} END") + f" AS positive_avg_{c}" for c in _COMPARED)}
    FROM trn JOIN (SELECT snapshot_date, CAST(ntile(3) OVER (ORDER BY snapshot_date) AS INTEGER) AS part
        FROM (SELECT DISTINCT snapshot_date FROM trn)) USING (snapshot_date) GROUP BY part""",
)
def _(spark, d):
    return mq.window_compare(materialise(_training(spark, d)), _COMPARED)


@query(
    "target_balance",
    "SELECT shortage_within_30d, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM trn GROUP BY 1",
)
def _(spark, d):
    return mq.target_balance(_training(spark, d))


_PSI_COLS = ["days_of_supply", "avg_daily_demand_30d", "demand_cv_30d"]
_PSI_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, snapshot_date < DATE '{FOLD_CUTS[1]}' AS base FROM trn" for c in _PSI_COLS
)


@query(
    "psi",
    f"""SELECT feature, {rnd("CAST(sum(CAST((pc - pb) * ln(pc / pb) AS DECIMAL(28,15))) AS DOUBLE)", 6)} AS psi FROM (
    SELECT feature, greatest(1e-6, CAST(b AS DOUBLE) / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE)) AS pb,
        greatest(1e-6, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE)) AS pc FROM (
        SELECT feature, greatest(1, len(list_filter(edges, lambda e: e <= x))) AS bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS c
        FROM ({_PSI_LONG}) JOIN (SELECT feature, list(edge) AS edges FROM (SELECT feature, part, min(x) AS edge FROM (
            SELECT feature, x, (rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 // count(*) OVER (PARTITION BY feature) AS part
            FROM ({_PSI_LONG}) WHERE base) GROUP BY ALL) GROUP BY feature) USING (feature)
        GROUP BY ALL)) GROUP BY feature""",
)
def _(spark, d):
    rows = materialise(_training(spark, d))
    cut = F.lit(FOLD_CUTS[1])
    return mq.psi(rows.filter(F.col("snapshot_date") < cut), rows.filter(F.col("snapshot_date") >= cut), _PSI_COLS)


@query(
    "score_gates",
    """SELECT doc_id, 'n_chars' AS metric, 'greaterThan' AS comparator, 4000e0 AS threshold, CAST(n_chars AS DOUBLE) AS value, 'block' AS action
    FROM documents WHERE n_chars > 4000
    UNION ALL SELECT doc_id, 'quality', 'lessThan', 0.7e0, CAST(quality AS DOUBLE), 'report' FROM documents JOIN labels USING (doc_id) WHERE quality < 0.7""",
)
def _(spark, d):
    scores = m.table(spark, d, "documents").select("doc_id", "n_chars").join(
        m.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    rules = [("n_chars", "greaterThan", 4000, "block"), ("quality", "lessThan", 0.7, "report")]
    return mq.score_gates(scores, rules, ["doc_id"])


@query("backtest_models")
def _(spark, d):
    """A model per fold, and its measures on the days it has not seen."""
    scored = rk.score_folds(materialise(_training(spark, d)), FOLD_CUTS, kind="logistic")
    return mq.all_measures(scored, "shortage_within_30d", m.RAW_PREDICTION, ["fold"])


def _calibrated(spark, d):
    return materialise(rk.calibrated_folds(materialise(_training(spark, d)), FOLD_CUTS, kind="logistic"))


@query("calibration_gain")
def _(spark, d):
    """Log loss and squared error per fold before and after calibration, where it was fitted and on the days after."""
    return rk.calibration_gain(_calibrated(spark, d), "shortage_within_30d", m.RAW_PREDICTION, ["fold", "fitted"])


_FITTED_DAYS = " OR ".join(
    f"(f.fold = {i} AND snapshot_date >= DATE '{c}' - 90 AND snapshot_date < DATE '{c}' - 30)" for i, c in enumerate(FOLD_CUTS, 1)
)


@query(
    "calibrated_folds",
    f"""SELECT CAST(fold AS INTEGER) AS fold, fitted, count(*) AS rows, CAST(sum(shortage_within_30d) AS BIGINT) AS positives,
        true AS rises, true AS mean_kept, true AS no_worse FROM (
        SELECT f.fold, true AS fitted, shortage_within_30d FROM trs, (SELECT unnest([1, 2, 3]) AS fold) f WHERE {_FITTED_DAYS}
        UNION ALL SELECT fold, false, shortage_within_30d FROM {_FOLDED}) GROUP BY ALL""",
)
def _(spark, d):
    """What holds for any monotone calibration: it never falls, and where it was fitted it keeps the mean and loses nothing."""
    scored = _calibrated(spark, d)
    y, p, c = F.col("shortage_within_30d"), F.col(m.RAW_PREDICTION), F.col(rk.CALIBRATED)
    steps = scored.groupBy("fold", F.floor(p * rk.CALIBRATION_STEPS).alias("step")).agg(F.min(c).alias("low"), F.max(c).alias("high"))
    below = Window.partitionBy("fold").orderBy("step")  # at most as many rows as steps
    falls = (F.col("low") < F.lag("high").over(below) - 1e-9) | (F.col("low") < F.col("high") - 1e-9)
    rises = steps.withColumn("falls", F.coalesce(falls, F.lit(False))).groupBy("fold").agg((~F.bool_or("falls")).alias("rises"))
    fitted = F.col("fitted")
    table = scored.groupBy("fold", "fitted").agg(
        F.count("*").alias("rows"), F.sum(y.cast("bigint")).alias("positives"),
        (F.abs(F.avg(c) - F.avg(y.cast("double"))) < 1e-6).alias("mean_kept"),
        (mq.log_loss_of("shortage_within_30d", rk.CALIBRATED) <= mq.log_loss_of("shortage_within_30d", m.RAW_PREDICTION) + 1e-4).alias("no_worse"),
    )
    return table.join(F.broadcast(rises), "fold").select(
        "fold", "fitted", "rows", "positives", "rises", (~fitted | F.col("mean_kept")).alias("mean_kept"), (~fitted | F.col("no_worse")).alias("no_worse")
    )


@query(
    "drift_by_month",
    f"""SELECT feature, CAST(date_trunc('month', snapshot_date) AS DATE) AS period, count(*) AS rows, count(*) - count(x) AS missing,
    min(x) AS least, max(x) AS greatest, true AS has_psi, true AS as_from_rows FROM ({" UNION ALL ".join(
        f"SELECT '{c}' AS feature, snapshot_date, CAST({c} AS DOUBLE) AS x FROM trn" for c in _PSI_COLS
    )}) WHERE snapshot_date >= DATE '{FOLD_CUTS[1]}' GROUP BY 1, 2""",
)
def _(spark, d):
    """Drift of each later month against all before, from stored profiles alone; the later months together, beside the rows."""
    rows, cut = materialise(_training(spark, d)), F.lit(FOLD_CUTS[1])
    profiles = materialise(mq.value_profile(rows, _PSI_COLS))
    base, later = mq.merged_profile(profiles.filter(F.col("period") < cut)), profiles.filter(F.col("period") >= cut)
    whole = mq.profile_psi(base, mq.merged_profile(later)).select("feature", F.col("psi").alias("of_profiles"))
    exact = mq.psi(rows.filter(F.col("snapshot_date") < cut), rows.filter(F.col("snapshot_date") >= cut), _PSI_COLS, floor=0.005)
    both = whole.join(exact, "feature").select("feature", (F.abs(F.col("of_profiles") - F.col("psi")) < 0.05).alias("as_from_rows"))
    return mq.profile_psi(base, later).join(F.broadcast(both), "feature").select(
        "feature", "period", "rows", "missing", "least", "greatest", F.col("psi").isNotNull().alias("has_psi"), "as_from_rows"
    )


@query("train_and_score")
def _(spark, d):
    rows = materialise(_training(spark, d))
    model = rk.train(rows, FOLD_CUTS[2])
    return rk.score(model, _scoring(spark, d))


# --- conversations and requests --------------------------------------------------------------------


@query(
    "fold_messages",
    "SELECT CAST(chat_id AS VARCHAR) AS chat_id, message_id, role, content, false AS in_progress FROM msg",
)
def _(spark, d):
    out = cv.fold_messages(m.run_events(spark, d))
    return out.select("chat_id", "message_id", "role", "content", "in_progress")


@query(
    "fold_tool_calls",
    """SELECT CAST(chat_id AS VARCHAR) AS chat_id, message_id, 't-' || message_id AS tool_call_id, 'lookup' AS name,
    content AS arguments, 'done' AS content, false AS in_progress FROM msg WHERE role = 'assistant'""",
)
def _(spark, d):
    out = cv.fold_tool_calls(m.run_events(spark, d))
    return out.select("chat_id", "message_id", "tool_call_id", "name", "arguments", "content", "in_progress")


@query(
    "fold_reasonings",
    """SELECT CAST(chat_id AS VARCHAR) AS chat_id, message_id, 'Thinking' AS name, content, false AS in_progress
    FROM msg WHERE role = 'assistant'""",
)
def _(spark, d):
    out = cv.fold_reasonings(m.run_events(spark, d))
    return out.select("chat_id", "message_id", "name", "content", "in_progress")


@query(
    "fold_hot_chat",
    """SELECT CASE WHEN chat_id % 3 = 0 THEN 'all' ELSE CAST(chat_id AS VARCHAR) END AS chat_id, message_id, role, content, false AS in_progress FROM msg""",
)
def _(spark, d):
    out = cv.assemble_messages(_hot_chat(spark, d))
    return out.select("chat_id", "message_id", "role", "content", "in_progress")


def _hot_chat(spark, d):
    """Resolved events where one chat holds the runs of a third of all, and goes through blocks."""
    number = F.col("chat_id").cast("bigint")
    mine = F.pmod(number, F.lit(3)) == 0
    seq = F.when(mine, number * 1000 * m.TURN_SEQ + F.col("seq")).otherwise(F.col("seq"))
    events = m.run_events(spark, d).withColumns({"seq": seq, "chat_id": F.when(mine, F.lit("all")).otherwise(F.col("chat_id"))})
    return cv.resolve_events(events, chat_rows=1024)


@query(
    "fold_hot_chat_parts",
    """SELECT CASE WHEN chat_id % 3 = 0 THEN 'all' ELSE CAST(chat_id AS VARCHAR) END AS chat_id, message_id, content, kind, in_progress FROM (
    SELECT chat_id, message_id, content, unnest(['lookup', 'Thinking']) AS kind, false AS in_progress FROM msg WHERE role = 'assistant')""",
)
def _(spark, d):
    """Tool calls and reasonings of the same events."""
    resolved = _hot_chat(spark, d)
    tools = cv.assemble_tool_calls(resolved).select("chat_id", "message_id", F.col("arguments").alias("content"), F.col("name").alias("kind"), "in_progress")
    return tools.unionByName(cv.assemble_reasonings(resolved).select("chat_id", "message_id", "content", F.col("name").alias("kind"), "in_progress"))


@query(
    "fold_odd_runs",
    """SELECT CAST(chat_id AS VARCHAR) AS chat_id, message_id, 'assistant' AS role, content, (chat_id + seq) % 4 = 2 AS in_progress,
        CASE WHEN (chat_id + seq) % 4 = 1 THEN '[E1] Failed' END AS error FROM msg
    UNION ALL SELECT CAST(chat_id AS VARCHAR), message_id || '-other', 'assistant', 'aside', false, NULL FROM msg WHERE (chat_id + seq) % 4 = 3""",
)
def _(spark, d):
    """Runs that come in chunks, fail, never end, or write two messages in turn."""
    out = cv.fold_messages(m.odd_run_events(spark, d))
    return out.select("chat_id", "message_id", "role", "content", "in_progress", "error")


@query("unclosed_chats", "SELECT CAST(chat_id AS VARCHAR) AS chat_id, count(*) AS open_messages FROM msg WHERE role = 'assistant' GROUP BY 1")
def _(spark, d):
    events = m.run_events(spark, d)
    cut = events.filter(~F.col("type").isin("TEXT_MESSAGE_END", "RUN_FINISHED"))
    return cv.unclosed_chats(cv.fold_messages(cut))


@query(
    "run_outcomes",
    """SELECT CAST(chat_id AS VARCHAR) AS chat_id, 'r-' || message_id AS run_id,
    CASE WHEN role = 'assistant' THEN 'finished' ELSE 'incomplete' END AS outcome FROM msg""",
)
def _(spark, d):
    events = m.run_events(spark, d).withColumn("http_status", F.lit(200))
    return rq.run_outcomes(events).select("chat_id", "run_id", "outcome")


@query(
    "run_outcomes_all",
    """SELECT chat_id, message_id AS run_id, (['finished', 'error', 'http_error', 'timeout', 'exception', 'incomplete'])[seq % 6 + 1] AS outcome,
    CASE WHEN seq % 6 BETWEEN 1 AND 4 THEN content END AS error_detail, CASE WHEN seq % 6 = 2 THEN 503 ELSE 200 END AS http_status,
    CAST(seq % 6 AS DOUBLE) AS total_duration_s FROM msg""",
)
def _(spark, d):
    """Runs of every outcome, by the place of a message in its chat; texts of errors are whole."""
    kinds = F.array(*[F.lit(k) for k in ("RUN_FINISHED", "RUN_ERROR", "HTTP_ERROR", "TIMEOUT", "EXCEPTION", "TEXT_MESSAGE_CONTENT")])
    which = sc.pmod("seq", 6).cast("int")
    rows = m.messages(spark, d).withColumns({"chat_id": F.col("chat_id"), "run_id": F.col("message_id"), "which": which})
    step = F.explode(F.array(F.lit(0), F.lit(1))).alias("step")
    events = rows.select("chat_id", "run_id", "which", "content", "created_at", step).select(
        "chat_id", "run_id", F.col("step").alias("seq"),
        F.expr("timestampadd(SECOND, which * step, created_at)").alias("ts"),
        F.when(F.col("step") == 0, "RUN_STARTED").otherwise(F.get(kinds, F.col("which"))).alias("type"),
        F.when(F.col("step") == 1, F.col("content")).alias("error_message"),
        F.when((F.col("which") == 2) & (F.col("step") == 1), 503).otherwise(200).alias("http_status"),
    )
    return rq.run_outcomes(events).select("chat_id", "run_id", "outcome", "error_detail", "http_status", "total_duration_s")


@query(
    "dedup_messages",
    """SELECT chat_id, message_id, seq, role, CASE WHEN k.message_id IS NOT NULL THEN 'duplicate'
        WHEN role <> 'user' THEN CASE WHEN took AND seq > own * 2 THEN 'duplicate' ELSE 'rejected' END
        WHEN nth = 1 THEN 'accepted' ELSE 'duplicate' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY message_id, role ORDER BY seq) AS nth, bool_or(role = 'user') OVER (PARTITION BY message_id) AS took
        FROM (SELECT chat_id, message_id, seq AS own, seq * 2 AS seq, role FROM msg
            UNION ALL SELECT chat_id, message_id, seq, seq * 2, role FROM msg UNION ALL SELECT chat_id, message_id, seq, seq * 2 + 1, role FROM msg
            UNION ALL SELECT chat_id, message_id, seq, seq * 2 - 1, 'tool' FROM msg WHERE role = 'user')) i
    LEFT JOIN (SELECT message_id FROM msg WHERE seq < 2) k USING (message_id)""",
)
def _(spark, d):
    """Every message twice at one time and once later, and before each user message one of a tool under its id."""
    rows = m.messages(spark, d).select("chat_id", "message_id", "seq", "role")
    twice = rows.withColumn("seq", F.col("seq") * 2)
    later = rows.withColumn("seq", F.col("seq") * 2 + 1)
    early = rows.filter(F.col("role") == "user").withColumns({"seq": F.col("seq") * 2 - 1, "role": F.lit("tool")})
    incoming = twice.unionByName(twice).unionByName(later).unionByName(early)
    stored = rows.filter(F.col("seq") < 2)
    return cv.dedup_messages(incoming, stored).select("chat_id", "message_id", "seq", "role", "status")


@query(
    "chat_list",
    """SELECT c.chat_id, c.created_at, coalesce(x.latest, c.created_at) AS update_time FROM cht c
    LEFT JOIN (SELECT chat_id, max(created_at) AS latest FROM msg GROUP BY 1) x ON x.chat_id = c.chat_id""",
)
def _(spark, d):
    return cv.chat_list(m.chats(spark, d).select("chat_id", "created_at"), m.messages(spark, d))


@query(
    "chat_detail",
    "SELECT chat_id, max(created_at) OVER () AS update_time, message_id, seq, role, content, created_at FROM msg WHERE chat_id = 7",
)
def _(spark, d):
    return cv.chat_detail(m.chats(spark, d).select("chat_id", "created_at"), m.messages(spark, d), 7)


_CHAT_ITEMS = """SELECT chat_id, created_at AS message_ts, message_id, CAST(0 AS INTEGER) AS kind, message_id AS id, role, '' AS name, content FROM msg
    UNION ALL SELECT chat_id, created_at, message_id, 1, 't-' || message_id, 'tool', 'lookup', 'Completed lookup' FROM msg WHERE role = 'assistant'
    UNION ALL SELECT chat_id, created_at, message_id, 2, 'x-' || message_id, 'reasoning', 'Thinking', content FROM msg WHERE role = 'assistant'"""


@query("transcript_order", f"SELECT chat_id, message_ts, message_id, kind, id, role, content FROM ({_CHAT_ITEMS})")
def _(spark, d):
    """Every message with its tool and reasoning rows behind it, in one order over all chats."""
    rows = m.messages(spark, d).select("chat_id", F.col("created_at").alias("message_ts"), "message_id", "role", "content")
    items = [F.struct(F.lit(0).alias("kind"), F.col("message_id").alias("id"), F.col("role").alias("who"), F.col("content").alias("says"))]
    for kind, mark, who, says in ((1, "t-", "tool", F.lit("Completed lookup")), (2, "x-", "reasoning", F.col("content"))):
        item = F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(mark), "message_id").alias("id"), F.lit(who).alias("who"), says.alias("says"))
        items.append(F.when(F.col("role") == "assistant", item))
    items = rows.withColumn("__item", F.explode(F.array_compact(F.array(*items)))).withColumn("child_ts", F.col("message_ts"))
    ordered = od.transcript_order(items.select("chat_id", "message_ts", "message_id", "child_ts", "__item.*"))
    return ordered.select("chat_id", "message_ts", "message_id", "kind", "id", F.col("who").alias("role"), F.col("says").alias("content"))


@query("transcript", f"SELECT chat_id, id, role, name, content, row_number() OVER (PARTITION BY chat_id ORDER BY message_ts, message_id, kind, id) AS place FROM ({_CHAT_ITEMS})")
def _(spark, d):
    none = F.lit(None).cast("string")
    rows = m.messages(spark, d)
    base = {"in_progress": F.lit(False), "error": none}
    messages = rows.select(
        "chat_id", F.col("message_id").alias("message_uuid"), F.col("message_id").alias("public_id"), "role",
        F.lit("").alias("name"), "content", "created_at",
    ).withColumns(base)
    answers = rows.filter(F.col("role") == "assistant")
    tools = answers.select(
        F.col("message_id").alias("message_uuid"), F.concat(F.lit("t-"), "message_id").alias("uuid"),
        none.alias("tool_call_id"), none.alias("public_id"), F.lit("lookup").alias("name"), F.lit("{}").alias("arguments"),
        F.lit("").alias("content"), "created_at",
    ).withColumns(base)
    thoughts = answers.select(
        F.col("message_id").alias("message_uuid"), F.concat(F.lit("x-"), "message_id").alias("uuid"),
        none.alias("public_id"), F.lit("Thinking").alias("name"), "content", "created_at",
    ).withColumns(base)
    listed = cv.transcript(messages, tools, thoughts)
    return cv.placed(listed).select("chat_id", "id", "role", "name", "content", "place")


@query(
    "time_to_first_token",
    """SELECT user_id, CAST(date_diff('microsecond', min(ts), min(ts) FILTER (event_type = 'view')) AS DOUBLE) / 1000000e0 AS ttft_s
    FROM events GROUP BY 1""",
)
def _(spark, d):
    return rq.time_to_first_token(m.table(spark, d, "events"), ["user_id"], "view", "event_type")


@query(
    "load_report",
    _latency("'total_duration_all' AS metric,") + " UNION ALL " + _latency("'total_duration_finished' AS metric,", "WHERE outcome = 'finished'"),
)
def _(spark, d):
    return rq.load_report(m.requests(spark, d))


# --- checks ----------------------------------------------------------------------------------------


@query(
    "orphan_report",
    """SELECT 'lines without order' AS "check", count(*) AS failures FROM (SELECT DISTINCT l_orderkey FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey)
    UNION ALL SELECT 'orders without customer', count(*) FROM (SELECT DISTINCT o_custkey FROM orders ANTI JOIN customer ON o_custkey = c_custkey)
    UNION ALL SELECT 'orders without lines', count(*) FROM (SELECT DISTINCT o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey)""",
)
def _(spark, d):
    t = {n: m.table(spark, d, n) for n in ("lineitem", "orders", "customer")}
    lines = ck.orphan_report(t["lineitem"], [("lines without order", "l_orderkey", t["orders"], "o_orderkey")])
    heads = ck.orphan_report(
        t["orders"],
        [
            ("orders without customer", "o_custkey", t["customer"], "c_custkey"),
            ("orders without lines", "o_orderkey", t["lineitem"], "l_orderkey"),
        ],
    )
    return lines.unionByName(heads)


@query(
    "both_classes",
    """SELECT count(*) FILTER (shortage_within_30d = 1) AS positives, count(*) FILTER (shortage_within_30d = 0) AS negatives,
    count(*) FILTER (shortage_within_30d = 1) > 0 AND count(*) FILTER (shortage_within_30d = 0) > 0 AS both_present FROM trn""",
)
def _(spark, d):
    return ck.both_classes(_training(spark, d))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return ck.duplicate_keys(m.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "scale_report",
    f"""SELECT * , actual = expected AS matches FROM (
    SELECT 'locations' AS table_name, (SELECT count(*) FROM nation) AS expected, (SELECT count(*) FROM loc) AS actual
    UNION ALL SELECT 'positions', (SELECT count(*) * (SELECT count(DISTINCT p_type) FROM part) FROM nation), (SELECT count(*) FROM prs)
    UNION ALL SELECT 'inventory_daily', (SELECT count(*) * (SELECT count(DISTINCT p_type) FROM part) * {m.PANEL_DAYS} FROM nation), (SELECT count(*) FROM inv)
    UNION ALL SELECT 'orders', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM ord)
    UNION ALL SELECT 'supplier_events', (SELECT 2 * count(*) FROM supplier), (SELECT count(*) FROM evt))""",
)
def _(spark, d):
    """What the source tables let expect, beside what is derived from them."""
    count = F.count("*").alias("n")
    kinds = m.table(spark, d, "part").agg(F.count_distinct("p_type").alias("kinds"))
    places = m.table(spark, d, "nation").agg(count).join(F.broadcast(kinds))  # one row each
    expected = places.select(F.lit("locations").alias("table_name"), F.col("n").alias("expected"))
    for name, rows in (
        ("positions", places.select(F.col("n") * F.col("kinds"))),
        ("inventory_daily", places.select(F.col("n") * F.col("kinds") * m.PANEL_DAYS)),
        ("orders", m.table(spark, d, "lineitem").agg(count)),
        ("supplier_events", m.table(spark, d, "supplier").agg((2 * F.count("*")).alias("n"))),
    ):
        expected = expected.unionByName(rows.toDF("expected").select(F.lit(name).alias("table_name"), "expected"))
    tables = {
        "locations": m.locations(spark, d), "positions": m.pairs(spark, d), "inventory_daily": m.inventory(spark, d),
        "orders": m.order_lines(spark, d), "supplier_events": m.supplier_events(spark, d),
    }
    return ck.scale_report(expected, tables)


@query(
    "panel_gaps",
    f"""SELECT k.location_id, k.item_id, CAST(g.day AS DATE) AS snapshot_date FROM (SELECT DISTINCT location_id, item_id FROM flows) k
    CROSS JOIN (SELECT unnest(generate_series({_START}, {_AS_OF}, INTERVAL 1 DAY)) AS day) g
    ANTI JOIN flows f ON f.location_id = k.location_id AND f.item_id = k.item_id AND f.snapshot_date = CAST(g.day AS DATE)""",
)
def _(spark, d):
    return ck.panel_gaps(m.daily_flows(spark, d), KEYS, START, AS_OF)


@query("status_mix", "SELECT inventory_status, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM pos GROUP BY 1")
def _(spark, d):
    return ck.status_mix(m.position(spark, d))


@query(
    "rule_checks",
    """SELECT rule, rows, failures FROM (SELECT count(*) AS rows, count(*) FILTER (NOT coalesce(l_shipdate IS NOT NULL, false)) AS a,
    count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS b, count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) AS c FROM lineitem) t,
    LATERAL (VALUES ('ship date present', a), ('flag known', b), ('discount in range', c)) v(rule, failures)""",
)
def _(spark, d):
    return ck.rule_checks(
        m.table(spark, d, "lineitem"),
        {
            "ship date present": ck.not_null("l_shipdate"),
            "flag known": ck.one_of("l_returnflag", ["A", "N"]),
            "discount in range": ck.between("l_discount", 0, 0.05),
        },
    )


# --- batch forms of the streaming jobs -------------------------------------------------------------


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return sj.stream_dedup(m.table(spark, d, "events").select("user_id", "event_type"), keys=["user_id", "event_type"])


@query(
    "stream_request_rates",
    f"""SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, requests, errors, errors / requests AS error_rate, mean_s
    FROM (SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, count(*) FILTER (outcome <> 'finished') AS errors,
    {rnd("CAST(sum(CAST(duration_s AS DECIMAL(18,6))) AS DOUBLE) / count(*)", 6)} AS mean_s FROM req GROUP BY 1)""",
)
def _(spark, d):
    return sj.stream_request_rates(m.requests(spark, d), "1 hour").drop("approx_p90_s")


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS events FROM (
    SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s""",
)
def _(spark, d):
    return sj.stream_sessions(m.table(spark, d, "events"), "6 hours")
