"""Status and quantity rules of stock, orders and shipments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.scalars import _col, round_to, safe_ratio

CRITICALITY_DAYS = {"MISSION_CRITICAL": 7, "HIGH": 3}
PRIORITY_DAYS = 3
PRIORITY_FROM = 4
WATCH_BAND_DAYS = 7


def inventory_status(
    on_hand: Column | str, dos: Column | str, minimum: Column | str, band: int = WATCH_BAND_DAYS
) -> Column:
    on_hand, dos, minimum = _col(on_hand), _col(dos), _col(minimum)
    return (
        F.when(on_hand <= 0, "STOCKOUT")
        .when(dos < minimum, "BELOW_MINIMUM")
        .when(dos < minimum + band, "WATCH")
        .otherwise("HEALTHY")
    )


def criticality_days(criticality: Column | str) -> Column:
    c = _col(criticality)
    return (
        F.when(c == "MISSION_CRITICAL", CRITICALITY_DAYS["MISSION_CRITICAL"])
        .when(c == "HIGH", CRITICALITY_DAYS["HIGH"])
        .otherwise(0)
    )


def minimum_days(base: Column | str, criticality: Column | str, priority: Column | str | None = None) -> Column:
    """Base days of the family, more for critical items and for high-priority locations."""
    days = _col(base) + criticality_days(criticality)
    if priority is not None:
        days = days + F.when(_col(priority) >= PRIORITY_FROM, PRIORITY_DAYS).otherwise(0)
    return days.cast("int")


def stock_ledger(
    flows: DataFrame, keys: Sequence[str], day: str, receipts: str, issues: str, opening: str
) -> DataFrame:
    """Running balance and on-hand stock from daily flows; a negative balance shows as 0 on hand."""
    so_far = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rowsBetween(Window.unboundedPreceding, 0)
    balance = F.col(opening) + F.sum(F.col(receipts) - F.col(issues)).over(so_far)
    return flows.withColumn("balance_units", balance).withColumn(
        "on_hand_units", F.greatest(F.lit(0).cast("bigint"), F.col("balance_units"))
    )


def days_of_supply(on_hand: Column | str, daily_demand: Column | str) -> Column:
    """Stock divided by daily demand, two digits, as an exact decimal."""
    return round_to(safe_ratio(on_hand, daily_demand), 2).cast("decimal(18,2)")


def unmet_units(required: Column | str, available: Column | str) -> Column:
    required, available = _col(required), _col(available)
    return F.greatest(F.lit(0).cast("bigint"), required.cast("bigint") - available.cast("bigint"))


def expiring_units(lots: DataFrame, keys: Sequence[str], as_of, within: int = 90) -> DataFrame:
    """Units per key in lots on hand that expire from the as-of date to ``within`` days later.

    Lots have ``receipt_date``, ``shelf_life_days`` and ``units``.
    """
    as_of = F.lit(as_of).cast("date")
    expiry = F.date_add("receipt_date", F.col("shelf_life_days"))
    return (
        lots.filter((F.col("receipt_date") <= as_of) & (expiry >= as_of) & (expiry <= F.date_add(as_of, within)))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("expiring_lots"), F.sum("units").alias("expiring_units"))
    )


def order_status(
    as_of, cancelled: Column | str, actual: Column | str, promised: Column | str, shipped: Column | str
) -> Column:
    as_of = F.lit(as_of).cast("date")
    return (
        F.when(_col(cancelled), "CANCELLED")
        .when(_col(actual) <= as_of, "DELIVERED")
        .when(_col(promised) < as_of, "BACKORDERED")
        .when(_col(shipped) <= as_of, "IN_TRANSIT")
        .otherwise("OPEN")
    )


def order_priority(criticality: Column | str, priority: Column | str) -> Column:
    c, p = _col(criticality), _col(priority)
    return (
        F.when((c == "MISSION_CRITICAL") | (p >= 5), "URGENT")
        .when((c == "HIGH") | (p >= 4), "HIGH")
        .otherwise("ROUTINE")
    )


def delivered_units(status: Column | str, ordered: Column | str, partial: Column | str, fill: float = 0.75) -> Column:
    """Units that came: all, or a part of a partial fill, of a delivered order; else none."""
    ordered = _col(ordered).cast("double")
    filled = round_to(ordered * F.when(_col(partial), F.lit(fill)).otherwise(F.lit(1.0)))
    return F.when(_col(status) == "DELIVERED", filled.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def extended_value(units: Column | str, unit_cost: Column | str) -> Column:
    return (_col(units).cast("decimal(18,0)") * _col(unit_cost).cast("decimal(18,2)")).cast("decimal(28,2)")


def fill_quantity(orders: DataFrame, partial: Column | str, fill: float = 0.75) -> DataFrame:
    """Delivered units and extended value of orders with status, ordered units and unit cost."""
    return orders.withColumns(
        {
            "delivered_units": delivered_units("order_status", "ordered_units", partial, fill),
            "extended_value_usd": extended_value("ordered_units", "unit_cost_usd"),
        }
    )


def shipment_status(shipments: DataFrame, as_of, mode: str = "as_known") -> DataFrame:
    """Status, lateness and on-time flag at the as-of date; a later delivery date is hidden.

    ``as_known`` uses what is known on the day: an undelivered shipment past its promise is late by
    the days so far, one not yet due has no lateness. ``reference`` uses the final delay even of
    shipments still under way.
    """
    if mode not in ("as_known", "reference"):
        raise ValueError(f"unknown mode {mode!r}")
    as_of = F.lit(as_of).cast("date")
    actual, promised = F.col("actual_delivery_date"), F.col("promised_delivery_date")
    arrived = F.coalesce(actual <= as_of, F.lit(False))
    delay = F.datediff(actual, promised)
    if mode == "as_known":
        open_late = promised < as_of
        delay = F.when(arrived, delay).when(open_late, F.datediff(as_of, promised))
    return shipments.withColumns(
        {
            "shipment_status": F.when(arrived, "DELIVERED").when(promised < as_of, "LATE").otherwise("IN_TRANSIT"),
            "days_late": F.when(delay.isNotNull(), F.greatest(F.lit(0), delay)),
            "on_time_flag": delay <= 0,
            "actual_delivery_date": F.when(arrived, actual),
        }
    )


def status_changes(panel: DataFrame, keys: Sequence[str], day: str, below: Column) -> DataFrame:
    """Days on which a position crosses its minimum, either way. The first day is compared with nothing
    and counts only when it is below. The batch form of the alert stream."""
    before = F.lag(F.col("__below")).over(Window.partitionBy(*keys).orderBy(day))
    rows = panel.withColumn("__below", below).withColumn("__before", F.coalesce(before, F.lit(False)))
    return (
        rows.filter(F.col("__below") != F.col("__before"))
        .withColumn("alert", F.when(F.col("__below"), "BELOW_MINIMUM").otherwise("RECOVERED"))
        .drop("__below", "__before")
    )
