"""Readiness rules as set operations over positions, predictions, performance and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.joins import attach_active, attach_policy
from larder.operators.ordering import top_per

# Fixed values of the rules.
ELEVATED_BAND_DAYS = 5
PREDICTIVE_THRESHOLD = 0.70
SUPPLIER_RATE_THRESHOLD = 0.85
ESCALATED_CRITICALITY = ("MISSION_CRITICAL", "HIGH")
EVENT_TYPES = (
    "MANUFACTURING_CONSTRAINT",
    "TRANSPORT_DELAY",
    "QUALITY_HOLD",
    "COLD_CHAIN_EXCEPTION",
    "RAW_MATERIAL_SHORTAGE",
    "CAPACITY_REDUCTION",
)
COLD_CHAIN_EVENT = "COLD_CHAIN_EXCEPTION"
RULE_IDS = {
    "immediate": "MED-ESC-001",
    "elevated": "MED-ESC-002",
    "predictive": "MED-ESC-003",
    "supplier_rate": "MED-SUP-001",
    "supplier_event": "MED-SUP-002",
    "cold_chain": "MED-COLD-001",
}
LEVELS = {
    "immediate": 3, "elevated": 2, "predictive": 2, "cold_chain": 2, "supplier_rate": 1, "supplier_event": 1,
}


def _below() -> Column:
    return F.col("days_of_supply") < F.col("minimum_days_supply")


def _near(band: int) -> Column:
    return ~_below() & (F.col("days_of_supply") <= F.col("minimum_days_supply") + band)


def immediate_review(position: DataFrame) -> DataFrame:
    return position.filter(_below())


def _pressure() -> Column:
    return (F.col("backordered_units") > 0) | (F.col("late_inbound_units") > 0)


def elevated_review(position: DataFrame, events: DataFrame, as_of, band: int = ELEVATED_BAND_DAYS) -> DataFrame:
    """Close above the minimum, and backorders, late inbound units or a disrupted supplier."""
    near = attach_active(position.filter(_near(band)), events, as_of)
    return near.filter(_pressure() | (F.col("active_events") > 0))


def predictive_trigger(
    predictions: DataFrame,
    t: float = PREDICTIVE_THRESHOLD,
    probability: str = "shortage_probability_30d",
) -> DataFrame:
    return predictions.filter((F.col(probability) >= t) & F.col("criticality").isin(*ESCALATED_CRITICALITY))


def supplier_review(performance: DataFrame, t: float = SUPPLIER_RATE_THRESHOLD) -> DataFrame:
    return performance.filter(F.col("actual_ontime_rate_90d") < t)


def supplier_evidence(position: DataFrame, events: DataFrame, as_of) -> DataFrame:
    """Positions with an active event of a named type at their supplier. Evidence, not proof."""
    return attach_active(position, events, as_of, EVENT_TYPES).filter(F.col("active_events") > 0)


def cold_chain_urgency(position: DataFrame, events: DataFrame, as_of) -> DataFrame:
    cold = attach_active(position.filter("cold_chain_required"), events, as_of)
    event = F.array_contains("active_event_types", COLD_CHAIN_EVENT)
    return cold.filter(_pressure() | event)


def escalation(
    position: DataFrame,
    predictions: DataFrame | None,
    events: DataFrame,
    as_of,
    band: int = ELEVATED_BAND_DAYS,
    t: float = PREDICTIVE_THRESHOLD,
    rate_below: float = SUPPLIER_RATE_THRESHOLD,
) -> DataFrame:
    """Level of every position with the ids of the rules that fired, in one pass over the positions.

    Without ``predictions`` the positions have their probability already.
    """
    out = attach_active(position, events, as_of, EVENT_TYPES)
    if predictions is not None:
        p = predictions.select("location_id", "item_id", "shortage_probability_30d")
        out = out.join(p, ["location_id", "item_id"], "left")
    active = F.col("active_events") > 0
    cold = F.array_contains("active_event_types", COLD_CHAIN_EVENT)
    fired = {
        "immediate": _below(),
        "elevated": _near(band) & (_pressure() | active),
        "predictive": (F.col("shortage_probability_30d") >= t) & F.col("criticality").isin(*ESCALATED_CRITICALITY),
        "supplier_rate": F.col("actual_ontime_rate_90d") < rate_below,
        "supplier_event": active,
        "cold_chain": F.col("cold_chain_required") & (_pressure() | cold),
    }
    level = F.greatest(*[F.when(c, LEVELS[n]).otherwise(0) for n, c in fired.items()])
    rules = F.array_compact(F.array(*[F.when(c, F.lit(RULE_IDS[n])) for n, c in fired.items()]))
    return out.select(
        "location_id", "item_id", "criticality", "days_above_minimum", "shortage_probability_30d",
        level.alias("escalation_level"), rules.alias("rule_ids"),
    )


def transfer_candidates(position: DataFrame, predictions: DataFrame | None, k: int = 3, band: int = ELEVATED_BAND_DAYS) -> DataFrame:
    """Up to k lower-risk locations that hold the same item above its minimum, per position in need.

    Donors are ordered by risk first, so the donors a position may use are a prefix of its item's
    list. The best k donors of each item are therefore enough, and a position is matched with k
    donors at most, never with all locations of the item.
    """
    rows = position.withColumnRenamed("shortage_probability_30d", "risk")
    if predictions is not None:
        p = predictions.select("location_id", "item_id", F.col("shortage_probability_30d").alias("risk"))
        rows = position.join(p, ["location_id", "item_id"])
    margin = F.col("days_of_supply") - F.col("minimum_days_supply")
    donors = rows.filter((margin > 0) & (~F.col("cold_chain_required") | F.col("cold_storage_flag"))).select(
        "item_id",
        F.col("location_id").alias("donor_location_id"),
        F.col("risk").alias("donor_risk"),
        margin.cast("double").alias("donor_surplus_days"),
    )
    best = top_per(donors, ["item_id"], ["donor_risk", "-donor_surplus_days", "donor_location_id"], k)
    needy = rows.filter(_below() | _near(band)).select("location_id", "item_id", F.col("risk").alias("own_risk"))
    return needy.join(best, "item_id").filter(F.col("donor_risk") < F.col("own_risk"))


def alternate_suppliers(lines: DataFrame, performance: DataFrame, k: int = 3) -> DataFrame:
    """Suppliers that have delivered an item, best on-time rate first, then shortest lead time."""
    used = lines.groupBy("item_id", "supplier_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("units").alias("units")
    )
    rated = used.join(
        performance.select("supplier_id", "actual_ontime_rate_90d", "contract_lead_time_days"), "supplier_id"
    )
    order = [F.desc_nulls_last("actual_ontime_rate_90d"), F.asc("contract_lead_time_days"), F.asc("supplier_id")]
    return top_per(rated, ["item_id"], order, k)


def rules_for(position: DataFrame, sections: DataFrame) -> DataFrame:
    """Governing sections of each position with their source."""
    source = ["document", "document_file_path", "policy_title", "section_id", "authority", "effective_date"]
    return attach_policy(position, sections).select("location_id", "item_id", "policy_reference_id", *source)


def rule_mismatches(items: DataFrame, rules: DataFrame, keys: Sequence[str] = ("commodity_group",)) -> DataFrame:
    """Items whose base minimum is not the rule's, and items without a rule."""
    wanted = rules.select(*keys, F.col("base_min_days").alias("rule_min_days"))
    both = items.join(wanted, list(keys), "left")
    return both.filter(~F.col("base_min_days").eqNullSafe(F.col("rule_min_days")))
