"""Joins. Sides are broadcast by Spark when their measured size allows; nothing is forced here,
except lookup lists that are written out in the program, and a calendar that is far larger than its estimate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.scan import attach, running_totals


def enrich(
    fact: DataFrame,
    dim: DataFrame,
    key: str | Sequence[str],
    cols: Sequence[str] | Mapping[str, str],
    dim_key: str | Sequence[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Look up dimension columns by key, whatever the key is called in the dimension."""
    keys = [key] if isinstance(key, str) else list(key)
    dim_keys = keys if dim_key is None else [dim_key] if isinstance(dim_key, str) else list(dim_key)
    names = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    side = dim.select(
        *[F.col(d).alias(k) for d, k in zip(dim_keys, keys)],
        *[F.col(source).alias(name) for source, name in names.items()],
    )
    return fact.join(side, keys, how)


def join_dropping(left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str = "inner") -> DataFrame:
    """Equi-join of two differently named columns; the right one is dropped."""
    return left.join(right, left[left_col] == right[right_col], how).drop(right[right_col])


def left_join_filled(left: DataFrame, right: DataFrame, keys: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    return left.join(right, list(keys), "left").fillna(dict(fill))


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Distinct fact keys that the dimension lacks."""
    known = dim.select(F.col(dim_key or key).alias(key))
    return fact.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")


def panel(keys: DataFrame, start, end, day: str = "snapshot_date") -> DataFrame:
    """Every key on every day. The days are an array exploded in place, so there is no join."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return keys.withColumn(day, F.explode(days))


def modular_bridge(
    left: DataFrame,
    index: str,
    k: int,
    n: int,
    a: int,
    b: int,
    slot: str = "slot",
    target: str = "target_index",
) -> DataFrame:
    """Assign k partners out of n to each entity: partner = (a·index + b·slot) mod n."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return left.withColumn(slot, slots).withColumn(
        target, F.pmod(F.col(index).cast("bigint") * a + F.col(slot).cast("bigint") * b, F.lit(n))
    )


def active_disruptions(events: DataFrame, as_of, types: Sequence[str] | None = None) -> DataFrame:
    """Events whose interval contains the as-of date."""
    active = events.filter((F.col("start_date") <= F.lit(as_of)) & (F.col("end_date") >= F.lit(as_of)))
    return active.filter(F.col("event_type").isin(*types)) if types else active


def attach_active(
    position: DataFrame,
    events: DataFrame,
    as_of,
    types: Sequence[str] | None = None,
    supplier: str = "preferred_supplier_id",
) -> DataFrame:
    """Add the number of active events at the preferred supplier and their distinct types.

    Events are reduced to one row per supplier first, so positions are never multiplied.
    """
    per_supplier = (
        active_disruptions(events, as_of, types)
        .groupBy(F.col("supplier_id").alias(supplier))
        .agg(
            F.count(F.lit(1)).alias("active_events"),
            F.array_sort(F.collect_set("event_type")).alias("active_event_types"),
        )
    )
    return position.join(per_supplier, supplier, "left").withColumns(
        {
            "active_events": F.coalesce("active_events", F.lit(0).cast("bigint")),
            "active_event_types": F.coalesce("active_event_types", F.array().cast("array<string>")),
        }
    )


#: Days of a calendar row, a bit of a long each.
BLOCK_DAYS = 64


def disruption_days(
    position: DataFrame,
    events: DataFrame,
    lookback: int,
    supplier: str = "preferred_supplier_id",
    day: str = "snapshot_date",
    out: str = "disrupted_days",
    ahead: int = 0,
) -> DataFrame:
    """Days with a disruption at the preferred supplier in the last ``lookback`` days, today included, and in the next ``ahead``.

    Affected days become bits of one row per supplier and block of days (overlaps merge), which holds the block and the
    neighbours that a window of its days may reach. The position is joined once, by equality on supplier and block, and
    counts the bits in its window: no range join, and a supplier with very many events adds no more than its calendar.

    The calendar is never broadcast: its estimate is the size of the events before their days are laid out.
    """
    first, last = 1 - lookback, ahead
    if first > last:
        raise ValueError("the window has no days")
    reach = range(first // BLOCK_DAYS, (BLOCK_DAYS - 1 + last) // BLOCK_DAYS + 1)
    affected = events.select(
        F.col("supplier_id").alias(supplier),
        F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("affected"),
    ).withColumn("__of", F.explode(F.array(*[F.lit(k) for k in reach])))
    number = _number("affected")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(BLOCK_DAYS)))
    calendar = affected.groupBy(supplier, (_block(number) - F.col("__of")).alias("__block")).agg(
        *[F.bit_or(F.when(F.col("__of") == k, bit)).alias(f"__bits{i}") for i, k in enumerate(reach)]
    )
    joined = position.withColumn("__block", _block(_number(day))).join(calendar.hint("merge"), [supplier, "__block"], "left")
    place = F.pmod(_number(day), F.lit(BLOCK_DAYS))
    counted = []
    for i, k in enumerate(reach):
        window = _bits(place + (first - k * BLOCK_DAYS), place + (last - k * BLOCK_DAYS))
        counted.append(F.coalesce(F.bit_count(F.col(f"__bits{i}").bitwiseAND(window)), F.lit(0)))
    others = [c for c in position.columns if c not in (supplier, day)]
    return joined.select(supplier, day, *others, sum(counted, F.lit(0)).cast("bigint").alias(out))


def _number(day: str) -> Column:
    return F.unix_date(F.col(day).cast("date"))


def _block(number: Column) -> Column:
    """The block of a day's number; days before 1970 have negative ones."""
    return F.floor(number / BLOCK_DAYS).cast("int")


def _bits(low: Column, high: Column) -> Column:
    """A long with the bits from ``low`` to ``high``, as far as it has them; NULL without any."""
    ones = F.lit(-1).cast("bigint")
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(BLOCK_DAYS - 1))
    above, below = F.call_function("shiftleft", ones, low), F.call_function("shiftrightunsigned", ones, BLOCK_DAYS - 1 - high)
    return F.when(low <= high, above.bitwiseAND(below))


#: Copies of the general sections, so that no task meets all positions.
POLICY_SALTS = 32


def attach_policy(position: DataFrame, sections: DataFrame, general: str = "MED-STOCK-GENERAL", salts: int = POLICY_SALTS) -> DataFrame:
    """The rule sections that govern a position: by its own rule id, and the general ones.

    Every position has the general id, so its sections come in ``salts`` copies and a position takes one by its hash.
    """
    plain = [c for c, kind in position.dtypes if not kind.startswith(("map", "variant"))]
    own = F.struct(F.col("policy_reference_id"), F.lit(0).alias("__salt"))
    shared = F.struct(F.lit(general).alias("policy_reference_id"), F.pmod(F.hash(*plain), F.lit(salts)).alias("__salt"))
    wanted = position.withColumn("__rule", F.explode(F.array(own, shared))).drop("policy_reference_id")
    wanted = wanted.select(*wanted.columns[:-1], "__rule.*")
    copies = F.when(F.col("policy_reference_id") == general, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return wanted.join(sections.withColumn("__salt", F.explode(copies)), ["policy_reference_id", "__salt"]).drop("__salt")


def nest_children(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Each parent with each of its children as a struct ``name``, and the child's place in ``<name>_position``, from 0.

    Every parent has as many rows as it has children, and one with NULLs if it has none, so a parent of any size is
    spread over tasks. ``order`` starts with a whole-number or time column; places are counted in that order.
    """
    cols = [c for c in children.columns if c != key]
    placed = _numbered(children, key, order)
    placed = placed.select(key, F.col("__pos").cast("bigint").alias(f"{name}_position"), F.struct(*cols).alias(name))
    return parents.join(placed, key, "left")


def _numbered(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Position of each row in its group by an exact blocked count, safe for a hot group."""
    lead = order[0]
    counts = df.groupBy(key, lead).agg(F.count(F.lit(1)).alias("__n"))
    before = running_totals(counts, [key], lead, {"__before": "__n"}).drop("__n")
    inside = Window.partitionBy(key, lead).orderBy(*order)
    return attach(df, before, [key, lead], ["__before"]).withColumn(
        "__pos", F.col("__before") + F.row_number().over(inside) - 1
    ).drop("__before")
