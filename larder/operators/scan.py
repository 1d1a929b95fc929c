"""Ordered scans that do not put one key, or the whole table, into one task.

A window over ``partitionBy(key)`` sorts a whole key in one task. Where a key may hold a large part
of all rows, or where there is no key at all, these operators cut the order into blocks, summarise
each block with a map-side combine, run the window over the few block summaries, and finish inside
each block. Results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.session import materialise

BLOCK_ROWS = 65_536


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join on keys where NULL equals NULL, adding ``cols`` of ``side``.

    Without keys, ``side`` has one row, and its values are read as scalar subqueries: no join at all.
    """
    if not keys:
        return df.withColumns({c: side.select(c).scalar() for c in cols})
    side = side.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *cols)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(side, condition, "left").drop(*[f"__k_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Keys with more than ``rows`` rows, or None where there are none. One counting job."""
    hot = df.groupBy(*keys).count().filter(F.col("count") > rows).select(*keys)
    return None if hot.isEmpty() else hot


def carry_within(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    upto: Mapping[str, Column | str] | None = None,
    before: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """``carry_forward`` for keys known to have few rows: windows only, no join."""
    order = Window.partitionBy(*keys).orderBy(seq)

    def last(c, end: int) -> Column:
        return F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, end))

    return df.withColumns(
        {
            **{n: last(c, 0) for n, c in (upto or {}).items()},
            **{n: last(c, -1) for n, c in (before or {}).items()},
        }
    )


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    upto: Mapping[str, Column | str] | None = None,
    before: Mapping[str, Column | str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Last non-NULL value of each expression per key in order of ``seq``: of the rows up to and with
    this one (``upto``), or of the earlier rows only (``before``).

    Rows are sorted into ranges of key and ``seq`` by Spark's sample of them, and stored so, once; any orderable ``seq``
    with or without gaps will do. A key of any size is spread over as many ranges as it fills, and each range gives
    one row per key that it has.
    """
    keys = list(keys)
    upto, before = dict(upto or {}), dict(before or {})
    values = {n: (F.col(c) if isinstance(c, str) else c) for n, c in {**upto, **before}.items()}
    spread = df.repartitionByRange(ranges, *keys, seq) if ranges else df.repartitionByRange(*keys, seq)
    blocked = materialise(
        spread.withColumns({"__block": F.spark_partition_id(), **{f"__v_{n}": v for n, v in values.items()}})
    )
    summary = blocked.groupBy(*keys, "__block").agg(
        *[
            F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(seq))).alias(f"__b_{n}")
            for n in values
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        "__block",
        *[F.last(f"__b_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in values],
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(seq)

    def local(name: str) -> Column:
        w = inside.rowsBetween(Window.unboundedPreceding, 0 if name in upto else -1)
        return F.last(f"__v_{name}", ignorenulls=True).over(w)

    joined = attach(blocked, carried, [*keys, "__block"], [f"__c_{n}" for n in values])
    out = joined.withColumns({n: F.coalesce(local(n), F.col(f"__c_{n}")) for n in values})
    return out.drop("__block", *[f"__{kind}_{n}" for n in values for kind in ("v", "c")])


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    whole: Mapping[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Total of each column over the rows of the group with a smaller ``order`` value; those of ``whole`` over all rows
    of the group.

    Rows are unique per group and ``order``: pre-aggregate first, so that a value shared by a third
    of all rows is one row here. They are sorted into ranges of group and value by Spark's sample of them, so a
    group of any size is spread over as many ranges as it fills. Each range gives one row per group that it has: what
    comes before a range is summed over those few rows, and what comes before a row inside its range.

    The ranges are stored, so that every reader, retries included, sees the same ones. Without ``ranges`` there are as
    many as shuffle partitions. Only the sums per range, as many rows as ranges, meet in one task, and only without ``by``.
    """
    by, whole = list(by), dict(whole or {})
    spread = df.repartitionByRange(ranges, *by, order) if ranges else df.repartitionByRange(*by, order)
    rows = materialise(spread.withColumn("__range", F.spark_partition_id()))
    few = rows.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in {**sums, **whole}.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = few.select(
        *by,
        "__range",
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(group).alias(n) for n in whole],
    )
    inside = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = attach(rows, offsets, [*by, "__range"], [*[f"__c_{n}" for n in sums], *whole])
    return out.withColumns({n: F.col(n) + F.col(f"__c_{n}") for n in sums}).drop("__range", *[f"__c_{n}" for n in sums])


def exact_percentiles(
    df: DataFrame,
    col: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    scale: int = 6,
    ranges: int | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles, exact, without holding a group in one task.

    Equal values are counted first; the two order statistics around each rank are then picked out of
    the running counts. ``scale`` rounds the interpolated result.
    """
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_totals(counts, by, "__x", {"__before": "__n"}, {"__total": "__n"}, ranges)
    aggs = []
    for name, p in probs.items():
        k = (F.col("__total") - 1) * F.lit(float(p))
        low = F.floor(k)
        high = F.least(low + 1, F.col("__total") - 1)

        def at(rank):
            hit = (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
            return F.max(F.when(hit, F.col("__x").cast("double")))

        low_x, high_x, share = at(low), at(high), F.max(k - low)
        value = low_x + share * (high_x - low_x)
        step = float(10**scale)
        aggs.append((F.floor(value * F.lit(step) + F.lit(0.5)) / F.lit(step)).alias(name))
    return ranked.groupBy(*by).agg(*aggs)
