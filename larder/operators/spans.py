"""Sparse panels: a row where something changes, good until the day before the next one.

A dense panel has a row per key and day, also where nothing happens. With many keys and few flows most rows repeat the
one before. Here a key has a row on the days of its flows and on the days on which a frame gains or loses a flow; sums
over days come from range frames over day numbers, and means over days of a level from its running integral. Rows grow
with flows, not with keys times days.

All frames share the partitioning of ``change_rows``, which may be coarser than the keys. Flows are daily totals, so a
hot key has at most one row per day and column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.windows import frame


def change_rows(
    flows: DataFrame,
    keys: Sequence[str],
    day: str,
    values: Sequence[str],
    first: dt.date,
    last: dt.date,
    at: Sequence[dt.date] = (),
    shifts: Mapping[str, Sequence[int]] | None = None,
    least: Sequence[str] = (),
    by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Daily flows, one row per key and day, with empty rows on more days.

    Every key gets a row on the days ``at``. A flow of a column named in ``shifts`` gives an empty row that many days
    later (earlier if negative) where this is between ``first`` and ``last``. Of the columns ``least`` a row has the
    least value. Rows are exchanged once, by ``by`` or else by the keys, into ``tasks`` parts: the sorts and frames that
    follow hold a task's rows several times, so their number should grow with the rows, not with the bytes exchanged.
    """
    none = [F.lit(0).cast("bigint").alias(v) for v in values]
    rows = [F.struct(F.col(day).alias(day), *values)]
    rows += [F.struct(F.lit(d).cast("date").alias(day), *none) for d in at]
    for value, offsets in (shifts or {}).items():
        for k in offsets:
            there = F.date_add(day, k)
            inside = (F.col(value) != 0) & there.between(F.lit(first), F.lit(last))
            rows.append(F.when(inside, F.struct(there.alias(day), *none)))
    moved = flows.select(*keys, *least, F.explode(F.array_compact(F.array(*rows))).alias("__row"))
    moved = moved.select(*keys, *least, "__row.*")
    moved = moved.repartition(tasks, *(by or keys)) if tasks else moved.repartition(*(by or keys))
    sums = [F.sum(v).alias(v) for v in values]
    return moved.groupBy(*keys, day).agg(*sums, *[F.min(c).alias(c) for c in least])


def valid_until(keys: Sequence[str], day: str, last: dt.date) -> Column:
    """The day before the next row of the key, or the last day."""
    following = F.lead(day).over(Window.partitionBy(*keys).orderBy(F.unix_date(day)))
    return F.coalesce(F.date_sub(following, 1), F.lit(last).cast("date"))


def changes_only(rows: DataFrame, keys: Sequence[str], day: str, state: Sequence[str]) -> DataFrame:
    """Rows whose state differs from that of the row before; the first row of a key stays."""
    order = Window.partitionBy(*keys).orderBy(F.unix_date(day))
    now = F.struct(*state)
    return rows.withColumn("__same", F.lag(now).over(order).eqNullSafe(now)).filter(~F.col("__same")).drop("__same")


def days_in_frame(day: str, k: int, first: dt.date) -> Column:
    """How many of the last k days are in a panel that starts on the first day."""
    return F.least(F.lit(k), F.datediff(day, F.lit(first)) + 1)


def flow_mean(keys: Sequence[str], day: str, value: str, k: int, first: dt.date) -> Column:
    """Mean per day of a flow over the last k days, days without a row included."""
    total = F.sum(value).over(frame(keys, day, 1 - k, 0))
    return total.cast("double") / days_in_frame(day, k, first).cast("double")


def flow_std(keys: Sequence[str], day: str, value: str, k: int, first: dt.date) -> Column:
    """Population standard deviation of daily flows over the last k days, days without a row as zeros."""
    w, n = frame(keys, day, 1 - k, 0), days_in_frame(day, k, first).cast("double")
    x = F.col(value).cast("decimal(18,0)")
    total, squares = F.sum(x).over(w).cast("double"), F.sum(x * x).over(w).cast("double")
    return F.sqrt(F.greatest(F.lit(0.0), n * squares - total * total)) / n


def with_level_mean(rows: DataFrame, keys: Sequence[str], day: str, level: str, k: int, first: dt.date, out: str) -> DataFrame:
    """Mean per day of a level over the last k days: the integral up to today less that of k days ago.

    Between two rows the level is that of the earlier one. Every key needs a row on the first day.
    """
    order = Window.partitionBy(*keys).orderBy(F.unix_date(day))
    held = F.col(level) * (F.lead(F.unix_date(day)).over(order) - F.unix_date(day))
    rows = rows.withColumn("__held", held)
    past = F.sum("__held").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__integral", F.coalesce(past, F.lit(0)) + F.col(level))
    known = F.struct(F.col("__integral").alias("i"), F.col(level).alias("v"), F.unix_date(day).alias("d"))
    rows = rows.withColumn("__then", F.last(known).over(frame(keys, day, Window.unboundedPreceding, -k)))
    then = F.col("__then.i") + F.col("__then.v") * (F.unix_date(day) - k - F.col("__then.d"))
    mean = (F.col("__integral") - F.coalesce(then, F.lit(0))).cast("double") / days_in_frame(day, k, first).cast("double")
    return rows.withColumn(out, mean).drop("__held", "__integral", "__then")


def level_min(keys: Sequence[str], day: str, level: str, k: int) -> Column:
    """Least level of the last k days: of the rows in them and of what held on the first of them."""
    held = F.last(level).over(frame(keys, day, Window.unboundedPreceding, 1 - k))
    return F.least(held, F.min(level).over(frame(keys, day, 2 - k, 0)))


def flag_ahead(keys: Sequence[str], day: str, hit: Column, h: int, last: dt.date) -> Column:
    """1 where the predicate holds on any of the next h days, 0 where on none; NULL if they pass the last day.

    Today's state goes on tomorrow unless tomorrow has a row.
    """
    flag = F.when(hit, 1).otherwise(0)
    goes_on = F.when(F.count(F.lit(1)).over(frame(keys, day, 1, 1)) == 0, flag)
    found = F.greatest(F.max(flag).over(frame(keys, day, 1, h)), goes_on)
    return F.when(F.date_add(day, h) <= F.lit(last), found)
