"""Trailing and forward windows over a daily panel.

A panel has at most one row per key and day, so a window partition is bounded by the calendar (about
365 rows a year), however large the tables behind the panel are: a hot key is already reduced to its
daily totals by the map-side combine that builds the panel. For rows without that bound use
``larder.operators.scan``.

Frames count calendar days (``rangeBetween`` on the day number). ``rows=True`` counts rows instead;
both agree on a dense panel. All frames of one operator share a partitioning and an order, so Spark
plans one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def frame(keys: Sequence[str], day: str, first: int, last: int, rows: bool = False) -> WindowSpec:
    if rows:
        return Window.partitionBy(*keys).orderBy(day).rowsBetween(first, last)
    return Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(first, last)


def back(keys: Sequence[str], day: str, k: int, rows: bool = False) -> WindowSpec:
    """Today and the k − 1 days before it."""
    return frame(keys, day, -(k - 1), 0, rows)


def ahead(keys: Sequence[str], day: str, h: int, rows: bool = False) -> WindowSpec:
    """The next h days without today."""
    return frame(keys, day, 1, h, rows)


def _exact(col: str | Column, scale: int | None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col if scale is None else col.cast(f"decimal(18,{scale})")


def mean_over(col: str | Column, w: WindowSpec, scale: int | None = None) -> Column:
    """Mean in a frame. With ``scale`` the sum is exact, so row order cannot change the result."""
    if scale is None:
        return F.avg(col).over(w)
    x = _exact(col, scale)
    return F.sum(x).over(w).cast("double") / F.count(x).over(w).cast("double")


def std_over(col: str | Column, w: WindowSpec, scale: int | None = None) -> Column:
    """Population standard deviation in a frame; one row gives 0, not NULL."""
    if scale is None:
        return F.stddev_pop(col).over(w)
    x = _exact(col, scale)
    n = F.count(x).over(w).cast("double")
    total = F.sum(x).over(w).cast("double")
    squares = F.sum(x * x).over(w).cast("double")
    return F.sqrt(F.greatest(F.lit(0.0), n * squares - total * total)) / n


def trailing_avg(
    df: DataFrame, keys: Sequence[str], day: str, col: str, k: int, out: str, scale=None, rows=False
) -> DataFrame:
    return df.withColumn(out, mean_over(col, back(keys, day, k, rows), scale))


def trailing_std(
    df: DataFrame, keys: Sequence[str], day: str, col: str, k: int, out: str, scale=None, rows=False
) -> DataFrame:
    return df.withColumn(out, std_over(col, back(keys, day, k, rows), scale))


def trailing_min(df: DataFrame, keys: Sequence[str], day: str, col: str, k: int, out: str, rows=False) -> DataFrame:
    return df.withColumn(out, F.min(col).over(back(keys, day, k, rows)))


def future_flag(
    df: DataFrame, keys: Sequence[str], day: str, predicate: Column, h: int, out: str, rows=False
) -> DataFrame:
    """1 where the predicate holds on any of the next h days, 0 where on none, NULL without a next day."""
    hit = F.when(predicate, 1).otherwise(0)
    return df.withColumn(out, F.max(hit).over(ahead(keys, day, h, rows)))


def days_to_shortage(
    df: DataFrame, keys: Sequence[str], day: str, predicate: Column, h: int, out: str = "days_to_shortage"
) -> DataFrame:
    """Days until the predicate first holds within the next h days; NULL if it does not."""
    number = F.unix_date(day)
    first = F.min(F.when(predicate, number)).over(ahead(keys, day, h))
    return df.withColumn(out, first - number)


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Latest row of each group, all columns, as one aggregate with a map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("__latest")
    out = df.groupBy(*keys).agg(latest)
    return out.select(*keys, *[F.col(f"__latest.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_open(children: DataFrame, parent: str, order: Sequence[str], open_flag: str = "in_progress") -> DataFrame:
    """Latest child still open, per parent."""
    return latest_per(children.filter(F.col(open_flag)), [parent], order)


def share(df: DataFrame, by: Sequence[str], out: str = "share") -> DataFrame:
    """Row count of each group and its part of all rows. The total is one number, read by every task."""
    counts = df.groupBy(*by).count()
    return counts.withColumn(out, F.col("count") / counts.agg(F.sum("count")).scalar())
