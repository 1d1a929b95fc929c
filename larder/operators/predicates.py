"""Row filters that name their intent. Dates also prune a month-partitioned table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)


def _month(d: dt.date) -> Column:
    return F.lit(d.replace(day=1))


def publish(df: DataFrame, private: Sequence[str] = ()) -> DataFrame:
    """Drop the named columns and every column that starts with an underscore."""
    return df.drop(*private, *[c for c in df.columns if c.startswith("_")])


def at_date(df: DataFrame, col: str, as_of, month_col: str | None = None) -> DataFrame:
    """Rows of one date. With ``month_col`` the scan reads one partition only."""
    as_of = _date(as_of)
    if month_col:
        df = df.filter(F.col(month_col) == _month(as_of))
    return df.filter(F.col(col) == F.lit(as_of))


def trailing(
    df: DataFrame, col: str, as_of, days: int, month_col: str | None = None, upper: bool = False
) -> DataFrame:
    """Rows from ``days`` before the as-of date on; ``upper=True`` also stops at the as-of date."""
    as_of = _date(as_of)
    start = as_of - dt.timedelta(days=days)
    if month_col:
        df = df.filter(F.col(month_col) >= _month(start))
        if upper:
            df = df.filter(F.col(month_col) <= _month(as_of))
    df = df.filter(F.col(col) >= F.lit(start))
    return df.filter(F.col(col) <= F.lit(as_of)) if upper else df


def label_complete(
    df: DataFrame, col: str, as_of, horizon: int, month_col: str | None = None
) -> DataFrame:
    """Rows old enough for their whole forward horizon to be known."""
    cutoff = _date(as_of) - dt.timedelta(days=horizon)
    if month_col:
        df = df.filter(F.col(month_col) <= _month(cutoff))
    return df.filter(F.col(col) <= F.lit(cutoff))


def every_k_days(df: DataFrame, col: str, start, k: int = 7) -> DataFrame:
    """Every k-th day counted from ``start``, not from a calendar week."""
    return df.filter(F.pmod(F.datediff(F.col(col), F.lit(_date(start))), F.lit(k)) == 0)


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def drop_health_checks(logs: DataFrame, level: str = "INFO", message: str = "message") -> DataFrame:
    """Drop health-check GET lines unless the level asks for debugging detail."""
    if level.upper() in ("DEBUG", "NOTSET"):
        return logs
    noise = F.col(message).contains("/health") & F.col(message).contains("GET")
    return logs.filter(~F.coalesce(noise, F.lit(False)))


def any_of(df: DataFrame, **wanted) -> DataFrame:
    """Rows where any given column equals its wanted value; ``None`` values are not asked for."""
    condition = F.lit(False)
    for col, value in wanted.items():
        if value is not None:
            condition = condition | F.col(col).eqNullSafe(F.lit(value))
    return df.filter(condition)


def find_user(users: DataFrame, id=None, uuid=None, email=None) -> DataFrame:
    """The first user with this id, uuid or e-mail."""
    return any_of(users, id=id, uuid=uuid, email=email).orderBy("id").limit(1)
