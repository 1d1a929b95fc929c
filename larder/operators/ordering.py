"""Sorts, limits and top-k. Every limit ends in a total order, so ties cannot change the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sort_columns(spec: Sequence[str | Column]) -> list[Column]:
    """``"x"`` ascending, ``"-x"`` descending."""
    return [
        s if isinstance(s, Column) else F.desc(s[1:]) if s.startswith("-") else F.asc(s) for s in spec
    ]


def top_n(df: DataFrame, spec: Sequence[str | Column], n: int) -> DataFrame:
    """``orderBy`` + ``limit``: each task keeps n rows, only those meet."""
    return df.orderBy(*sort_columns(spec)).limit(n)


def order_desc(df: DataFrame, col: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(col), *[F.asc(t) for t in ties])


def first_row(df: DataFrame, spec: Sequence[str | Column]) -> DataFrame:
    return top_n(df, spec, 1)


def cap_rows(df: DataFrame, n: int, spec: Sequence[str | Column] = ()) -> DataFrame:
    return top_n(df, spec, n) if spec else df.limit(n)


def top_per(df: DataFrame, keys: Sequence[str], spec: Sequence[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group. The rank filter is pushed below the shuffle by Catalyst
    (a window group limit), so a hot group sends n rows per task and no more."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort_columns(spec))))
    return ranked.filter(F.col(rank) <= n)


def page(df: DataFrame, spec: Sequence[str | Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """Offset pagination; a page has as many rows as asked for. Deep pages: use ``page_after``."""
    return df.orderBy(*sort_columns(spec)).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, last, limit: int = 100) -> DataFrame:
    """Keyset pagination: the page after a key. Its cost does not grow with the page number."""
    if last is not None:
        df = df.filter(F.col(key) > F.lit(last))
    return df.orderBy(key).limit(limit)


def newest_chats(chats: DataFrame, created: str = "created_at", key: str = "chat_id") -> DataFrame:
    return chats.orderBy(F.desc(created), F.asc(key))


def transcript_order(df: DataFrame) -> DataFrame:
    """Messages by time, each followed by its tool rows, then its reasoning rows, those by time."""
    return df.orderBy("message_ts", "message_id", "kind", "child_ts", "id")
