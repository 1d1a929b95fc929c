"""Grouped measures. All use map-side combine; none holds the rows of a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(flag: Column | str) -> Column:
    """Mean of a boolean over its non-NULL rows, as one division of two exact counts."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    known = F.count(flag)
    return F.when(known > 0, F.count_if(flag).cast("double") / known.cast("double"))


def exact_mean(col: Column | str, scale: int = 0) -> Column:
    """Mean of whole numbers or decimals: exact sum, one division."""
    col = F.col(col) if isinstance(col, str) else col
    n = F.count(col)
    return F.when(n > 0, F.sum(col.cast(f"decimal(28,{scale})")).cast("double") / n.cast("double"))


def money(col: Column | str) -> Column:
    """Exact money total with two digits."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col.cast("decimal(18,2)")).cast("decimal(28,2)")


def group_count(df: DataFrame, by: Sequence[str], out: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def grouped(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column], sets: str = "plain") -> DataFrame:
    """Plain groups, or also their subtotals with ``rollup`` or ``cube``."""
    groups = {"plain": df.groupBy, "rollup": df.rollup, "cube": df.cube}[sets](*dims)
    return groups.agg(*aggs)


def progress(
    steps: DataFrame, by: Sequence[str], done: Column, error: Column
) -> DataFrame:
    """Done, failed and all steps per group, with the two flags a progress bar shows."""
    return steps.groupBy(*by).agg(
        F.count_if(done).alias("done"),
        F.count_if(error).alias("errors"),
        F.count(F.lit(1)).alias("total"),
        F.bool_and(F.coalesce(done, F.lit(False))).alias("all_done"),
        F.bool_or(F.coalesce(error, F.lit(False))).alias("any_error"),
    )


BLOCK_ROWS = 65_536


def _joined(order: str | Column, text: str | Column) -> Column:
    """Texts of a group in order, as one text; NULL texts are left out."""
    order, text = (F.col(c) if isinstance(c, str) else c for c in (order, text))
    piece = F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "")


def concat_deltas(
    df: DataFrame, keys: Sequence[str], seq: str, delta: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Join the deltas of each key in order of ``seq``."""
    rows = df.filter(F.col(delta).isNotNull())
    return fold_ordered(rows, keys, seq, texts={out: F.col(delta)}, block_rows=block_rows)


def fold_ordered(
    rows: DataFrame,
    keys: Sequence[str],
    seq: str,
    first: Mapping[str, tuple[Column, Column]] | None = None,
    last: Mapping[str, tuple[Column, Column]] | None = None,
    any_of: Mapping[str, Column] | None = None,
    texts: Mapping[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Fold ordered rows of each key: first and last values by a position, flags, joined texts.

    Two steps: blocks of the sequence first, then the blocks of a key. The tasks of the first step
    share a key with very many rows; the second step sees one row per block.
    """
    first, last, any_of, texts = (dict(x or {}) for x in (first, last, any_of, texts))
    step = [F.min_by(F.struct(v.alias("v")), at).alias(f"__v_{n}") for n, (v, at) in first.items()]
    step += [F.min(at).alias(f"__s_{n}") for n, (_, at) in first.items()]
    step += [F.max_by(F.struct(v.alias("v")), at).alias(f"__v_{n}") for n, (v, at) in last.items()]
    step += [F.max(at).alias(f"__s_{n}") for n, (_, at) in last.items()]
    step += [F.bool_or(c).alias(f"__v_{n}") for n, c in any_of.items()]
    step += [_joined(seq, c).alias(f"__v_{n}") for n, c in texts.items()]
    blocks = rows.groupBy(*keys, F.floor(F.col(seq) / F.lit(block_rows)).alias("__block")).agg(*step)
    whole = [F.min_by(f"__v_{n}", f"__s_{n}")["v"].alias(n) for n in first]
    whole += [F.max_by(f"__v_{n}", f"__s_{n}")["v"].alias(n) for n in last]
    whole += [F.bool_or(f"__v_{n}").alias(n) for n in any_of]
    whole += [_joined("__block", f"__v_{n}").alias(n) for n in texts]
    return blocks.groupBy(*keys).agg(*whole)
