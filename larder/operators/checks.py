"""Data-quality checks. Each returns a table; ``require_empty`` turns findings into a failure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import redact_json, redact_text
from larder.operators.joins import orphans
from larder.operators.joins import panel as dense_panel
from larder.operators.windows import share


def orphan_report(fact: DataFrame, dims: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """Number of distinct unknown keys per foreign key. A check is (name, key, dimension, its key)."""
    report = None
    for name, key, dim, dim_key in dims:
        line = orphans(fact, dim, key, dim_key).agg(F.count(F.lit(1)).alias("failures"))
        line = line.select(F.lit(name).alias("check"), "failures")
        report = line if report is None else report.unionByName(line)
    return report


def require_empty(report: DataFrame, failures: str = "failures") -> None:
    """Raise when any check of the report has failures; says how many there are and shows the first of them."""
    found = report.filter(F.col(failures) > 0)
    bad = found.limit(20).collect()
    if bad:
        raise AssertionError(f"{found.count()} failing checks, among them " + "; ".join(str(r.asDict()) for r in bad))


def both_classes(train: DataFrame, y: str = "shortage_within_30d") -> DataFrame:
    """Rows of each class, and whether both occur."""
    return train.agg(
        F.count_if(F.col(y) == 1).alias("positives"),
        F.count_if(F.col(y) == 0).alias("negatives"),
        ((F.count_if(F.col(y) == 1) > 0) & (F.count_if(F.col(y) == 0) > 0)).alias("both_present"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once. NULL keys are not compared, as in a unique constraint."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def expected_scale(spark: SparkSession, locations: int, items_per_location: int, days: int, orders: int, events: int) -> DataFrame:
    """Row counts a configuration should give."""
    rows = [
        ("locations", locations),
        ("positions", locations * items_per_location),
        ("inventory_daily", locations * items_per_location * days),
        ("orders", orders),
        ("supplier_events", events),
    ]
    return spark.createDataFrame(rows, "table_name string, expected bigint")


def scale_report(expected: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Actual beside expected counts."""
    actual = None
    for name, df in tables.items():
        line = df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("table_name"), "actual")
        actual = line if actual is None else actual.unionByName(line)
    return expected.join(actual, "table_name", "left").withColumn(
        "matches", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False))
    )


def panel_gaps(panel: DataFrame, keys: Sequence[str], start, end, day: str = "snapshot_date") -> DataFrame:
    """Days a key lacks between two dates. Row frames equal day frames only where this is empty."""
    wanted = dense_panel(panel.select(*keys).distinct(), start, end, day)
    return wanted.join(panel.select(*keys, day), [*keys, day], "left_anti")


def status_mix(position: DataFrame) -> DataFrame:
    return share(position, ["inventory_status"])


def provenance_check(metrics: DataFrame, synthetic_flag: str | None = None) -> DataFrame:
    """Metrics without a source, and generated ones among the public ones."""
    missing = F.col("source_url").isNull() | ~F.col("source_url").rlike("^https?://")
    mixed = F.col(synthetic_flag) if synthetic_flag else F.lit(False)
    return metrics.agg(
        F.count(F.lit(1)).alias("metrics"),
        F.count_if(missing).alias("without_source"),
        F.count_if(mixed).alias("synthetic"),
    )


def rule_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules in one pass. A rule is a condition that must hold; NULL fails."""
    one = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"__r{i}") for i, c in enumerate(rules.values())],
    )
    lines = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(f"__r{i}").alias("failures")) for i, n in enumerate(rules)]
    )
    return one.select(F.col("__rows").alias("rows"), F.explode(lines).alias("l")).select("l.rule", "rows", "l.failures")


def not_null(col: str) -> Column:
    return F.col(col).isNotNull()


def one_of(col: str, values: Sequence) -> Column:
    return F.col(col).isin(*values)


def between(col: str, low, high) -> Column:
    return F.col(col).between(low, high)


def redact_logs(logs: DataFrame, message: str = "message", extras: str | None = None) -> DataFrame:
    """Log lines with secrets blanked, in the text and in the JSON of extra fields."""
    out = logs.withColumn(message, redact_text(redact_json(message)))
    return out.withColumn(extras, redact_json(extras)) if extras else out
