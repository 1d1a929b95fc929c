"""Catalog tables, literal tables, generated ranges, and files."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.joins import panel

SECTION_SCHEMA = (
    "document string, document_file_path string, policy_reference_id string, policy_title string, "
    "section_id string, policy_type string, authority string, effective_date date, "
    "synthetic_policy boolean, applies_to string"
)
# The fields of a published figure.
METRIC_SCHEMA = T.StructType(
    [
        T.StructField("scope", T.StringType(), False),
        T.StructField("metric_name", T.StringType(), False),
        T.StructField("metric_value", T.DoubleType(), False),
        T.StructField("unit", T.StringType(), False),
        T.StructField("period", T.StringType(), False),
        T.StructField("source_url", T.StringType(), False),
        T.StructField("notes", T.StringType(), False),
    ]
)


def read_table(spark: SparkSession, name: str, folder: str | None = None, schema: str | None = None) -> DataFrame:
    """A catalog table or view by name, or the parquet file of that name in a folder."""
    if folder is None:
        return spark.table(name)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(os.path.join(folder, f"{name}.parquet"))


def ensure_schema(spark: SparkSession, name: str, use: bool = True) -> None:
    """Make a schema unless the catalog has it, and switch to it."""
    if not spark.catalog.databaseExists(name):
        spark.sql("CREATE SCHEMA IF NOT EXISTS IDENTIFIER(:name)", args={"name": name})
    if use:
        spark.catalog.setCurrentDatabase(name)


@dataclass(frozen=True)
class Layout:
    """How a stored table lies on disk: a folder per partition value, and in each a file per bucket of a key.

    Tables with the same buckets are joined, grouped and windowed by that key without an exchange.
    """

    partitions: tuple[str, ...] = ()
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0
    sort_by: tuple[str, ...] = ()

    def arranged(self, df: DataFrame) -> DataFrame:
        """Rows as the files need them: each bucket in one task, or else a rebalance that splits a large partition
        value over tasks and merges small ones by measured size."""
        if self.buckets:
            return df.repartition(self.buckets, *self.bucket_by)
        return df.hint("rebalance", *self.partitions) if self.partitions else df


def write_table(
    df: DataFrame, name: str, partition_by: Sequence[str] = (), comment: str = "", fmt: str = "parquet", layout: Layout | None = None
) -> None:
    """Put rows in the place of a table, whatever columns it had. ``layout`` takes the place of ``partition_by``."""
    layout = layout or Layout(tuple(partition_by))
    files = layout.arranged(df).write
    if layout.buckets:
        files = files.bucketBy(layout.buckets, *layout.bucket_by).sortBy(*(layout.sort_by or layout.bucket_by))
    files.saveAsTable(name, format=fmt, mode="overwrite", partitionBy=list(layout.partitions) or None)
    if comment:
        describe_table(df.sparkSession, name, comment)


def describe_table(spark: SparkSession, name: str, comment: str) -> None:
    """Keep a comment with a table, as its property of that name."""
    quoted = comment.translate({ord("\\"): "\\\\", ord("'"): "\\'"})
    spark.sql(f"ALTER TABLE IDENTIFIER(:name) SET TBLPROPERTIES ('comment' = '{quoted}')", args={"name": name})


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that occur in the rows; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def drop_known(spark: SparkSession, schema: str, names: Sequence[str]) -> list[str]:
    """Drop the named tables that a schema has, and nothing else; gives the names of those that went."""
    there = {t.name for t in spark.catalog.listTables(schema) if not t.isTemporary}
    gone = [n for n in names if n in there]
    for name in gone:
        spark.sql("DROP TABLE IDENTIFIER(:name)", args={"name": f"{schema}.{name}"})
    return gone


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, as one job."""
    out = None
    for name, df in tables.items():
        line = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = line if out is None else out.unionByName(line)
    return out


def list_tables(spark: SparkSession, schema: str | None = None, views: bool = False) -> DataFrame:
    """Tables of a schema; ``views=True`` adds the session's temporary views."""
    listed = [t for t in spark.catalog.listTables(schema) if views or not t.isTemporary]
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in listed]
    return spark.createDataFrame(rows, "table_name string, kind string, temporary boolean").orderBy("table_name")


def table_sizes(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Files, bytes and megabytes of each table's folder or file, largest first. Contents are not read."""
    out = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        line = files.select("path", "length").agg(
            F.count("path").alias("files"), F.coalesce(F.sum("length"), F.lit(0).cast("bigint")).alias("bytes")
        ).select(F.lit(name).alias("table_name"), "files", "bytes")
        out = line if out is None else out.unionByName(line)
    megabytes = F.round(F.col("bytes") / F.lit(1024.0 * 1024.0), 2)
    return out.withColumn("megabytes", megabytes).orderBy(F.desc("bytes"), "table_name")


def literal_table(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """A small lookup table written in the program; types follow the values.

    Arrow input makes it part of the plan (a local relation), not a job of its own.
    """
    columns = list(zip(*rows))
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=list(names)))


def reference_metrics(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Published figures with their source. No field may be missing."""
    return spark.createDataFrame([tuple(r) for r in rows], METRIC_SCHEMA)


def number_range(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def date_spine(spark: SparkSession, start: dt.date, days: int, name: str = "snapshot_date") -> DataFrame:
    one = spark.range(1).drop("id")
    return panel(one, start, start + dt.timedelta(days=days - 1), name)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Rule sections from quoted CSV with a header; a row is one unit of retrieval."""
    return spark.read.schema(SECTION_SCHEMA).option("header", True).option("multiLine", True).option(
        "escape", '"'
    ).csv(path)


REQUEST_FIELDS = (
    "user_email", "thread_id", "run_id", "message_index", "outcome", "total_duration_s", "ttft_s", "http_status",
    "error_detail",
)


def write_requests_csv(df: DataFrame, path: str) -> None:
    """Request results as CSV: durations with four decimals, a missing value as an empty field."""
    seconds = {c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", c)) for c in ("total_duration_s", "ttft_s")}
    df.withColumns(seconds).select(*REQUEST_FIELDS).write.mode("overwrite").option("header", True).option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)
