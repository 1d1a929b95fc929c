"""Registered queries that run the streaming jobs over files, to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import conversations as cv
from larder.operators import features as ft
from larder.plans import model as m
from larder.plans.registry import query
from larder.session import scratch_folder
from larder.streaming import jobs as sj

#: Longer than any table, where the whole of it is to be one horizon.
ALL_TIME = "36500 days"
#: Turns of conversations whose events are one file of a stream.
FILE_TURNS = 10_000


def _streamed(df: DataFrame, folder: str) -> DataFrame:
    """The rows as files, read back as a stream."""
    df.write.parquet(folder)
    return sj.read_events(df.sparkSession, folder, df.schema)


def _events(spark: SparkSession, d: str) -> DataFrame:
    events = sj.read_events(spark, f"{d}/events.parquet", m.SCHEMAS["events"])
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_time(*names: str) -> dict:
    return {n: F.to_utc_timestamp(n, F.current_timezone()).cast("timestamp_ntz") for n in names}


@query("streamed_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    rows = _events(spark, d).select("user_id", "event_type", "ts")
    return sj.drain(sj.stream_dedup(rows, ALL_TIME, ["user_id", "event_type"]), scratch_folder(spark, "streamed-dedup")).drop("ts")


@query(
    "streamed_request_rates",
    """SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS requests,
    count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL""",
)
def _(spark, d):
    rows = _events(spark, d).select("ts", F.col("value").alias("duration_s"), F.when(F.col("event_type") == "error", "error").otherwise("finished").alias("outcome"))
    out = sj.drain(sj.stream_request_rates(rows, "1 hour", ALL_TIME), scratch_folder(spark, "streamed-rates"), "complete")
    return out.withColumns(_plain_time("window_start", "window_end")).select("window_start", "window_end", "requests", "errors")


@query(
    "streamed_sessions",
    """SELECT user_id, min(ts) AS first_event, max(ts) AS last_event, count(*) AS events
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
        FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, session""",
)
def _(spark, d):
    out = sj.drain(sj.stream_sessions(_events(spark, d), "6 hours", ALL_TIME), scratch_folder(spark, "streamed-sessions"), "complete")
    return out.withColumns(_plain_time("first_event", "last_event"))


@query(
    "streamed_status_alerts",
    """SELECT location_id, item_id, CAST(snapshot_date AS TIMESTAMP) AS ts, CASE WHEN below THEN 'BELOW_MINIMUM' ELSE 'RECOVERED' END AS alert
    FROM (SELECT *, days_of_supply < minimum_days_supply AS below, coalesce(lag(days_of_supply < minimum_days_supply)
        OVER (PARTITION BY location_id, item_id ORDER BY snapshot_date), false) AS before FROM inv) WHERE below <> before""",
)
def _(spark, d):
    folder = scratch_folder(spark, "streamed-alerts")
    stock = m.inventory(spark, d).select("location_id", "item_id", F.col("snapshot_date").cast("timestamp").alias("ts"), "days_of_supply", "minimum_days_supply")
    out = sj.drain(sj.stream_status_alerts(_streamed(stock, f"{folder}/in"), ALL_TIME), folder)
    return out.filter("not late").withColumns(_plain_time("ts")).select("location_id", "item_id", "ts", "alert")


@query(
    "streamed_messages",
    "SELECT CAST(chat_id AS VARCHAR) AS chat_id, message_id, role, content, false AS in_progress FROM msg",
)
def _(spark, d):
    """A chat's events lie in one file, so that no micro-batch gets later ones first."""
    folder = scratch_folder(spark, "streamed-messages")
    files = max(1, -(-m.table(spark, d, "conversations").count() // FILE_TURNS))
    resolved = sj.drain(sj.stream_messages(_streamed(m.run_events(spark, d, files), f"{folder}/in")), folder)
    return cv.assemble_messages(resolved.filter("not late").drop("late")).select("chat_id", "message_id", "role", "content", "in_progress")


@query(
    "refreshed_features",
    f"""SELECT location_id, item_id, snapshot_date, min_days_of_supply_30d FROM feat
    WHERE snapshot_date >= DATE '{m.AS_OF}' - 3 AND location_id IN (SELECT location_id FROM loc WHERE location_index % 2 = 0)""",
)
def _(spark, d):
    """A stored panel, of which the last days of every other location come again as new rows."""
    folder = scratch_folder(spark, "refreshed-features")
    columns = ["location_id", "item_id", "snapshot_date", "daily_demand_units", "days_of_supply", "minimum_days_supply", "on_order_units"]
    stock = m.inventory(spark, d).select(*columns)
    stock.write.parquet(f"{folder}/panel")
    panel = spark.read.schema(stock.schema).parquet(f"{folder}/panel")
    some = m.locations(spark, d).filter("location_index % 2 = 0").select("location_id")
    new = panel.filter(F.col("snapshot_date") >= F.date_sub(F.lit(m.AS_OF), 3)).join(some, "location_id")
    job = sj.stream_feature_refresh(
        _streamed(new, f"{folder}/in"), lambda: panel, lambda rows, number: sj.write_refresh(rows, f"{folder}/out", number), f"{folder}/state", ft.PANEL
    )
    job.awaitTermination()
    return sj.read_refreshed(spark.read.parquet(f"{folder}/out")).select("location_id", "item_id", "snapshot_date", "min_days_of_supply_30d")
