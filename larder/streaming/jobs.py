"""Streaming jobs built from Spark's own operators. Each function also runs on a batch DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.scalars import round_to
from larder.operators.features import PANEL, PanelSpec, rolling_features
from larder.operators.ordering import top_per
from larder.operators.requests import user_sessions
from larder.sources.tables import overwrite_partitions


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 200) -> DataFrame:
    """A file stream with a bound on each micro-batch. The jobs with state of their own sort the rows of
    a key inside a micro-batch, so the bound also holds for a key that has most of the rows."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def _seconds(text: str) -> int:
    """``"30 minutes"`` → 1800."""
    number, unit = text.split()
    return int(dt.timedelta(**{unit.rstrip("s") + "s": int(number)}).total_seconds())


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is, and give what it wrote under ``folder``.

    In the complete mode each micro-batch replaces the result, else it adds to it.
    """
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_dedup(
    messages: DataFrame, delay: str = "10 minutes", keys: Sequence[str] = ("chat_id", "message_id"), ts: str = "ts"
) -> DataFrame:
    """First of each key; state is dropped once the watermark has passed a key."""
    if not messages.isStreaming:
        return messages.dropDuplicates(list(keys))
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_request_rates(
    requests: DataFrame, window: str = "1 minute", delay: str = "5 minutes", ts: str = "ts"
) -> DataFrame:
    """Requests, errors, mean and approximate 90th percentile of latency per time window."""
    rows = requests.withWatermark(ts, delay) if requests.isStreaming else requests
    n = F.count(F.lit(1))
    mean = F.sum(F.col("duration_s").cast("decimal(18,6)")).cast("double") / n.cast("double")
    return (
        rows.groupBy(F.window(ts, window).alias("w"))
        .agg(
            n.alias("requests"),
            F.count_if(F.col("outcome") != "finished").alias("errors"),
            round_to(mean, 6).alias("mean_s"),
            F.percentile_approx("duration_s", 0.9).alias("approx_p90_s"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "requests",
            "errors",
            (F.col("errors").cast("double") / F.col("requests").cast("double")).alias("error_rate"),
            "mean_s",
            "approx_p90_s",
        )
    )


def stream_sessions(
    events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", user: str = "user_id", ts: str = "ts"
) -> DataFrame:
    """Runs of a user's events without a longer pause."""
    if not events.isStreaming:
        return user_sessions(events, _seconds(gap), user, ts)
    return (
        events.withWatermark(ts, delay)
        .groupBy(user, F.session_window(ts, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("events"), F.min(ts).alias("first_event"), F.max(ts).alias("last_event"))
        .select(user, "first_event", "last_event", "events")
    )


def refresh_batch(
    batch: DataFrame,
    history: Callable[[], DataFrame],
    write: Callable[[DataFrame], None],
    spec: PanelSpec = PANEL,
) -> None:
    """Recompute the feature rows that new inventory days change, and hand them to ``write``.

    A day changes its own features and those of the next 29 days. Only the touched positions and
    their last days are read from the history.
    """
    keys = list(spec.keys)
    span = batch.agg(F.min(spec.day).alias("a"), F.max(spec.day).alias("b")).first()
    if span["a"] is None:
        return
    reach = dt.timedelta(days=29)
    touched = batch.select(*keys).distinct()
    rows = history().filter(
        (F.col(spec.day) >= F.lit(span["a"] - reach)) & (F.col(spec.day) <= F.lit(span["b"] + reach))
    )
    rows = rows.join(touched, keys, "left_semi")
    changed = rolling_features(rows, spec, first=span["a"], last=span["b"] + reach)
    write(changed)


def stream_feature_refresh(inventory, history, write, checkpoint: str, spec: PanelSpec = PANEL):
    """Start the refresh of features from a stream of inventory rows; returns the streaming query.

    ``history`` gives the stored panel with the new rows in it; ``write`` gets the feature rows of a batch and the batch's
    number. A batch that failed half-way comes again with its number, so ``write`` must replace what that number has
    left, as :func:`write_refresh` does.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        refresh_batch(batch, history, lambda rows: write(rows, number), spec)

    return inventory.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_refresh(rows: DataFrame, path: str, number: int) -> None:
    """Store the rows of a batch under its number, in place of any that an earlier try has left there."""
    overwrite_partitions(rows.withColumn("refresh", F.lit(number).cast("bigint")), path, ["refresh"])


def read_refreshed(refreshed: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """One row for each key and day of what :func:`write_refresh` has stored: that of the newest batch."""
    return top_per(refreshed, [*spec.keys, spec.day], ["-refresh"], 1).drop("rank", "refresh")


def stream_status_alerts(inventory: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Positions whose status crosses the minimum, one row per crossing.

    State per position is its last side and time. Rows of a position are taken in time order inside a
    micro-batch; a row older than the state is handed on with ``late`` set and changes nothing.
    """
    from larder.streaming.stateful import ALERT_SCHEMA, ALERT_STATE, cross_minimum

    rows = inventory.withWatermark(ts, delay).select(
        "location_id",
        "item_id",
        F.col(ts).alias("ts"),
        F.col("days_of_supply").cast("double").alias("days_of_supply"),
        F.col("minimum_days_supply").cast("int").alias("minimum_days_supply"),
    )
    return rows.groupBy("location_id", "item_id").applyInPandasWithState(
        cross_minimum, ALERT_SCHEMA, ALERT_STATE, "append", "NoTimeout"
    )


def stream_messages(
    events: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes", keep: str = "1 day", arrived: str | None = None
) -> DataFrame:
    """Resolve a stream of run events; group the rows with the ``assemble_*`` functions on read.

    State per chat is what is active now and the ids of its messages, never their text.
    ``late`` marks events that come after their run was closed for idleness; a chat is forgotten when
    nothing came for ``keep`` after that. What counts is when events arrive: the column ``arrived``
    where the source gives one, which then must not go back, else the time of the micro-batch. An
    event's own time may be as old as it likes, so that no event is behind the watermark and lost.
    """
    from larder.streaming.stateful import CHAT_STATE, RESOLVED_SCHEMA, make_resolver

    return (
        events.withColumn("arrived", F.col(arrived) if arrived else F.current_timestamp())
        .withWatermark("arrived", delay)
        .groupBy("chat_id")
        .applyInPandasWithState(
            make_resolver(_seconds(idle), _seconds(keep)), RESOLVED_SCHEMA, CHAT_STATE, "append", "EventTimeTimeout"
        )
    )
