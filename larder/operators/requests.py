"""Request outcomes, latency statistics and throughput."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.scalars import round_to
from larder.operators.scan import attach, exact_percentiles

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def seconds_between(later: str, earlier: str) -> Column:
    """Elapsed seconds with microseconds, for timestamps with or without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {earlier}, {later})").cast("double") / F.lit(1_000_000.0)


def latency_summary(
    requests: DataFrame,
    col: str = "duration_s",
    by: Sequence[str] = (),
    probs: Mapping[str, float] = PERCENTILES,
    approximate: bool = False,
    digits: int = 6,
) -> DataFrame:
    """Least, interpolated percentiles, greatest and mean.

    The exact percentiles count equal values and rank the counts in blocks; the approximate ones are
    one pass with a sketch of fixed size and are not interpolated.
    """
    by = list(by)
    n = F.count(col)
    mean = F.sum(F.col(col).cast("decimal(28,6)")).cast("double") / n.cast("double")
    basic = [
        n.alias("requests"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        round_to(F.when(n > 0, mean), digits).alias("mean"),
    ]
    if approximate:
        sketches = [F.percentile_approx(col, p, 10_000).alias(name) for name, p in probs.items()]
        return requests.groupBy(*by).agg(*basic, *sketches)
    whole = requests.groupBy(*by).agg(*basic)
    return attach(whole, exact_percentiles(requests, col, probs, by, digits), by, list(probs))


def outcomes(requests: DataFrame) -> DataFrame:
    return requests.groupBy("outcome").count().orderBy("outcome")


def throughput(requests: DataFrame, start: str = "started_at", end: str = "ended_at") -> DataFrame:
    """Totals and requests per second of wall time; NULL rate when no time passes."""
    totals = requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("outcome") == "finished").alias("finished"),
        F.count_if(F.col("outcome") != "finished").alias("failed"),
        F.min(start).alias("first"),
        F.max(end).alias("last"),
    )
    wall = seconds_between("last", "first")
    return totals.select(
        "requests",
        "finished",
        "failed",
        wall.alias("wall_s"),
        round_to(F.when(wall > 0, F.col("requests").cast("double") / wall), 9).alias("requests_per_s"),
    )


def span_stats(
    spans: DataFrame,
    by: Sequence[str] = ("name", "success"),
    col: str = "duration_s",
    low: float = 0.0,
    high: float = 100.0,
    buckets: int = 10,
) -> DataFrame:
    """Histogram of durations per function and result: rows and total time per bucket.

    Bucket 0 lies below ``low``, the last one at or above ``high``.
    """
    bucket = F.expr(f"width_bucket(cast({col} as double), {low}D, {high}D, {buckets})")
    return spans.groupBy(*by, bucket.cast("int").alias("bucket")).agg(
        F.count(F.lit(1)).alias("spans"),
        F.sum(F.col(col).cast("decimal(18,6)")).cast("double").alias("total_s"),
    )


def error_samples(
    requests: DataFrame, order: Sequence[str], n: int = 5, width: int = 200, detail: str = "error_detail"
) -> DataFrame:
    """First failed requests with their detail cut to a line's width."""
    failed = requests.filter(F.col(detail).isNotNull() & (F.col(detail) != ""))
    return failed.orderBy(*order).limit(n).withColumn(detail, F.substring(detail, 1, width))


def run_outcomes(events: DataFrame, keys: Sequence[str] = ("chat_id", "run_id")) -> DataFrame:
    """Outcome of each run from its terminal events; the first one counts, as it ends the reading. The error text is whole.

    Events have ``seq``, ``ts``, ``type``, ``error_message`` and ``http_status``. A status of 400 or
    more, a time-out or an exception is reported by an event of its own.
    """
    terminal = F.col("type").isin("RUN_FINISHED", "RUN_ERROR", "HTTP_ERROR", "TIMEOUT", "EXCEPTION")
    at = F.when(terminal, F.col("seq"))
    runs = events.groupBy(*keys).agg(
        F.min_by("type", at).alias("__last"),
        F.min_by("error_message", at).alias("__detail"),
        F.max("http_status").alias("http_status"),
        F.min("ts").alias("__start"),
        F.coalesce(F.min(F.when(terminal, F.col("ts"))), F.max("ts")).alias("__end"),
        F.min(F.when(F.col("type") == "TEXT_MESSAGE_CONTENT", F.col("ts"))).alias("__token"),
    )
    last = F.col("__last")
    outcome = (
        F.when((F.col("http_status") >= 400) | (last == "HTTP_ERROR"), "http_error")
        .when(last == "RUN_FINISHED", "finished")
        .when(last == "RUN_ERROR", "error")
        .when(last == "TIMEOUT", "timeout")
        .when(last == "EXCEPTION", "exception")
        .otherwise("incomplete")
    )
    ttft = F.when(F.col("__token") <= F.col("__end"), seconds_between("__token", "__start"))
    return runs.select(
        *keys,
        outcome.alias("outcome"),
        seconds_between("__end", "__start").alias("total_duration_s"),
        ttft.alias("ttft_s"),
        F.when(outcome != "finished", F.col("__detail")).alias("error_detail"),
        "http_status",
    )


def time_to_first_token(
    events: DataFrame, keys: Sequence[str], token_type: str = "TEXT_MESSAGE_CONTENT", kind: str = "type"
) -> DataFrame:
    """Seconds from the first event of a run to its first text; NULL without text."""
    times = events.groupBy(*keys).agg(
        F.min("ts").alias("started"), F.min(F.when(F.col(kind) == token_type, F.col("ts"))).alias("first_text")
    )
    return times.select(*keys, seconds_between("first_text", "started").alias("ttft_s"))


def load_report(requests: DataFrame, duration: str = "duration_s", ttft: str | None = None) -> DataFrame:
    """Latency of all requests, of the finished ones, and of first tokens where they are known."""
    rows = {
        "total_duration_all": requests,
        "total_duration_finished": requests.filter(F.col("outcome") == "finished"),
    }
    report = None
    if ttft:
        rows["time_to_first_token"] = requests.filter(F.col(ttft).isNotNull())
    for label, part in rows.items():
        col = ttft if label == "time_to_first_token" else duration
        line = latency_summary(part, col).select(F.lit(label).alias("metric"), "*")
        report = line if report is None else report.unionByName(line)
    return report


def user_sessions(events: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of a user's events without a pause longer than the gap.

    Events of one time slot as long as the gap are in one session anyway, so they are combined before
    the shuffle; the window then sees one row per user and slot, which the calendar bounds.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")
    slots = (
        events.groupBy(user, F.floor(micros / F.lit(gap_seconds * 1_000_000)).alias("__slot"))
        .agg(
            F.min(ts).alias("first_event"),
            F.max(ts).alias("last_event"),
            F.min(micros).alias("__from"),
            F.max(micros).alias("__to"),
            F.count(F.lit(1)).alias("events"),
        )
    )
    order = Window.partitionBy(user).orderBy("__slot")
    pause = F.col("__from") - F.lag("__to").over(order)
    fresh = F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = slots.withColumn("__fresh", fresh).withColumn("__session", F.sum("__fresh").over(so_far))
    return (
        numbered.groupBy(user, "__session")
        .agg(
            F.min("first_event").alias("first_event"),
            F.max("last_event").alias("last_event"),
            F.sum("events").alias("events"),
        )
        .drop("__session")
    )
