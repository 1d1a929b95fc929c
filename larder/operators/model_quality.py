"""Model quality, calibration and drift measures, whole or per group.

Scores are counted per distinct value first (map-side combine), and ranks come from
``running_totals``, so no measure sorts a whole group, or the whole table, in one task. Counts stay
exact; each measure ends in one division and a fixed number of digits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.scalars import round_to
from larder.operators.aggregates import rate
from larder.operators.scan import running_totals
from larder.operators.windows import share

DIGITS = 9
BIG = "decimal(38,0)"


def _score_counts(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(p).cast("double").alias("__score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("__pos"), F.count(F.lit(1)).alias("__all")
    )


def _ranked(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    """Distinct scores with their counts, the counts below them, and the totals of the group."""
    below, whole = {"__pos_below": "__pos", "__all_below": "__all"}, {"__positives": "__pos", "__total": "__all"}
    return running_totals(_score_counts(df, y, p, by), by, "__score", below, whole)


def _roc() -> Column:
    neg = F.col("__all") - F.col("__pos")
    neg_below = F.col("__all_below") - F.col("__pos_below")
    wins = F.sum(F.col("__pos").cast("decimal(18,0)") * (2 * neg_below + neg).cast("decimal(20,0)"))
    p_total, n_total = F.max("__positives"), F.max("__total")
    pairs = 2.0 * p_total.cast("double") * (n_total - p_total).cast("double")
    return round_to(F.when(pairs > 0, wins.cast("double") / pairs), DIGITS)


def _pr() -> Column:
    pos_from = (F.col("__positives") - F.col("__pos_below")).cast("double")
    all_from = (F.col("__total") - F.col("__all_below")).cast("double")
    term = (F.col("__pos").cast("double") * pos_from / all_from).cast("decimal(38,15)")
    total = F.max("__positives").cast("double")
    return round_to(F.when(total > 0, F.sum(term).cast("double") / total), DIGITS)


def _loss(score: Column, eps: float) -> tuple[Column, Column]:
    """Loss of a positive and of a negative with this score, clipped."""
    q = F.least(F.lit(1.0 - eps), F.greatest(F.lit(eps), score))
    return -F.log(q), -F.log(1.0 - q)


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums; tied scores count half. NULL with one class only."""
    return _ranked(df, y, p, by).groupBy(*by).agg(_roc().alias("roc_auc"))


def pr_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the positives found there."""
    return _ranked(df, y, p, by).groupBy(*by).agg(_pr().alias("pr_auc"))


def all_measures(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    """Rows, positives, log loss and both areas per group, from one pass over the rows."""
    if_pos, if_neg = _loss(F.col("__score"), eps)
    neg = F.col("__all") - F.col("__pos")

    def total(count: Column, loss: Column) -> Column:
        return F.sum((count.cast("decimal(18,0)") * loss.cast("decimal(18,12)")).cast("decimal(38,12)"))

    loss = (total(F.col("__pos"), if_pos) + total(neg, if_neg)).cast("double") / F.max("__total").cast("double")
    return _ranked(df, y, p, by).groupBy(*by).agg(
        F.max("__total").alias("rows"),
        F.max("__positives").alias("positives"),
        round_to(loss, DIGITS).alias("log_loss"),
        _roc().alias("roc_auc"),
        _pr().alias("pr_auc"),
    )


def log_loss_of(y: Column | str, p: Column | str, eps: float = 1e-15) -> Column:
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    if_pos, if_neg = _loss((F.col(p) if isinstance(p, str) else p).cast("double"), eps)
    loss = y * if_pos + (1.0 - y) * if_neg
    return round_to(F.sum(loss.cast("decimal(28,12)")).cast("double") / F.count(loss).cast("double"), DIGITS)


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log likelihood with clipped scores."""
    return df.groupBy(*by).agg(log_loss_of(y, p, eps).alias("log_loss"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Per score bin: rows, mean score, observed rate, and the bin's part of the calibration error.

    ``ece_part`` adds up to the expected calibration error of the group.
    """
    binned = df.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int"))
    n = F.count(F.lit(1))
    table = binned.groupBy(*by, "bin").agg(
        n.alias("rows"),
        (F.sum(F.col(p).cast("decimal(28,12)")).cast("double") / n.cast("double")).alias("__mean"),
        (F.sum(F.col(y).cast("bigint")).cast("double") / n.cast("double")).alias("__rate"),
    )
    group = F.sum("rows").over(Window.partitionBy(*by)).cast("double")
    part = F.col("rows").cast("double") / group * F.abs(F.col("__mean") - F.col("__rate"))
    return table.select(
        *by,
        "bin",
        "rows",
        round_to("__mean", DIGITS).alias("mean_predicted"),
        round_to("__rate", DIGITS).alias("observed_rate"),
        round_to(part, DIGITS).alias("ece_part"),
    )


def fold_of(day: str, cuts: Sequence[dt.date], gap_days: int = 30) -> Column:
    """Fold number of a day: fold i tests the days from cut i on, up to the label gap before cut i+1.

    NULL for days before the first cut and for days inside a gap.
    """
    out = F.lit(None).cast("int")
    for i, cut in enumerate(cuts):
        end = cuts[i + 1] - dt.timedelta(days=gap_days) if i + 1 < len(cuts) else None
        inside = F.col(day) >= F.lit(cut)
        if end is not None:
            inside = inside & (F.col(day) < F.lit(end))
        out = F.when(inside, F.lit(i + 1)).otherwise(out)
    return out


def backtest(
    df: DataFrame, y: str, p: str, cuts: Sequence[dt.date], gap_days: int = 30, day: str = "snapshot_date"
) -> DataFrame:
    """All measures per chronological fold; the last fold is the holdout."""
    folds = df.withColumn("fold", fold_of(day, cuts, gap_days)).filter(F.col("fold").isNotNull())
    return all_measures(folds, y, p, ["fold"])


def monthly_prevalence(train: DataFrame, y: str = "shortage_within_30d", day: str = "snapshot_date") -> DataFrame:
    return train.groupBy(F.trunc(day, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(y).cast("bigint")).alias("positives"),
        rate(F.col(y) == 1).alias("prevalence"),
    )


def ramp_test(monthly: DataFrame, last: int = 3) -> DataFrame:
    """Does prevalence climb at the end? Rising months among the last ones, and their ratio to before."""
    order = Window.orderBy("month")
    newest = Window.orderBy(F.desc("month"))
    rows = monthly.withColumns(
        {
            "__rise": F.col("prevalence") > F.lag("prevalence").over(order),
            "__recent": F.row_number().over(newest) <= last,
        }
    )

    def pooled(recent: bool) -> Column:
        keep = F.col("__recent") if recent else ~F.col("__recent")
        return F.sum(F.when(keep, F.col("positives"))).cast("double") / F.sum(
            F.when(keep, F.col("rows"))
        ).cast("double")

    now, before = pooled(True), pooled(False)
    rising = F.count_if(F.col("__recent") & F.col("__rise"))
    return rows.agg(
        rising.alias("rising_months"),
        (rising == last).alias("strictly_rising"),
        now.alias("recent_prevalence"),
        before.alias("historical_prevalence"),
        round_to(F.when(before > 0, now / before), DIGITS).alias("ratio"),
    )


def window_compare(
    train: DataFrame,
    measures: Sequence[str],
    n: int = 3,
    y: str = "shortage_within_30d",
    day: str = "snapshot_date",
) -> DataFrame:
    """Early, middle and late part of the history side by side, all rows and positives alone.

    The parts have equal numbers of dates; the window that makes them sees distinct dates only.
    """
    dates = train.select(day).distinct().withColumn("part", F.ntile(n).over(Window.orderBy(day)))
    rows = train.join(F.broadcast(dates), day)  # one row per calendar day at most
    positive = F.col(y) == 1

    def mean(c: Column) -> Column:
        n_rows = F.count(c)
        exact = F.sum(c.cast("decimal(28,9)")).cast("double") / n_rows.cast("double")
        return round_to(F.when(n_rows > 0, exact), 6)

    return rows.groupBy("part").agg(
        F.min(day).alias("first_date"),
        F.max(day).alias("last_date"),
        F.count(F.lit(1)).alias("rows"),
        rate(positive).alias("prevalence"),
        *[mean(F.col(m).cast("double")).alias(f"avg_{m}") for m in measures],
        *[mean(F.when(positive, F.col(m).cast("double"))).alias(f"positive_avg_{m}") for m in measures],
    )


def target_balance(train: DataFrame, y: str = "shortage_within_30d") -> DataFrame:
    return share(train, [y])


def psi(base: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index per column between two windows.

    Bins hold equal parts of the base: they begin at the smallest values whose share of smaller ones reaches the next
    part, so that no single value makes all bins but one empty. Smaller values than any fall in the first bin. Bin parts
    are floored, so an empty bin gives a large but finite score.
    """

    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
        return df.select(F.explode(pairs).alias("e")).select("e.feature", "e.x", F.lit(side).alias("side")).filter(
            F.col("x").isNotNull()
        )

    values = long(base, "base").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(values, ["feature"], "x", {"before": "n"}, {"total": "n"})
    bin_of = F.floor(F.col("before") * bins / F.col("total"))
    edges = placed.groupBy("feature", bin_of.alias("part")).agg(F.min("x").alias("edge"))
    edges = edges.groupBy("feature").agg(F.collect_list("edge").alias("edges"))  # one row per feature
    rows = long(base, "base").unionByName(long(current, "current")).join(F.broadcast(edges), "feature")
    slot = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e <= F.col("x")))).cast("int")
    counted = rows.groupBy("feature", slot.alias("bin")).agg(
        F.count_if(F.col("side") == "base").alias("b"), F.count_if(F.col("side") == "current").alias("c")
    )
    whole = Window.partitionBy("feature")

    def part(c: str) -> Column:
        return F.greatest(F.lit(floor), F.col(c).cast("double") / F.sum(c).over(whole).cast("double"))

    parts = counted.select("feature", part("b").alias("pb"), part("c").alias("pc"))
    term = ((F.col("pc") - F.col("pb")) * F.log(F.col("pc") / F.col("pb"))).cast("decimal(28,15)")
    return parts.groupBy("feature").agg(round_to(F.sum(term), 6).alias("psi"))


#: Accuracy of a profile's sketch: shares are right to about 0.1 % of the rows, in some 100 KB.
SKETCH_K = 4096
#: A profile is read at so many evenly spaced ranks, the middles of as many equal parts.
RANKS = 1000


def value_profile(df: DataFrame, cols: Sequence[str], day: str = "snapshot_date", period: str = "month", k: int = SKETCH_K) -> DataFrame:
    """One row per column and period: rows, missing values, least and greatest value, and a quantile sketch.

    Profiles are small, are written once per period, and merge into those of any longer window (``merged_profile``), so
    windows are compared without the rows. NaN counts as missing; a period with nothing else has no sketch.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.trunc(day, period).alias("period"), F.explode(pairs).alias("e")).select("period", "e.feature", F.nullif("e.x", F.lit(float("nan"))).alias("x"))
    return _with_sketch(
        long.groupBy("feature", "period").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("x").isNull()).alias("missing"),
            F.min("x").alias("least"),
            F.max("x").alias("greatest"),
            F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"),
        )
    )


def merged_profile(profiles: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Profiles of several periods as one per group."""
    return _with_sketch(
        profiles.groupBy(*by).agg(
            F.sum("rows").alias("rows"),
            F.sum("missing").alias("missing"),
            F.min("least").alias("least"),
            F.max("greatest").alias("greatest"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )


def _with_sketch(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("sketch", F.when(F.col("rows") > F.col("missing"), F.col("sketch")))


def profile_psi(base: DataFrame, current: DataFrame, bins: int = 10, floor: float = 0.005) -> DataFrame:
    """``psi`` between merged profiles: ``base`` has one row per feature, ``current`` any number, all of whose columns
    but the sketch are kept.

    Bins are those of ``psi``, read from the sketches at ``RANKS`` ranks. ``floor`` lies above what a sketch can tell
    from nothing. NULL where either side has no values, or the base has no profile.
    """
    values = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit((i + 0.5) / RANKS) for i in range(RANKS)]))
    points = base.select("feature", values.alias("__base"))
    starts = [F.get("__base", F.lit(0))]
    for i in range(1, bins):
        at = i * RANKS // bins
        later = F.filter(F.slice("__base", at + 1, RANKS), lambda v, at=at: v > F.get("__base", F.lit(at - 1)))
        starts.append(F.get(later, F.lit(0)))
    edges = points.withColumn("__edges", F.array_distinct(F.array_compact(F.array(*starts))))  # one row per feature
    rows = current.withColumn("__now", values).join(F.broadcast(edges), "feature", "left")

    def shares(c: str) -> Column:
        below = F.transform(F.slice("__edges", 2, bins), lambda e: F.size(F.filter(c, lambda v: v < e)) / F.lit(float(RANKS)))
        low, high = F.concat(F.array(F.lit(0.0)), below), F.concat(below, F.array(F.lit(1.0)))
        return F.zip_with(high, low, lambda b, a: F.greatest(F.lit(floor), b - a))

    terms = F.zip_with(shares("__now"), shares("__base"), lambda c, b: (c - b) * F.log(c / b))
    total = F.when(F.col("__now").isNotNull() & (F.size("__edges") > 0), F.aggregate(terms, F.lit(0.0), lambda a, t: a + t))
    kept = [c for c in current.columns if c != "sketch"]
    return rows.select(*kept, round_to(total, 6).alias("psi"))


def score_gates(scores: DataFrame, rules: Sequence[tuple[str, str, float, str]], keys: Sequence[str]) -> DataFrame:
    """Rows that break a rule, one row per broken rule. A rule is (metric, comparator, limit, action)."""
    compare = {
        "greaterThan": lambda c, v: c > v,
        "lessThan": lambda c, v: c < v,
        "equals": lambda c, v: c == v,
        "notEquals": lambda c, v: c != v,
    }
    broken = F.array_compact(
        F.array(
            *[
                F.when(
                    compare[how](F.col(metric).cast("double"), F.lit(float(limit))),
                    F.struct(
                        F.lit(metric).alias("metric"),
                        F.lit(how).alias("comparator"),
                        F.lit(float(limit)).alias("threshold"),
                        F.col(metric).cast("double").alias("value"),
                        F.lit(action).alias("action"),
                    ),
                )
                for metric, how, limit, action in rules
            ]
        )
    )
    return scores.select(*keys, F.explode(broken).alias("g")).select(*keys, "g.*")


def eval_summary(rows: DataFrame, metrics: Sequence[str], required: Sequence[str] = ("id", "question", "answer")) -> DataFrame:
    """Mean of each metric over evaluated rows, beside the number of rows with a missing field."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (
        rows.select(missing.alias("missing"), F.explode(pairs).alias("e"))
        .groupBy(F.col("e.metric").alias("metric"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("missing").alias("rows_with_missing_field"),
            F.count("e.value").alias("scored"),
            F.avg("e.value").alias("mean"),
        )
    )
