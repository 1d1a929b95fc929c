"""Served predictions and the questions asked of them; model training and batch scoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.scalars import round_to
from larder.operators.aggregates import grouped
from larder.operators.model_quality import fold_of, log_loss_of
from larder.operators.ordering import top_n, top_per
from larder.session import materialise, scratch_folder

PROBABILITY = "shortage_probability_30d"
KEYS = ("snapshot_date", "location_id", "item_id", "preferred_supplier_id")
#: What predictions can be grouped by.
DIMENSIONS = ("region", "site_kind", "commodity_group", "criticality", "supplier_kind", "supplier_region", "mission_priority", "cold_chain_required")


def serve(raw: DataFrame, scoring: DataFrame, raw_col: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Scoring keys with the raw probability, renamed and otherwise unchanged."""
    return scoring.select(*keys).join(raw.select(*keys, F.col(raw_col).alias(PROBABILITY)), list(keys))


def prediction_view(
    scoring: DataFrame, raw: DataFrame, raw_col: str, view: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The approved columns only: keys, descriptive dimensions and the probability."""
    out = scoring.select(*keys, *DIMENSIONS).join(
        raw.select(*keys, F.col(raw_col).alias(PROBABILITY)), list(keys)
    )
    if view:
        out.createOrReplaceTempView(view)
    return out


def risk_measures(t: float | None = None) -> list[Column]:
    """Descriptive measures of a group of positions. None of them is a probability of the group."""
    p = F.col(PROBABILITY)
    n = F.count(p)
    exact = F.sum(p.cast("decimal(28,12)")).cast("double") / n.cast("double")
    out = [
        F.count(F.lit(1)).alias("positions"),
        round_to(F.when(n > 0, exact), 9).alias("avg_probability_of_positions"),
        F.max(p).alias("max_probability_of_positions"),
    ]
    if t is not None:
        out.append(F.count_if(p >= t).alias("positions_over"))
    return out


def risk_by(predictions: DataFrame, dims: Sequence[str], sets: str = "plain") -> DataFrame:
    return grouped(predictions, dims, risk_measures(), sets)


def count_over(predictions: DataFrame, dims: Sequence[str], t: float = 0.70) -> DataFrame:
    return grouped(predictions, dims, [F.count_if(F.col(PROBABILITY) >= t).alias("positions_over")])


def top_risk(predictions: DataFrame, n: int, per: Sequence[str] | None = None) -> DataFrame:
    order = [f"-{PROBABILITY}", "location_id", "item_id"]
    return top_per(predictions, per, order, n) if per else top_n(predictions, order, n)


def query_risk(
    predictions: DataFrame,
    where: Column | str | None = None,
    by: Sequence[str] = (),
    t: float | None = None,
    n: int | None = None,
) -> DataFrame:
    """Filter, then group (with a threshold count) or rank."""
    rows = predictions.filter(where) if where is not None else predictions
    if by:
        return grouped(rows, by, risk_measures(t))
    if t is not None:
        rows = rows.filter(F.col(PROBABILITY) >= t)
    return top_risk(rows, n) if n else rows


def high_risk_by_supplier(predictions: DataFrame, t: float = 0.70) -> DataFrame:
    """Suppliers by their number of positions at or over the threshold, most first."""
    counts = count_over(predictions, ["preferred_supplier_id"], t)
    return counts.filter(F.col("positions_over") > 0).orderBy(F.desc("positions_over"), "preferred_supplier_id")


def feature_columns(df: DataFrame, left_out: Sequence[str]) -> tuple[list[str], list[str]]:
    """The columns of a model table that are text or truth values, and those that are numbers; dates and the left out are neither."""
    fields = [f for f in df.schema if f.name not in left_out]
    named = [f.name for f in fields if f.dataType.typeName() in ("string", "boolean")]
    return named, [f.name for f in fields if isinstance(f.dataType, T.NumericType)]


def time_split(df: DataFrame, cut_date: dt.date, gap_days: int = 30, day: str = "snapshot_date") -> tuple[DataFrame, DataFrame]:
    """Rows whose label horizon ends before the cut, and rows from the cut on."""
    last = cut_date - dt.timedelta(days=gap_days)
    return df.filter(F.col(day) < F.lit(last)), df.filter(F.col(day) >= F.lit(cut_date))


def train(
    df: DataFrame,
    cut_date: dt.date,
    gap_days: int = 30,
    label: str = "shortage_within_30d",
    trees: int = 20,
    kind: str = "gbt",
):
    """Fit a classifier on the rows before the cut, less the label gap.

    Tree building reads its input many times, so the prepared rows are materialised once. The model is stored and read
    back: a logistic one just fitted holds its training summary and with that the session, which tasks cannot
    take along once it has, say, observed a table.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    named, numbers = feature_columns(df, (*KEYS, label))
    rows, _ = time_split(df, cut_date, gap_days)
    rows = materialise(_ready(rows, named, numbers, F.col(label).cast("double").alias("label")))
    indexed = [f"{c}_index" for c in named]
    stages = [
        StringIndexer(inputCols=named, outputCols=indexed, handleInvalid="keep"),
        VectorAssembler(inputCols=[*indexed, *numbers], outputCol="features", handleInvalid="keep"),
        GBTClassifier(maxIter=trees, maxDepth=4, maxBins=64, seed=7, checkpointInterval=10)
        if kind == "gbt"
        else LogisticRegression(maxIter=50),
    ]
    path = scratch_folder(df.sparkSession, "model")
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path)


def _ready(df: DataFrame, named: Sequence[str], numbers: Sequence[str], *more: Column | str) -> DataFrame:
    return df.select(*more, *[F.col(c).cast("string").alias(c) for c in named], *[F.col(c).cast("double").alias(c) for c in numbers])


def score_folds(
    df: DataFrame, cuts: Sequence[dt.date], gap_days: int = 30, label: str = "shortage_within_30d", trees: int = 20, kind: str = "gbt"
) -> DataFrame:
    """Rows of every chronological fold with the probability from a model of their own past: keys, ``fold``, the label, the prediction.

    For each fold a model is fitted to the rows whose label was known at its cut. Measures and calibration by fold follow
    from ``model_quality``; the last fold is the holdout.
    """
    folds = df.withColumn("fold", fold_of("snapshot_date", cuts, gap_days))
    out = None
    for i, cut in enumerate(cuts):
        rows = folds.filter(F.col("fold") == i + 1)
        scored = score(train(df, cut, gap_days, label, trees, kind), rows).join(rows.select(*KEYS, "fold", label), list(KEYS))
        out = scored if out is None else out.unionByName(scored)
    return out


#: Scores are calibrated in so many equal steps, which bounds what a calibration holds.
CALIBRATION_STEPS = 10_000
CALIBRATED = "calibrated"


def calibrate(fit: DataFrame, df: DataFrame, label: str, p: str, steps: int = CALIBRATION_STEPS) -> DataFrame:
    """``df`` with the probability that the scores of ``fit`` turned out to mean, as column ``calibrated``.

    An isotonic regression over the steps of the score: the fitted values never fall as the score rises, and no other such
    steps have a smaller log loss on ``fit``. Rows of ``fit`` are counted per step first. Scores between fitted steps are
    interpolated; a score that is NULL or no number has no calibrated one. A ``fit`` without rows is an error.
    """
    from pyspark.ml.regression import IsotonicRegression

    def stepped(rows: DataFrame) -> DataFrame:
        step = F.least(F.lit(steps - 1), F.floor(F.col(p) * steps)) / F.lit(float(steps))
        return rows.withColumn("__step", F.when(F.col(p).isNotNull() & ~F.isnan(p), step))

    n = F.count(F.lit(1)).cast("double")
    counted = stepped(fit).filter(F.col("__step").isNotNull() & F.col(label).isNotNull()).groupBy("__step")
    counted = materialise(counted.agg((F.sum(F.col(label).cast("bigint")) / n).alias("__rate"), n.alias("__n")))
    if counted.isEmpty():
        raise ValueError("there are no rows to calibrate with")
    model = IsotonicRegression(featuresCol="__step", labelCol="__rate", weightCol="__n", predictionCol=CALIBRATED).fit(counted)
    rows = stepped(df).withColumn("__known", F.col("__step").isNotNull()).fillna(0.0, ["__step"])
    out = model.transform(rows)
    return out.withColumn(CALIBRATED, F.when(F.col("__known"), F.col(CALIBRATED))).drop("__step", "__known")


def calibrated_folds(
    df: DataFrame,
    cuts: Sequence[dt.date],
    gap_days: int = 30,
    fit_days: int = 60,
    label: str = "shortage_within_30d",
    trees: int = 20,
    kind: str = "gbt",
    out: str = "shortage_within_30d_1_PREDICTION",
) -> DataFrame:
    """Every chronological fold with raw and calibrated probabilities: keys, ``fold``, ``fitted``, the label, both scores.

    What a fold may know before its cut is split by time: a model learns from the earlier part, and its scores on the last
    ``fit_days`` days whose labels are known at the cut (rows with ``fitted``) say what a score means. The model's
    labels end before those days begin, so nothing is seen twice.
    """
    result = None
    for i, cut in enumerate(cuts):
        end = cut - dt.timedelta(days=gap_days)
        begin = end - dt.timedelta(days=fit_days)
        day = F.col("snapshot_date")
        fold = F.when((day >= F.lit(begin)) & (day < F.lit(end)), F.lit(True)).when(fold_of("snapshot_date", cuts, gap_days) == i + 1, F.lit(False))
        rows = df.withColumn("fitted", fold).filter(F.col("fitted").isNotNull())
        scored = score(train(df, begin, gap_days, label, trees, kind), rows, out=out).join(rows.select(*KEYS, "fitted", label), list(KEYS))
        scored = materialise(scored)
        scored = calibrate(scored.filter("fitted"), scored, label, out).withColumn("fold", F.lit(i + 1))
        result = scored if result is None else result.unionByName(scored)
    return result


def calibration_gain(scored: DataFrame, label: str, p: str, by: Sequence[str]) -> DataFrame:
    """Rows, positives, and log loss and mean squared error of the raw and of the calibrated score per group."""
    y = F.col(label).cast("double")

    def brier(c: str) -> Column:
        exact = F.sum(((F.col(c) - y) * (F.col(c) - y)).cast("decimal(28,12)")).cast("double")
        return round_to(exact / F.count(c).cast("double"), 9)

    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        log_loss_of(label, p).alias("log_loss"),
        log_loss_of(label, CALIBRATED).alias("calibrated_log_loss"),
        brier(p).alias("brier"),
        brier(CALIBRATED).alias("calibrated_brier"),
    )


def score(model, df: DataFrame, keys: Sequence[str] = KEYS, out: str = "shortage_within_30d_1_PREDICTION") -> DataFrame:
    """Raw predictions table: keys and the probability of the positive class, from the columns that the model was fitted to."""
    from pyspark.ml.functions import vector_to_array

    named = list(model.stages[0].getInputCols())
    numbers = [c for c in model.stages[1].getInputCols() if c not in model.stages[0].getOutputCols()]
    return model.transform(_ready(df, named, numbers, *keys)).select(*keys, vector_to_array("probability")[1].alias(out))
