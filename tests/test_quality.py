import datetime as dt
import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from larder.operators import checks as ck
from larder.operators import model_quality as mq
from larder.operators import requests as rq
from larder.operators import risk as rk


def scored(spark, n=400, seed=1, ties=20):
    rng = random.Random(seed)
    rows = [(g, y, min(1.0, max(0.0, round((rng.random() + 0.4 * y) / 1.4 * ties) / ties))) for g in ("a", "b") for y in (rng.randint(0, 1) for _ in range(n))]
    return spark.createDataFrame(rows, "g string, y int, p double"), rows


def auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total, out, hits, seen = sum(y for y, _ in pairs), 0.0, 0, 0
    for p in sorted({p for _, p in pairs}, reverse=True):
        here = [y for y, q in pairs if q == p]
        hits, seen = hits + sum(here), seen + len(here)
        out += sum(here) / total * hits / seen
    return out


def test_ranking_measures_equal_brute_force(spark):
    df, rows = scored(spark)
    assert mq.roc_auc(df, "y", "p").first()[0] == pytest.approx(auc([r[1:] for r in rows]), abs=1e-8)
    assert mq.pr_auc(df, "y", "p").first()[0] == pytest.approx(average_precision([r[1:] for r in rows]), abs=1e-8)
    for r in mq.roc_auc(df, "y", "p", ["g"]).collect():
        assert r.roc_auc == pytest.approx(auc([x[1:] for x in rows if x[0] == r.g]), abs=1e-8)
    for r in mq.pr_auc(df, "y", "p", ["g"]).collect():
        assert r.pr_auc == pytest.approx(average_precision([x[1:] for x in rows if x[0] == r.g]), abs=1e-8)


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.2)], "y int, p double")
    assert mq.roc_auc(df, "y", "p").first()[0] is None
    assert mq.pr_auc(df.withColumn("y", F.lit(0)), "y", "p").first()[0] is None


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5), (0, 1.0)], "y int, p double")
    want = (-math.log(1 - 1e-15) * 2 - math.log(0.5) - math.log(1 - (1 - 1e-15))) / 4
    assert mq.log_loss(df, "y", "p").first()[0] == pytest.approx(want, abs=1e-6)


def test_calibration(spark):
    df, rows = scored(spark)
    table = mq.calibration(df, "y", "p", by=["g"]).collect()
    for r in table:
        mine = [(y, p) for g, y, p in rows if g == r.g and min(9, int(p * 10)) == r.bin]
        assert r.rows == len(mine)
        assert r.observed_rate == pytest.approx(sum(y for y, _ in mine) / len(mine), abs=1e-8)
    assert sum(r.rows for r in table) == len(rows)


def test_folds_leave_a_gap(spark):
    cuts = [dt.date(2024, 3, 1), dt.date(2024, 6, 1)]
    days = [dt.date(2024, 2, 28), dt.date(2024, 3, 1), dt.date(2024, 5, 1), dt.date(2024, 5, 2), dt.date(2024, 6, 1), dt.date(2025, 1, 1)]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    assert [r[0] for r in df.select(mq.fold_of("d", cuts, 30)).collect()] == [None, 1, 1, None, 2, 2]


def test_ramp(spark):
    rows = [(dt.date(2024, i, 1), 100, n) for i, n in enumerate([1, 1, 2, 1, 6, 14, 21], 1)]
    df = spark.createDataFrame(rows, "month date, rows bigint, positives bigint").withColumn("prevalence", F.col("positives") / F.col("rows"))
    r = mq.ramp_test(df).first()
    assert (r.rising_months, r.strictly_rising) == (3, True)
    assert r.ratio == pytest.approx((41 / 300) / (5 / 400), abs=1e-8)


def test_drift(spark):
    base = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.lit(1.0).alias("same"))
    moved = base.withColumn("x", F.col("x") + 40)
    scores = {r.feature: r.psi for r in mq.psi(base, moved, ["x", "same"]).collect()}
    assert scores["x"] > 1 and scores["same"] == 0
    assert {r.feature: r.psi for r in mq.psi(base, base, ["x"]).collect()} == {"x": 0.0}
    outlier = spark.createDataFrame([(1e9, 1.0)], base.schema)
    assert mq.psi(base.unionByName(outlier), moved, ["x"]).first().psi > 1


def test_profiles_tell_drift_without_the_rows(spark):
    """Merged months against the rows themselves: even and tied values, a jump, missing values, and a month without any."""
    rng = random.Random(5)
    rows = [
        (dt.date(2024, 1 + i % 6, 1 + i % 28), rng.gauss(0, 1) + (i % 6 > 3), float(rng.choice([0, 0, 0, 1, 2, 7])), None if i % 6 == 2 or i % 5 == 0 else rng.random(), float("nan"))
        for i in range(30_000)
    ]
    df = spark.createDataFrame(rows, "snapshot_date date, jump double, tied double, gaps double, none double")
    cols = ["jump", "tied", "gaps", "none"]
    profiles = mq.value_profile(df, cols)
    cut = F.lit(dt.date(2024, 4, 1))
    base, later = mq.merged_profile(profiles.filter(F.col("period") < cut)), profiles.filter(F.col("period") >= cut)
    assert {r.feature: (r.rows, r.missing) for r in base.collect()}["gaps"] == (15_000, sum(r[3] is None for r in rows if r[0].month < 4))
    got = {(r.feature, r.period.month): r.psi for r in mq.profile_psi(base, later).collect()}
    for month in (4, 5, 6):
        now = df.filter(F.month("snapshot_date") == month)
        want = {r.feature: r.psi for r in mq.psi(df.filter(F.month("snapshot_date") < 4), now, cols[:3], floor=0.005).collect()}
        for c in cols[:3]:
            assert got[c, month] == pytest.approx(want[c], abs=0.02), (c, month)
        assert got["none", month] is None
    assert got["jump", 4] < 0.02 < 0.3 < got["jump", 5]
    whole = {r.feature: r.psi for r in mq.profile_psi(base, mq.merged_profile(later)).collect()}
    assert whole["tied"] < 0.01 and mq.profile_psi(base, later.limit(0)).count() == 0


def pooled(points):
    """Rates that never fall, by merging neighbours: (sum, number) per step in order."""
    blocks = []
    for s, n in points:
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            s2, n2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k]
    return [s / n for s, n, k in blocks for _ in range(k)]


def test_calibration_equals_pooled_neighbours(spark):
    rng = random.Random(3)
    rows = [(p, int(rng.random() < p * p)) for p in (rng.randint(0, 49) / 50 + 0.001 for _ in range(4000))]
    df = spark.createDataFrame(rows, "p double, y int")
    extra = spark.createDataFrame([(None, 0), (1.0, 1)], df.schema)
    got = {r.p: r.calibrated for r in rk.calibrate(df, df.unionByName(extra), "y", "p").collect()}
    steps = sorted({p for p, _ in rows})
    want = pooled([(sum(y for p, y in rows if p == s), sum(p == s for p, _ in rows)) for s in steps])
    assert [got[s] for s in steps] == pytest.approx(want, abs=1e-9)
    assert got[None] is None and got[1.0] == pytest.approx(want[-1])
    gain = rk.calibration_gain(rk.calibrate(df, df, "y", "p"), "y", "p", []).first()
    assert gain.calibrated_log_loss < gain.log_loss and gain.calibrated_brier < gain.brier
    with pytest.raises(ValueError, match="no rows"):
        rk.calibrate(df.limit(0), df, "y", "p")


def test_models_of_folds_see_only_their_past(spark):
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 300).cast("int"))
    late = F.col("snapshot_date") >= F.lit(dt.date(2024, 8, 1))
    rows = spark.range(3000).select(
        day.alias("snapshot_date"), F.lit("l").alias("location_id"), F.col("id").cast("string").alias("item_id"), F.lit("s").alias("preferred_supplier_id"),
        (F.col("id") * 7 % 19).cast("double").alias("x"), F.concat(F.lit("v"), F.col("id") % 2).alias("region"),
    )
    rows = rows.withColumn("shortage_within_30d", F.when(late, F.col("x") < 9).otherwise(F.col("x") > 9).cast("int"))
    scored = rk.score_folds(rows, [dt.date(2024, 5, 1), dt.date(2024, 8, 1)], kind="logistic")
    measures = {r.fold: r for r in mq.all_measures(scored, "shortage_within_30d", "shortage_within_30d_1_PREDICTION", ["fold"]).collect()}
    assert measures[1].roc_auc > 0.99  # nothing of the turn in August is known
    assert measures[2].roc_auc < 0.01


def test_models_score_in_a_session_that_has_observed_a_table(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 100).cast("int"))
    rows = spark.range(400).select(
        day.alias("snapshot_date"), F.lit("l").alias("location_id"), F.col("id").cast("string").alias("item_id"), F.lit("s").alias("preferred_supplier_id"),
        (F.col("id") * 7 % 19).cast("double").alias("x"), F.concat(F.lit("v"), F.col("id") % 2).alias("region"), (F.col("id") * 7 % 19 > 9).cast("int").alias("shortage_within_30d"),
    )
    scored = rk.score(rk.train(rows, dt.date(2024, 3, 1), kind="logistic"), rows)
    assert scored.repartition(3).filter(F.col("shortage_within_30d_1_PREDICTION").between(0, 1)).count() == 400


def test_gates_and_evaluation(spark):
    df = spark.createDataFrame([(1, 5000, 0.9), (2, 10, 0.5), (3, 10, None)], "id int, tokens int, score double")
    got = mq.score_gates(df, [("tokens", "greaterThan", 4000, "block"), ("score", "lessThan", 0.7, "report")], ["id"]).collect()
    assert sorted((r.id, r.metric, r.action) for r in got) == [(1, "tokens", "block"), (2, "score", "report")]
    rows = spark.createDataFrame([("1", "q", "a", 1.0), ("2", "q", "", 0.5), (None, "q", "a", None)], "id string, question string, answer string, faith double")
    r = mq.eval_summary(rows, ["faith"]).first()
    assert (r.rows, r.rows_with_missing_field, r.scored, r.mean) == (3, 2, 2, 0.75)


def test_time_split_and_training(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    df = spark.createDataFrame([(x,) for x in days], "snapshot_date date")
    cut = dt.date(2024, 3, 1)
    before, after = rk.time_split(df, cut, 30)
    assert before.agg(F.max("snapshot_date")).first()[0] == cut - dt.timedelta(days=31)
    assert after.agg(F.min("snapshot_date")).first()[0] == cut


def test_logistic_model_scores_every_row(spark):
    from larder.operators.features import compared_measures, trailing_measures

    numbers = ["days_of_supply", "minimum_days_supply", "on_hand_units", *trailing_measures(), *compared_measures()]

    def value(name):
        if name == "snapshot_date":
            return F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 200).cast("int")).alias(name)
        if name in ("region", "cold_chain_required"):
            return (F.concat(F.lit("v"), F.col("id") % 2) if name == "region" else F.col("id") % 2 == 0).alias(name)
        return (F.col("id").cast("string") if name in rk.KEYS else (F.col("id") % 17).cast("double")).alias(name)

    names = (*rk.KEYS, *numbers, "region", "cold_chain_required")
    rows = spark.range(300).select(*[value(c) for c in names], (F.col("id") % 17 > 9).cast("int").alias("shortage_within_30d"))
    assert rk.feature_columns(rows, (*rk.KEYS, "shortage_within_30d")) == (["region", "cold_chain_required"], numbers)
    model = rk.train(rows, dt.date(2024, 6, 1), kind="logistic")
    out = rk.score(model, rows)
    assert out.count() == 300
    assert mq.roc_auc(out.join(rows, list(rk.KEYS)), "shortage_within_30d", "shortage_within_30d_1_PREDICTION").first()[0] > 0.99


def test_run_outcomes(spark):
    t = dt.datetime(2024, 1, 1)
    s = lambda n: t + dt.timedelta(seconds=n)
    rows = [
        ("ok", 0, s(0), "RUN_STARTED", None, 200), ("ok", 1, s(2), "TEXT_MESSAGE_CONTENT", None, 200), ("ok", 2, s(5), "RUN_FINISHED", None, 200),
        ("bad", 0, s(0), "RUN_STARTED", None, 200), ("bad", 1, s(1), "RUN_ERROR", "x" * 300, 200), ("bad", 2, s(9), "TEXT_MESSAGE_CONTENT", None, 200),
        ("cut", 0, s(0), "RUN_STARTED", None, 200), ("http", 0, s(0), "HTTP_ERROR", "no", 503),
        ("slow", 0, s(0), "RUN_STARTED", None, None), ("slow", 1, s(600), "TIMEOUT", "timed out", None),
        ("odd", 0, s(0), "EXCEPTION", "boom", None),
    ]
    df = spark.createDataFrame(rows, "run_id string, seq int, ts timestamp, type string, error_message string, http_status int")
    got = {r.run_id: r for r in rq.run_outcomes(df, ["run_id"]).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        "ok": "finished", "bad": "error", "cut": "incomplete", "http": "http_error", "slow": "timeout", "odd": "exception",
    }
    assert (got["ok"].total_duration_s, got["ok"].ttft_s, got["ok"].error_detail) == (5.0, 2.0, None)
    assert (got["bad"].ttft_s, len(got["bad"].error_detail), got["http"].http_status) == (None, 300, 503)


def test_latency_small_groups_and_sketch(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "duration_s double")
    r = rq.latency_summary(df).first()
    assert (r.requests, r.min, r.max, r.p50, r.p90) == (3, 1.0, 4.0, 2.0, 3.6)
    a = rq.latency_summary(df, approximate=True).first()
    assert (a.min, a.max) == (1.0, 4.0) and a.p50 in (1.0, 2.0, 4.0)
    none = rq.throughput(spark.createDataFrame([(dt.datetime(2024, 1, 1), "finished")], "t timestamp, outcome string"), "t", "t").first()
    assert (none.requests, none.requests_per_s) == (1, None)


def test_checks_fail_on_broken_rows(spark):
    fact = spark.createDataFrame([(1,), (9,), (9,), (None,)], "k int")
    dim = spark.createDataFrame([(1,)], "id int")
    report = ck.orphan_report(fact, [("unknown", "k", dim, "id")])
    assert [tuple(r) for r in report.collect()] == [("unknown", 1)]
    with pytest.raises(AssertionError, match="unknown"):
        ck.require_empty(report)
    ck.require_empty(ck.orphan_report(dim, [("fine", "id", dim, "id")]))
    assert [tuple(r) for r in ck.duplicate_keys(fact, ["k"]).collect()] == [(9, 2)]
    r = ck.both_classes(spark.createDataFrame([(1,), (1,)], "shortage_within_30d int")).first()
    assert (r.positives, r.negatives, r.both_present) == (2, 0, False)
    rules = {"known": ck.one_of("k", [1, 2]), "set": ck.not_null("k"), "low": ck.between("k", 0, 5)}
    assert {x.rule: x.failures for x in ck.rule_checks(fact, rules).collect()} == {"known": 3, "set": 1, "low": 3}
    expected = ck.expected_scale(spark, 2, 3, 10, 5, 1)
    got = {x.table_name: (x.expected, x.actual, x.matches) for x in ck.scale_report(expected, {"locations": spark.range(2), "orders": spark.range(4)}).collect()}
    assert got["locations"] == (2, 2, True) and got["orders"] == (5, 4, False) and got["inventory_daily"] == (60, None, False)


def test_redacted_logs(spark):
    df = spark.createDataFrame([('login {"access_token": "s"} refresh_token=abc', '{"x": {"access_token": "q"}}')], "message string, extra string")
    r = ck.redact_logs(df, extras="extra").first()
    assert r.message == 'login {"access_token": "[REDACTED]"} refresh_token=[REDACTED]'
    assert r.extra == '{"x": {"access_token": "[REDACTED]"}}'
