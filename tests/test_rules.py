import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import escalation as es
from larder.operators import joins as jn
from larder.operators import retrieval as rt

NOW = dt.date(2024, 6, 1)


def d(n):
    return NOW + dt.timedelta(days=n)


POSITION = (
    "location_id string, item_id string, preferred_supplier_id string, criticality string, cold_chain_required boolean, "
    "cold_storage_flag boolean, days_of_supply double, minimum_days_supply int, backordered_units int, late_inbound_units int, "
    "days_above_minimum double, actual_ontime_rate_90d double, policy_reference_id string"
)


def pos(loc, dos, minimum=14, item="i", supplier="s1", crit="HIGH", cold=False, storage=True, back=0, late=0, rate=0.9):
    return (loc, item, supplier, crit, cold, storage, dos, minimum, back, late, dos - minimum, rate, "MED-STOCK-6505")


EVENTS = [
    ("e1", "s1", "COLD_CHAIN_EXCEPTION", d(-3), d(0)),
    ("e2", "s1", "TRANSPORT_DELAY", d(-3), d(-1)),
    ("e3", "s2", "OTHER", d(-1), d(1)),
]


def frames(spark, rows, risks=()):
    events = spark.createDataFrame(EVENTS, "event_id string, supplier_id string, event_type string, start_date date, end_date date")
    predictions = spark.createDataFrame(list(risks) or [("x", "x", 0.0)], "location_id string, item_id string, shortage_probability_30d double")
    return spark.createDataFrame(rows, POSITION), events, predictions


def names(df, col="location_id"):
    return sorted(r[col] for r in df.collect())


def test_review_bands(spark):
    rows = [pos("below", 13.9), pos("at", 14.0, back=1), pos("near", 19.0, late=1, supplier="s9"), pos("calm", 18.0, supplier="s9"), pos("event", 18.0), pos("far", 19.1, back=5)]
    position, events, _ = frames(spark, rows)
    assert names(es.immediate_review(position)) == ["below"]
    assert names(es.elevated_review(position, events, NOW)) == ["at", "event", "near"]


def test_supplier_and_cold_chain_rules(spark):
    rows = [pos("a", 50.0, cold=True), pos("b", 50.0, cold=True, supplier="s2"), pos("c", 50.0, cold=True, supplier="s9", late=1), pos("w", 50.0)]
    position, events, _ = frames(spark, rows)
    assert names(es.supplier_evidence(position, events, NOW)) == ["a", "w"]
    assert names(es.cold_chain_urgency(position, events, NOW)) == ["a", "c"]
    perf = spark.createDataFrame([("s1", 0.84), ("s2", 0.85), ("s3", None)], "supplier_id string, actual_ontime_rate_90d double")
    assert names(es.supplier_review(perf), "supplier_id") == ["s1"]


def test_predictive_trigger(spark):
    rows = [("a", 0.70, "HIGH"), ("b", 0.69, "HIGH"), ("c", 0.9, "ROUTINE"), ("d", 0.9, "MISSION_CRITICAL")]
    df = spark.createDataFrame(rows, "location_id string, shortage_probability_30d double, criticality string")
    assert names(es.predictive_trigger(df)) == ["a", "d"]


def test_escalation_collects_all_rules(spark):
    rows = [pos("low", 3.0, cold=True, back=2, rate=0.5), pos("ok", 90.0, supplier="s9"), pos("risk", 60.0, supplier="s9")]
    position, events, predictions = frames(spark, rows, [("low", "i", 0.9), ("ok", "i", 0.1), ("risk", "i", 0.8)])
    got = {r.location_id: (r.escalation_level, r.rule_ids) for r in es.escalation(position, predictions, events, NOW).collect()}
    assert got == {
        "low": (3, ["MED-ESC-001", "MED-ESC-003", "MED-SUP-001", "MED-SUP-002", "MED-COLD-001"]),
        "ok": (0, []),
        "risk": (2, ["MED-ESC-003"]),
    }


def test_transfer_candidates_equal_brute_force(spark):
    rng = random.Random(9)
    rows, risks = [], []
    for item in "ij":
        for n in range(25):
            loc = f"l{n:02}"
            rows.append(pos(loc, float(rng.randint(0, 40)), item=item, cold=item == "j", storage=rng.random() < 0.5))
            risks.append((loc, item, rng.randint(0, 8) / 8))
    position, _, predictions = frames(spark, rows, risks)
    risk = {(a, b): p for a, b, p in risks}
    want = set()
    for r in rows:
        if r[6] > r[7] + 5:
            continue
        donors = [x for x in rows if x[1] == r[1] and x[6] > x[7] and (not x[4] or x[5]) and risk[x[0], x[1]] < risk[r[0], r[1]]]
        donors.sort(key=lambda x: (risk[x[0], x[1]], -(x[6] - x[7]), x[0]))
        want |= {(r[0], r[1], x[0], i) for i, x in enumerate(donors[:3], 1)}
    got = {(r.location_id, r.item_id, r.donor_location_id, r.rank) for r in es.transfer_candidates(position, predictions, 3).collect()}
    assert got == want and want


def test_disruption_days_equal_brute_force(spark):
    rng = random.Random(2)
    events = []
    for i in range(40):
        start = rng.randint(0, 90)
        events.append((f"e{i}", rng.choice(["s1", "s2"]), "X", d(start), d(start + rng.randint(0, 12))))
    ev = spark.createDataFrame(events, "event_id string, supplier_id string, event_type string, start_date date, end_date date")
    days = spark.createDataFrame([(s, d(n)) for s in ("s1", "s2", "s3") for n in range(0, 120, 3)], "preferred_supplier_id string, snapshot_date date")
    for r in jn.disruption_days(days, ev, 30).collect():
        window = {r.snapshot_date - dt.timedelta(days=k) for k in range(30)}
        hit = {x for x in window if any(e[1] == r.preferred_supplier_id and e[3] <= x <= e[4] for e in events)}
        assert r.disrupted_days == len(hit)
    for r in jn.disruption_days(days, ev, 0, ahead=14).collect():
        window = {r.snapshot_date + dt.timedelta(days=k) for k in range(1, 15)}
        hit = {x for x in window if any(e[1] == r.preferred_supplier_id and e[3] <= x <= e[4] for e in events)}
        assert r.disrupted_days == len(hit)


def wide_events(spark):
    """A few numbers that grow to many days: Spark's estimate of the days is the size of the numbers."""
    return spark.range(50).select(
        F.concat(F.lit("s"), F.col("id") % 5).alias("supplier_id"),
        F.date_add(F.lit(NOW), F.col("id").cast("int")).alias("start_date"),
        F.date_add(F.lit(NOW), F.col("id").cast("int") + 900).alias("end_date"),
    )


def calendar_join(df):
    """The lines of the plan that join the supplier's calendar."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Join" in x and "preferred_supplier_id" in x]


@pytest.mark.parametrize("lookback, ahead", [(30, 0), (0, 30)])
def test_disruption_calendar_is_not_broadcast(spark, lookback, ahead):
    days = wide_events(spark).select(F.col("supplier_id").alias("preferred_supplier_id"), F.col("start_date").alias("snapshot_date"))
    joins = calendar_join(jn.disruption_days(days, wide_events(spark), lookback, ahead=ahead))
    assert joins and all("SortMergeJoin" in x for x in joins)


@pytest.mark.parametrize("lookback, ahead", [(1, 0), (30, 0), (64, 0), (65, 0), (200, 0), (0, 30), (30, 40), (-5, 30)])
def test_disruption_days_of_odd_rows_equal_brute_force(spark, lookback, ahead):
    """Empty keys and days, days before 1970, repeated rows, and windows over several blocks of days."""
    rng, zero = random.Random(lookback * 100 + ahead), dt.date(1970, 1, 1)
    events, rows = [], []
    for _ in range(30):
        start = zero + dt.timedelta(days=rng.randint(-300, 300))
        events.append((rng.choice(["s1", "s2", None]), start, start + dt.timedelta(days=rng.choice([0, 1, 12, 63, 64]))))
    events += [*events[:5], ("s1", None, zero), ("s1", zero, None)]
    for i in range(400):
        rows.append((i, rng.choice(["s1", "s2", "s3", None]), rng.choice([zero + dt.timedelta(days=rng.randint(-400, 400))] * 9 + [None])))
    rows += rows[:20]
    days = spark.createDataFrame(rows, "n int, preferred_supplier_id string, snapshot_date date")
    got = jn.disruption_days(days, spark.createDataFrame(events, "supplier_id string, start_date date, end_date date"), lookback, ahead=ahead)
    assert got.dtypes == [("preferred_supplier_id", "string"), ("snapshot_date", "date"), ("n", "int"), ("disrupted_days", "bigint")]
    want = []
    for n, s, day in rows:
        window = [day + dt.timedelta(days=k) for k in range(1 - lookback, ahead + 1)] if day and s else []
        want.append((n, sum(any(e[0] == s and e[1] and e[2] and e[1] <= x <= e[2] for e in events) for x in window)))
    assert sorted((r.n, r.disrupted_days) for r in got.collect()) == sorted(want) and any(w for _, w in want)


def test_rules_for_positions(spark):
    position, *_ = frames(spark, [pos("a", 1.0)])
    rows = [("text 1", "MED-STOCK-6505"), ("text 2", "MED-STOCK-GENERAL"), ("text 3", "MED-STOCK-6515")]
    sections = spark.createDataFrame(rows, "document string, policy_reference_id string")
    for c in ("document_file_path", "policy_title", "section_id", "authority"):
        sections = sections.withColumn(c, F.lit("x"))
    sections = sections.withColumn("effective_date", F.lit(NOW))
    assert names(es.rules_for(position, sections), "document") == ["text 1", "text 2"]


def test_rule_mismatches(spark):
    items = spark.createDataFrame([("a", 30), ("b", 21), ("c", 9)], "commodity_group string, base_min_days int")
    rules = spark.createDataFrame([("a", 30), ("b", 14)], "commodity_group string, base_min_days int")
    assert names(es.rule_mismatches(items, rules), "commodity_group") == ["b", "c"]


@pytest.mark.parametrize("sections_, queries_", [(4096, 1024), (50, 2)])
def test_vector_retrieval_equals_brute_force_and_block_size_does_not_matter(spark, monkeypatch, sections_, queries_):
    monkeypatch.setattr(rt, "SECTION_BLOCK", sections_)
    monkeypatch.setattr(rt, "QUERY_BLOCK", queries_)
    rng = np.random.default_rng(4)
    s, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    other = [(400, [0.0] * 8), (401, None), (None, [1.0] * 8)]
    sections = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(s)), *other], "id bigint, vector array<double>").repartition(6)
    queries = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(q)), *other], "id bigint, vector array<double>")
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (s / np.linalg.norm(s, axis=1, keepdims=True)).T
    want = {(i, int(j), r) for i in range(7) for r, j in enumerate(np.argsort(-cos[i])[:5], 1)}
    got = rt.retrieve_vectors(queries, sections, 5).collect()
    assert {(r.query_id, r.section_id, r.rank) for r in got} == want and len(got) == 35
    assert rt.retrieve_vectors(queries.limit(0), sections, 5).count() == rt.retrieve_vectors(queries, sections.limit(0), 5).count() == 0


def plain_retrieval(queries, sections, k):
    words = lambda t: Counter(t.lower().split())
    texts = {i: words(t) for i, t in sections if t is not None}
    df = Counter(w for c in texts.values() for w in c)
    out = set()
    for i, t in queries:
        asked = {w: (1 + math.log(c)) * math.log(len(texts) / df[w]) for w, c in words(t).items() if w in df}
        norm = math.sqrt(sum(x * x for x in asked.values()))
        found = []
        for j, c in texts.items():
            length = math.sqrt(sum((1 + math.log(n)) ** 2 for n in c.values()))
            score = sum(x * (1 + math.log(c[w])) for w, x in asked.items() if w in c) / (norm * length) if norm and length else 0
            if round(score, 9) > 0:
                found.append((-round(score, 9), j))
        out |= {(i, r, j) for r, (_, j) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("sections_, queries_, held", [(4096, 1024, 1 << 21), (2, 1, 3)])
def test_text_retrieval(spark, monkeypatch, sections_, queries_, held):
    for name, value in (("SECTION_BLOCK", sections_), ("QUERY_BLOCK", queries_), ("HELD_PRODUCTS", held)):
        monkeypatch.setattr(rt, name, value)
    texts = ["cold chain items need care", "supplier rate below limit", "Cold storage of cold items", "nothing to see", None, "", " \n "]
    sections = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    queries = spark.createDataFrame([(1, "cold items"), (2, "supplier limit"), (3, "unknown words"), (4, ""), (5, None)], "id bigint, text string")
    got = rt.retrieve_top_k(queries, sections, 2)
    assert sorted((r.query_id, r.rank, r.section_id) for r in got.collect()) == [(1, 1, 2), (1, 2, 0), (2, 1, 1)]
    assert rt.retrieve_top_k(queries.limit(0), sections, 2).count() == rt.retrieve_top_k(queries, sections.limit(0), 2).count() == 0


def test_ten_thousand_queries_without_a_job_before_the_result(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    hot = lambda: "the " if rng.random() < 0.7 else ""
    sections = [(i, hot() + " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(150)] + [(900, "w1 " * 20_000 + "w2")]
    queries = [(i, hot() + " ".join(rng.choices(words, k=3))) for i in range(10_000)]
    spark.sparkContext.setJobGroup("retrieval", "retrieval")
    found = rt.retrieve_top_k(spark.createDataFrame(queries, "id int, text string"), spark.createDataFrame(sections, "id int, text string"), 3)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("retrieval")
    assert {(r.query_id, r.rank, r.section_id) for r in found.collect()} == plain_retrieval(queries, sections, 3)


def test_general_sections_reach_every_position_once_whatever_the_salts(spark):
    position = spark.range(200).select("id", F.concat(F.lit("R-"), F.col("id") % 3).alias("policy_reference_id"))
    sections = spark.createDataFrame([("R-0", "a"), ("R-1", "b"), ("G", "c"), ("G", "d")], "policy_reference_id string, title string")

    def got(salts):
        return sorted(tuple(r) for r in jn.attach_policy(position, sections, "G", salts).select("id", "policy_reference_id", "title").collect())

    want = [(i, r, t) for i in range(200) for r, t in ((f"R-{i % 3}", {0: "a", 1: "b"}.get(i % 3)), ("G", "c"), ("G", "d")) if t]
    assert got(1) == got(32) == sorted(want)
