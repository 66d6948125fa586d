import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimgrid.operators import service
from claimgrid.plans import ordered
from claimgrid.plans.greedy import greedy_fit


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most of the rows."""
    rng = random.Random(1)
    rows = [
        ("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i // 7, i, rng.randint(-5, 9))
        for i in range(600)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, c int, o int, v bigint").cache()


def test_running_sum_row_number_shift(skewed):
    w = Window.partitionBy("k").orderBy("o")
    got = ordered.running_sum(skewed, ["k"], ["c"], ["o"], {"total": "v"})
    got = ordered.row_number(got, ["k"], ["c"], ["o"], "rn")
    got = ordered.shift(got, ["k"], ["c"], ["o"], {"nxt": "v"}, forward=True)
    got = ordered.shift(got, ["k"], ["c"], ["o"], {"prv": "v"}, forward=False)
    want = got.withColumns(
        {
            "w_total": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "w_rn": F.row_number().over(w),
            "w_nxt": F.lead("v").over(w),
            "w_prv": F.lag("v").over(w),
        }
    )
    bad = want.filter(
        ~(F.col("total").eqNullSafe(F.col("w_total")) & F.col("rn").eqNullSafe(F.col("w_rn"))
          & F.col("nxt").eqNullSafe(F.col("w_nxt")) & F.col("prv").eqNullSafe(F.col("w_prv")))
    )
    assert want.count() == 600 and bad.count() == 0


def brute_fit(items, cap):
    total = sum(a for _, _, a in items)
    if total <= cap:
        return {line for line, _, _ in items}
    kept, used = set(), 0
    for line, _, amount in sorted(items, key=lambda x: (-x[1], -x[2], x[0])):
        if used + amount <= cap:
            kept.add(line)
            used += amount
    return kept


@pytest.mark.parametrize("fold_limit", [1000, 0])
def test_greedy_fit_matches_brute_force(spark, fold_limit):
    rng = random.Random(7)
    rows, caps, want = [], [], set()
    for claim in range(6):
        items = [
            (line, rng.choice([0.3, 0.5, 0.9]), rng.choice([-300, 0, 100, 250, 999, 4000, 12345]))
            for line in range(40)
        ]
        cap = rng.choice([0, 500, 9000, 60000])
        caps.append((claim, Decimal(cap) / 100))
        rows += [(claim, line, conf, Decimal(a) / 100) for line, conf, a in items]
        want |= {(claim, line) for line in brute_fit(items, cap)}
    df = spark.createDataFrame(rows, "claim_id bigint, line_no int, confidence double, amount decimal(12,2)")
    limits = spark.createDataFrame(caps, "claim_id bigint, cap_amount decimal(12,2)")
    out = greedy_fit(df, limits, ["line_no"], fold_limit=fold_limit, partitions=4)
    got = {(r["claim_id"], r["line_no"]) for r in out.filter("kept").collect()}
    assert out.count() == len(rows) and got == want


def test_exact_median(spark):
    from claimgrid.operators.evaluation import exact_median

    for values in ([5.0], [1.0, 2.0], [3.5, 1.0, 9.0, 9.0], [float(i % 17) for i in range(101)]):
        ordered_values = sorted(values)
        n = len(values)
        want = (ordered_values[(n - 1) // 2] + ordered_values[n // 2]) / 2
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert exact_median(df, "x").first()["median"] == want


def test_reuse_windows(spark):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        user = 1 if rng.random() < 0.8 else rng.randint(2, 4)
        rows.append((i, user, f"h{user}", base + timedelta(seconds=rng.randint(0, 4000))))
    df = spark.createDataFrame(rows, "arrival_id bigint, user_id bigint, file_hash string, ts timestamp_ntz")
    anchors, fresh = {}, set()
    for i, _, name, ts in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        if name not in anchors or ts > anchors[name] + timedelta(minutes=10):
            anchors[name] = ts
            fresh.add(i)
    out = service.reuse_windows(df, days=10 / 1440)
    assert out.count() == 400
    assert {r["arrival_id"] for r in out.filter("is_new").collect()} == fresh


def test_reuse_windows_of_repeated_times_and_missing_values(spark):
    base = datetime(2024, 1, 1)
    rows = [(i, "a", base) for i in (5, 4, 6)] + [(7, "a", base + timedelta(days=8)), (8, None, base), (9, "a", None)]
    df = spark.createDataFrame(rows, "arrival_id bigint, file_hash string, ts timestamp_ntz")
    out = {r["arrival_id"]: (r["anchor_ts"], r["is_new"]) for r in service.reuse_windows(df, days=7).collect()}
    assert out == {4: (base, True), 5: (base, False), 6: (base, False), 7: (base + timedelta(days=8), True)}
    assert service.reuse_windows(df.limit(0), days=7).count() == 0


def test_chain_rounds_grow_with_the_logarithm(spark):
    from claimgrid.plans.ordered import next_beyond

    rng = random.Random(8)
    times = {k: sorted({rng.randint(0, n * 100) for _ in range(5 * n)}) for k, n in (("hot", 300), ("small", 3))}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k string, t long")
    edges = next_beyond(df, "k", "t", 99, "after").checkpoint()
    want = {(k, t): min((u for u in ts if u > t + 99), default=None) for k, ts in times.items() for t in ts}
    assert {(r["k"], r["t"]): r["after"] for r in edges.collect()} == want
    chain = {(k, ts[0]) for k, ts in times.items()}
    for k, ts in times.items():
        at = ts[0]
        while (at := want[k, at]) is not None:
            chain.add((k, at))
    reached, rounds = service.chain_members(edges, "k", "t", "after")
    assert sorted((r["k"], r["t"]) for r in reached.collect()) == sorted(chain)
    windows = sum(k == "hot" for k, _ in chain)
    assert windows > 150 and rounds <= windows.bit_length() <= 9


def test_quantile_chunks_spread_a_burst_and_keep_order(spark):
    rng = random.Random(4)
    base = datetime(2024, 3, 10)
    rows = [(1, i, base + timedelta(seconds=rng.randint(0, 3000))) for i in range(4000)]
    rows += [(rng.randint(2, 900), 4000 + i, base + timedelta(days=rng.randint(-300, 300))) for i in range(6000)]
    rows += [(1, 10_000, None)]
    df = spark.createDataFrame(rows, "claim_id long, decision_id long, decided_at timestamp_ntz")
    for kind in ("timestamp_ntz", "timestamp"):
        typed = df.withColumn("decided_at", F.col("decided_at").cast(kind))
        cut = ordered.cut_by_quantiles(typed, "decided_at", pieces=100)
        got = cut.collect()
        known = sorted((r["decided_at"], r["_chunk"]) for r in got if r["decided_at"])
        assert [c for _, c in known] == sorted(c for _, c in known)
        assert {r["_chunk"] for r in got if r["decided_at"] is None} == {-1}
        sizes = [r["count"] for r in cut.filter("claim_id = 1").groupBy("_chunk").count().collect()]
        assert len(sizes) >= 35 and max(sizes) <= 200
    assert ordered.cut_by_quantiles(df.limit(0), "decided_at").count() == 0
    assert {r["_chunk"] for r in ordered.cut_by_quantiles(df.filter("decided_at is null"), "decided_at").collect()} == {-1}


def test_supersede_chain_of_a_burst(spark):
    from claimgrid.operators import relational

    rng = random.Random(6)
    rows = [(1 if i % 3 else i, i, datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 50)), True) for i in range(300)]
    df = spark.createDataFrame(rows, "claim_id long, decision_id long, decided_at timestamp_ntz, is_active boolean")
    want, by_claim = {}, {}
    for claim, i, at, _ in rows:
        by_claim.setdefault(claim, []).append((at, i))
    for listed in by_claim.values():
        listed.sort()
        for here, after in zip(listed, [*listed[1:], (None, None)], strict=True):
            want[here[1]] = after[1]
    out = relational.supersede_chain(df)
    assert out.columns == [*df.columns, "superseded_by"]
    assert {r["decision_id"]: r["superseded_by"] for r in out.collect()} == want


def test_sla_metrics_checks_every_target(spark):
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=i), "quick", 100) for i in range(20)]
    rows += [(100 + i, base, "slow", ms) for i, ms in enumerate([4000, 4000, 61000])]
    df = spark.createDataFrame(rows, "metric_id bigint, ts timestamp_ntz, document_type string, processing_time_ms bigint")
    out = {r["document_type"]: r for r in service.sla_metrics(df, window=10).collect()}
    assert {k: r["total_count"] for k, r in out.items()} == {"quick": 10, "slow": 3, "ALL": 10}
    assert out["quick"]["compliant"] and not out["quick"]["alert"]
    slow = out["slow"]
    assert [slow[c] for c in ("avg_ok", "p95_ok", "p99_ok", "max_ok", "compliant", "alert")] == [False] * 5 + [True]


def test_dashboard_tasks_follow_the_rows(spark, monkeypatch):
    """A task takes a bounded number of rows, however few bytes they shrink to; the counts stay right."""
    from claimgrid.operators import relational as rel
    from claimgrid.plans import barrier

    monkeypatch.setattr(barrier, "ROWS", 100)
    n = 3000
    claims = spark.range(n).selectExpr("id AS claim_id", "'open' AS status", "CAST(2 AS DECIMAL(12,2)) AS claim_amount", "TIMESTAMP_NTZ '2024-01-05 00:00:00' AS created_at")
    decisions = spark.range(n).selectExpr("id AS claim_id", "id % 2 = 0 AS is_active", "CAST(3 AS DECIMAL(12,2)) AS proposed_benefit_amount", "50D AS confidence_score")
    docs = spark.range(2 * n).selectExpr("id % 1000 AS claim_id", "nullif(id, 7) AS document_id")
    assert barrier.tasks_for(claims, docs) == 90
    board = rel.daily_dashboard(claims, decisions, docs, "2024-01-06", 10)
    plan = board._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [claim_id" in plan and ", 105" in plan
    assert [tuple(r)[1:] for r in board.collect()] == [("open", n, n // 2, 2 * n - 1, 2.0 * n, 3.0, 50.0)]
