"""Streams over several micro-batches against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimgrid.operators import decide
from claimgrid.sources.views import Tables
from claimgrid.streaming import jobs
from claimgrid.streaming.store import BucketedStore, hash_bucket

START = dt.datetime(2024, 1, 1)


def arriving(spark, folder, batches, schema):
    """A stream that takes one file of rows at a time."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
        time.sleep(0.05)  # files are taken by their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return stream.parquet(str(folder))


# ---- batch progress ------------------------------------------------------------------------

STATUS = "batch_id string, claim_id long, event_id long, ts timestamp, status string"


def rollup_of(rows):
    newest = {}
    for batch, claim, event, ts, status in rows:
        newest[batch, claim] = max(newest.get((batch, claim), (ts, -1, "")), (ts, event, status))
    out = {}
    for (batch, _), (_, _, status) in newest.items():
        n = out.setdefault(batch, [0, 0, 0, 0])
        for i, hit in enumerate((True, status in ("completed", "failed"), status == "completed", status == "failed")):
            n[i] += hit
    return {k: tuple(v) for k, v in out.items()}


def test_batch_progress_over_epochs(spark, tmp_path):
    r = random.Random(3)
    names = ["pending", "processing", "completed", "failed"]
    rows = [(f"b{r.randrange(3)}", r.randrange(30), k, START + dt.timedelta(minutes=r.randrange(600)), r.choice(names)) for k in range(300)]
    stream = arriving(spark, tmp_path / "in", [rows[:100], rows[100:200], rows[200:]], STATUS)
    # All events are within the delay, so none is late.
    run = jobs.run_batch_progress(stream, f"{tmp_path}/out", f"{tmp_path}/cp", delay="2 days")
    got = {x[0]: tuple(x)[1:] for x in run.result.select("batch_id", "claim_count", "processed_count", "successful_count", "failed_count").collect()}
    assert got == rollup_of(rows)
    assert run.late_rows == 0


def test_state_expires_and_late_events_are_counted(spark, tmp_path):
    """Days of claims that are each seen once: the state holds the last days only."""
    days = [[("b", 100 * d + c, 100 * d + c, START + dt.timedelta(days=d), "pending") for c in range(20)] for d in range(12)]
    late = [("b", 1, 9999, START - dt.timedelta(days=1), "failed")]
    stream = arriving(spark, tmp_path / "in", [*days, late], STATUS)
    run = jobs.run_batch_progress(stream, f"{tmp_path}/out", f"{tmp_path}/cp", delay="10 minutes", ttl_days=2)
    row = run.result.first()
    assert (row["claim_count"], row["failed_count"]) == (240, 0)
    assert run.late_rows == 1
    assert 0 < run.state_rows <= 2 * 3 * 20  # a value and a timer for each claim of the last days, not of all twelve


# ---- windows -------------------------------------------------------------------------------

METRIC = "ts timestamp, document_type string, processing_time_ms long, confidence double, tier string"


def test_windows_merge_exactly(spark, tmp_path):
    r = random.Random(4)
    rows = [
        (START + dt.timedelta(minutes=k / 10 + r.random()), r.choice(["lease", "invoice", None]), r.choice([None, 5, 70_000, r.randrange(900)]), 100 * r.random(), r.choice(["tier1_x", "tier2_y"]))
        for k in range(1200)
    ]
    late = (START - dt.timedelta(hours=5), "lease", 1, 1.0, "tier1_x")
    stream = arriving(spark, tmp_path / "in", [rows[:500], rows[500:900], [*rows[900:], late]], METRIC)
    run = jobs.run_sla_windows(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    want = {}
    for ts, kind, value, *_ in rows:
        want.setdefault((ts.replace(minute=0, second=0, microsecond=0), kind), []).append(value)
    assert run.late_rows == 1 and run.result.count() == len(want)
    for row in run.result.collect():
        values = want[row["start"].replace(tzinfo=None), row["document_type"]]
        known = [v for v in values if v is not None]
        ranked = sorted(values, key=lambda v: (v is not None, v or 0))
        assert row["documents"] == len(values) and row["max_time_ms"] == max(known)
        assert row["avg_time_ms"] == pytest.approx(sum(known) / len(known))
        assert row["p95_time_ms"] == ranked[min(int(len(values) * 0.95), len(values) - 1)]
        assert row["violations"] == sum(v > 60_000 for v in known)


def test_written_again(spark, tmp_path):
    """A batch that runs twice leaves one result, and a later count replaces an earlier one."""
    schema = spark.createDataFrame([], "key long, n long").schema
    store = BucketedStore(spark, f"{tmp_path}/store", schema, hash_bucket("key", buckets=4))
    assert store.read().count() == 0 and store.current(["key"]).count() == 0
    first = spark.createDataFrame([(k, 1) for k in range(50)], schema)
    second = spark.createDataFrame([(k, 2) for k in range(10)], schema)
    for rows, epoch in ((first, 0), (first, 0), (second, 1), (second, 1)):
        store.write(rows, epoch)
    assert store.read().count() == 60 and store.read(epoch=0).count() == 50
    assert {tuple(r) for r in store.current(["key"]).collect()} == {(k, 2 if k < 10 else 1) for k in range(50)}


def test_only_touched_buckets_are_listed(spark, tmp_path):
    schema = spark.createDataFrame([], "key long").schema
    store = BucketedStore(spark, f"{tmp_path}/store", schema, hash_bucket("key", buckets=8))
    store.write(spark.range(200).withColumnRenamed("id", "key"), 0)
    touched = store.touched(spark.createDataFrame([(5,), (5,)], schema))
    assert len(touched) == 1
    known = store.read(touched, 0)
    assert known.inputFiles() and all(f"bucket={touched[0]}/" in f for f in known.inputFiles())
    assert 0 < known.count() < 200 and known.filter("key = 5").count() == 1


# ---- adjudication --------------------------------------------------------------------------


def test_adjudication_by_arrival(spark, tmp_path):
    """Items of a claim that come in different batches; the second batch reads its buckets alone."""
    tables = Tables(spark, "/root/testdata/sf0.001")
    items = tables.items.select("claim_id", "description", "amount", "charge_date").filter("claim_id < 400").cache()
    parts = items.withColumn("part", F.pmod(F.xxhash64(*items.columns), F.lit(3)))
    for k in range(3):
        parts.filter(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    original = BucketedStore.read

    def spy(self, buckets=None, epoch=None):
        rows = original(self, buckets, epoch)
        if self.path.endswith("items"):
            seen.append((set(buckets), {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}))
        return rows

    BucketedStore.read = spy
    try:
        run = jobs.run_adjudication(stream, tables.claims, tables.documents, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=16)
    finally:
        BucketedStore.read = original
    assert len(seen) == 3 and all({int(b) for b in read} <= asked for asked, read in seen)
    batch = decide.evaluate_claims(tables.claims, items, tables.documents).join(items.select("claim_id").distinct(), "claim_id", "left_semi")
    flat = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert flat(run.result) == flat(batch)


def test_first_batch_is_worked_out_once(spark, tmp_path, monkeypatch):
    """A batch is stored before anything is asked of it, and its buckets are told from the store."""
    asked = []
    monkeypatch.setattr(BucketedStore, "touched", lambda self, rows: asked.append(self.path))
    tables = Tables(spark, "/root/testdata/sf0.001")
    items = tables.items.select("claim_id", "description", "amount", "charge_date").filter("claim_id < 200")
    items.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
    run = jobs.run_adjudication(stream, tables.claims, tables.documents, f"{tmp_path}/out", f"{tmp_path}/cp", buckets=4)
    store = BucketedStore(spark, f"{tmp_path}/out/items", items.schema, hash_bucket("claim_id", buckets=4))
    assert not asked and store.written(0) == [0, 1, 2, 3] and store.written(1) == []
    assert run.result.count() == items.select("claim_id").distinct().count()
