"""Splittable CSV against Python's reader, over splits far smaller than a file."""

import csv
import random

import pytest

from claimgrid.sources import quoted_csv, tables

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "512")
    yield spark
    spark.conf.set(SPLIT, before)


def cell(r):
    parts = ["word", "a,b", 'said "so"', "two\nlines", "\n", '"', "x" * r.randrange(60), "ünïcode", "1"]
    return "-" + "".join(r.choice(parts) for _ in range(r.randrange(1, 5)))


def written(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=end).writerows([["id", "Some Text", "note"], *rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_splits(small_splits, tmp_path, end):
    spark, r = small_splits, random.Random(len(end))
    rows = [[str(i), cell(r), cell(r)] for i in range(300)]
    rows[150][1] = "-" + "long cell\n" * 200  # spans several splits
    written(tmp_path / "a.csv", rows[:200], end)
    written(tmp_path / "b.csv", rows[200:], end)
    assert quoted_csv.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    got = quoted_csv.read(spark, str(tmp_path))
    assert got.columns == ["id", "Some Text", "note"]
    assert sorted(tuple(x) for x in got.collect()) == sorted(map(tuple, rows))
    whole = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.collect()))


def test_blanks_and_short_rows(small_splits, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('\nid,Some Text,note\n\n1,,""\n   \n2,"a\n\nb"\n3,x,y,z\n\n4,"end","of file"')
    got = sorted(map(tuple, quoted_csv.read(small_splits, str(path)).collect()))
    whole = small_splits.read.options(header=True, multiLine=True, escape='"').csv(str(path))
    assert got == [("1", None, None), ("2", "a\n\nb", None), ("3", "x", "y"), ("4", "end", "of file")]
    assert got == sorted(tuple(x) for x in whole.collect() if (x["id"] or "").strip())


def test_header_only(small_splits, tmp_path):
    written(tmp_path / "h.csv", [])
    got = quoted_csv.read(small_splits, str(tmp_path))
    assert got.columns == ["id", "Some Text", "note"] and got.count() == 0


def test_one_claims_file_feeds_many_tasks(small_splits, tmp_path):
    with open(tmp_path / "c.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["Tracking Number", "Claim Date", "Amount of Claim", "Status", "PM Explanation"])
        for i in range(200):
            out.writerow([i if i % 10 else "", "2022-01-02", f"${i}.50", "Posted", f'note "{i}",\nsecond line'])
    claims, validation, rejects = tables.load_claims_csv(small_splits, str(tmp_path / "c.csv"))
    assert (claims.count(), rejects.count()) == (180, 20)
    notes = {x["claim_tracking_number"]: x["adjudication_notes"] for x in validation.collect()}
    assert notes["37"] == 'note "37",\nsecond line'
    assert claims._jdf.queryExecution().optimizedPlan().toString().count("from_csv") <= 1
