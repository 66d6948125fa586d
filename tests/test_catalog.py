"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import rows

from claimgrid import catalog
from claimgrid.sources.views import TABLES

FOLDER = "/root/testdata/sf0.001"
REGISTRY = catalog.load_all()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    df = catalog.run(name, spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = REGISTRY[name].sql
    if sql is None:
        assert df.columns
        return
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(cursor.fetchall(), names)


def test_quality_of_empty_and_missing_texts(spark, tmp_path):
    """An empty text is one page, which is blank and needs review; a missing one has no page."""
    texts = ["", None, " ", "\n\n", "word " * 9, "word " * 10, "form | " * 12 + "\n\nfew"]
    folder = f"{tmp_path}/documents.parquet"
    rows_in = [(95 + n, text, "es" if n % 2 else None) for n, text in enumerate(texts)]
    spark.createDataFrame(rows_in, "doc_id long, text string, lang string").write.parquet(folder)
    df = catalog.run("document_quality", spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{folder}/*.parquet'")
    cursor = connection.execute(REGISTRY["document_quality"].sql)
    names = [d[0] for d in cursor.description]
    got = df.collect()
    assert rows([tuple(r) for r in got], df.columns) == rows(cursor.fetchall(), names)
    reasons = {r["doc_id"]: r["reasons"] for r in got}
    assert reasons[95] == "Blank pages detected: 1|Pages needing review: 1"
    assert reasons[96] == "Document type could not be determined"
