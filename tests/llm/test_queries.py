"""The registry, the pipeline and the SQL twins on the smallest tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline
from check import rows

import __spark_entry__
from claimgrid.llm import queries
from claimgrid.llm.common import stored
from claimgrid.sources.views import TABLES

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@needs_tables
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(got, df.columns) == rows(cursor.fetchall(), names)


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0
    assert counts[4] == counts[5] > 0
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


@needs_tables
def test_pipeline_on_awkward_documents(spark, tmp_path):
    from fixtures import CLASHING, awkward_texts, frame

    documents = frame(spark, awkward_texts())
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == documents.columns
        assert {v for row in docs.select(*CLASHING).distinct().collect() for v in row} == {"1"}
    documents.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
