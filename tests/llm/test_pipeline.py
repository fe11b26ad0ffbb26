"""The pipeline and the registered queries over the driver's smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessella.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
        assert docs.columns == first or k == len(corpus_pipeline.STAGES) - 1
    assert len(corpus_pipeline.STAGES) == 5 and sizes[0] >= sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 100
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_over_all_documents(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.startswith(("op1_", "op2_", "op3_", "op4_", "op6_", "op9_", "op10_")):
        assert sorted(got.doc_id) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()) and len(got) == n
    if name in queries.oracle_sql():
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
        want = con.sql(queries.oracle_sql()[name]).df()
        key = ["conv_id", "turn", "kind"]
        a, b = (f.sort_values(key).reset_index(drop=True) for f in (got, want))
        assert (a.json == b.json).all() and len(a) == len(b)
