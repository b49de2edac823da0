import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.oracle_check import compare, duck
from verdictframe.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    problem, rows, *_ = compare(spark, duck(SF), name, SF)
    assert problem is None and rows > 0, problem


def test_all_are_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries.QUERIES}
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        before = first.count()
        out = stage(spark, first, SF)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        first = out.checkpoint()
        assert 0 < first.count() <= before
    assert {"token_ids", "n_tokens"} <= set(first.columns)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in first.collect())


def test_stages_on_empty_tables_and_nulls(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (None, "a text", None, None, None), (1, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.count() <= len(rows)
