import zlib

import pytest
from pyspark.sql import functions as F

from verdictframe.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.classify(docs, labels, keep=["doc_id"])
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("toxic", "predicted", "score").collect()
    hit = sum(r["toxic"] == r["predicted"] for r in rows)
    wrong = sum(r["predicted"] == 1 and r["toxic"] == 0 for r in rows)
    assert hit >= 0.94 * len(rows) and wrong <= 0.01 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_is_the_crc(spark):
    for r in spark.range(50).withColumn("h", toxicity.held_out(F.col("id"))).collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0)


def test_buckets_do_not_depend_on_the_cut(monkeypatch):
    text = "Some Tëxt with characters 😀 and more of them " * 20
    whole = toxicity.presence(text)
    monkeypatch.setattr(toxicity, "PART", 37)
    assert (toxicity.presence(text) == whole).all()
    assert not toxicity.presence("").any() and not toxicity.presence("ab").any()


def test_defined_results(spark, docs_of):
    rows = [(k, "you awful fool" if k % 2 else "a kind word") for k in range(1, 60)] + [(1, "you awful fool"), (None, "a kind word"), (100, None), (101, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.classify(docs_of(rows, extra=True), labels).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["text"]:
            assert r["predicted"] == int("fool" in r["text"])
        assert r["n"] == "own n"
    empty = {r["score"] for r in out if not r["text"]}
    assert len(empty) == 1
    assert toxicity.classify(docs_of([]), labels).count() == 0


@pytest.mark.parametrize("given, low, high", [([], 0.5, 0.5), ([(k, 0) for k in range(20)], 0.0, 0.1), ([(k, 1) for k in range(20)], 0.9, 1.0)])
def test_one_class_or_none(spark, docs_of, given, low, high):
    labels = spark.createDataFrame(given, "doc_id long, toxic int")
    out = toxicity.classify(docs_of([(k, f"text {k}") for k in range(20)]), labels).collect()
    assert all(low <= r["score"] <= high for r in out)
