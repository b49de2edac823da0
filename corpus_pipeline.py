"""Cleaning and encoding of the documents table in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` stores every stage's result, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from verdictframe.llm.shared import stored

#: Bytes of rows that a Python worker gets at once; Spark's default is 64 MB, of which a stage on texts holds several copies.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects go."""
    bounded(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels).filter("predicted = 0").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; a document of which no word is left goes, too."""
    bounded(spark)
    left = line_dedup.dedup_lines(docs, min_words=line_dedup.EVERY_RUN)
    touched = F.col("lines_deleted") > 0
    left = left.filter(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    bounded(spark)
    return ngram_join.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    bounded(spark)
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: Fitted scores, suffix ranks and token tables have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
