"""Toxicity by a character n-gram linear classifier on naive Bayes features.

A text's features are the distinct character n-grams (3 to 5 code points, lower case)
hashed to ``BUCKETS``. Over a bounded sample of labelled rows each feature gets its
naive Bayes log-count ratio; the ``FEATURES`` with the largest weighted ratios are
kept, presence is scaled by the ratio, and a logistic regression is fitted on that.
Scoring is one pass over the texts with a table of one float per bucket.

Defined results: null or empty text scores by the intercept alone; documents without an
id are scored but never train; several labels of one document count as toxic if one is; null
labels are no labels; without any label of one of the two classes every score is the smoothed share of
toxic rows (0.5 with no row). Repeated rows get equal scores, ties of the selection go to the
smaller bucket, and added columns replace columns of their name.

``SAMPLE`` bounds the rows that train, taken by the hash of the id; everything else is unbounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictframe.llm.shared import bounded_sample

#: Labelled rows that train at most.
SAMPLE = 16_384
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
FEATURES = 4_096
SIZES = (3, 4, 5)
#: Characters hashed at once; parts of a longer text overlap by the longest n-gram.
PART = 1 << 20


def held_out(key: Column) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, with repeats."""
    text = text.lower()
    for first in range(0, max(len(text), 1), PART):
        codes = np.frombuffer(text[first : first + PART + SIZES[-1] - 1].encode("utf-32-le"), dtype=np.uint32)
        h = np.zeros(len(codes), dtype=np.uint32)
        for n in range(1, SIZES[-1] + 1):
            h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
            if len(codes) < n:
                break
            if n in SIZES:
                yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def presence(text: str) -> np.ndarray:
    flags = np.zeros(BUCKETS, dtype=bool)
    for ids in buckets_of(text):
        flags[ids] = True
    return flags


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Ids and labels that train: at most ``SAMPLE``, by the hash of the id."""
    one = (
        labels.select(labels[key].alias("_id"), labels[label].cast("int").alias("_y"))
        .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    return bounded_sample(one, SAMPLE, "_id")


def class_counts(rows: DataFrame) -> DataFrame:
    """Documents of each class that hold a bucket, from rows (_text, _y); one partial count per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        size = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[int(y > 0)] += presence(text.as_py() or "")
                size[int(y > 0)] += 1
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.array(np.append(counts[0, used], size[0])),
             pa.array(np.append(counts[1, used], size[1]))],
            names=["bucket", "clean", "toxic"],
        )

    parts = rows.select("_text", "_y").mapInArrow(run, "bucket long, clean long, toxic long")
    return parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def feature_tokens(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """The chosen buckets of each row as string tokens, with the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [
                [str(b) for b in chosen[presence(t.as_py() or "")[chosen]].tolist()] for t in batch.column(0)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens, type=pa.list_(pa.string())), batch.column(1).cast(pa.float64())], names=["tokens", "y"]
            )

    return rows.select("_text", "_y").mapInArrow(run, "tokens array<string>, y double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """(weight per bucket as float64, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    chosen_rows = F.broadcast(training_rows(docs, labels, key, label))  # SAMPLE rows of two numbers
    rows = (
        docs.select(docs[key].alias("_id"), docs[text].alias("_text")).join(chosen_rows, "_id")
        .select("_text", F.col("_y"))
    )
    counts = class_counts(rows).cache()
    size = counts.filter("bucket = -1").first()
    clean, toxic = (size["clean"] or 0, size["toxic"] or 0) if size else (0, 0)
    weights = np.zeros(BUCKETS)
    if not clean or not toxic:
        counts.unpersist()
        return weights, math.log((toxic + 0.5) / (clean + 0.5)) if clean + toxic else 0.0
    ratio = F.log((F.col("toxic") + 1) / F.lit(toxic + 2.0)) - F.log((F.col("clean") + 1) / F.lit(clean + 2.0))
    # every partition sends FEATURES rows to the driver: few partitions of the bounded table
    best = (
        counts.filter("bucket >= 0").withColumn("ratio", ratio).coalesce(4)
        .orderBy(F.desc(F.abs("ratio") * F.sqrt(F.col("toxic") + F.col("clean"))), "bucket").limit(FEATURES)
        .select("bucket", "ratio").collect()
    )
    counts.unpersist()
    best.sort(key=lambda r: r["bucket"])
    chosen = np.array([r["bucket"] for r in best], dtype=np.int64)
    ratios = [float(r["ratio"]) for r in best]
    tokens = feature_tokens(rows, chosen).cache()
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in chosen], inputCol="tokens", outputCol="counts", binary=True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratios), inputCol="counts", outputCol="features")
    regression = LogisticRegression(labelCol="y", regParam=0.003, maxIter=40, tol=1e-5, standardization=False, aggregationDepth=2)
    model = regression.fit(scaled.transform(vectors.transform(tokens)))
    tokens.unpersist()
    weights[chosen] = model.coefficients.toArray() * np.array(ratios)
    return weights, float(model.intercept)


def score_documents(
    docs: DataFrame, weights: np.ndarray, intercept: float, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); ``keep`` names the columns carried along."""
    added = ["score", "predicted"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    fields = {f.name: f for f in docs.schema.fields}
    work = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    used = np.flatnonzero(weights)
    slots = np.zeros(BUCKETS, dtype=np.int16)
    slots[used] = np.arange(1, len(used) + 1)
    values = np.concatenate([[0.0], weights[used]])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for t in batch.column(n):
                seen = np.zeros(len(values), dtype=bool)
                for ids in buckets_of(t.as_py() or ""):
                    seen[slots[ids]] = True
                z = intercept + float(values[seen].sum())
                scores.append(1 / (1 + math.exp(-max(min(z, 500.0), -500.0))))
            s = np.array(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*keep, *added],
            )

    schema = T.StructType([fields[c] for c in keep]).add("score", "double").add("predicted", "integer")
    return work.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             keep: list[str] | None = None) -> DataFrame:
    """Fits on the labelled rows of ``docs`` and scores all of ``docs``."""
    return score_documents(docs, *fit(docs, labels, key, text, label), text=text, keep=keep)
