"""URL filter: rules first, then logistic regression on hashed character n-grams.

Host and path are cut out of the url; the longest rule that fits decides. For the rest a
logistic regression scores the distinct character n-grams of host and path, each hashed to one
of ``DIMENSIONS``. It is trained from a small labelled URL table of at most ``LABELLED`` rows; scoring is one
expression over the row, without a shuffle.

Defined results: a null url or one without ``://`` has empty host and path, which no rule fits; rules of equal length
go to the longer host, then to block; an untrained model (labels of one class or none) gives that class
to all (allow, if there is none); repeated rows are judged alike; null labels are left out; the added columns replace columns of their name.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.shared import bounded_sample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashed features, n-gram lengths, rows of the labelled table at most.
DIMENSIONS = 4_096
SIZES = (3, 4)
LABELLED = 4_096

Rule = tuple[str, str]  # (verdict, host and path)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: str) -> Column:
    host, slash, path = rule.partition("/")
    at_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return at_host & F.startswith(F.col("path"), F.lit(slash + path))


def longest_rule(rules: list[Rule]) -> Column:
    """struct<verdict, rule> of the longest rule that fits; null without one."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[1].partition("/")[0]), r[0] != "block"))
    choices = [F.when(fits(rule), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))) for verdict, rule in order]
    return F.coalesce(*choices) if choices else F.lit(None).cast("struct<verdict: string, rule: string>")


def with_parts(pages: DataFrame, url: str) -> DataFrame:
    return pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def hashed(seed: int):
    return lambda gram: F.pmod(F.hash(F.lit(seed), gram), F.lit(DIMENSIONS))


def features() -> Column:
    """Distinct hashed n-grams of host and path, both with end marks."""
    grams = []
    for seed, part in enumerate(("host", "path")):
        marked = F.concat(F.lit("^"), F.col(part), F.lit("$"))
        for n in SIZES:
            found = F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
            grams.append(F.transform(found, hashed(seed)))
    return F.array_distinct(F.concat(*grams))


def labelled_by_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """A labelled URL table from the urls that a rule decides: (url, label), at most ``LABELLED`` by hash."""
    rows = with_parts(pages.select(url), url).withColumn("r", longest_rule(rules)).filter(F.col("r").isNotNull())
    rows = rows.select(F.col(url).alias("url"), (F.col("r.verdict") == "block").cast("int").alias("label")).distinct()
    return bounded_sample(rows, LABELLED, "url")


def train(labelled: DataFrame) -> tuple[dict[int, float], float]:
    """(weight per feature, intercept) from a table (url, label); at most ``LABELLED`` distinct rows count."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    rows = bounded_sample(labelled.select("url", "label").filter(F.col("label").isNotNull()).distinct(), LABELLED, "url", "label")
    rows = with_parts(rows, "url").select(F.transform(features(), lambda x: x.cast("string")).alias("tokens"), F.col("label").cast("double").alias("label")).cache()
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        rows.unpersist()
        return {}, 50.0 if seen.get(1.0) else -50.0
    names = [str(k) for k in range(DIMENSIONS)]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="tokens", outputCol="features", binary=True).transform(rows)
    model = LogisticRegression(regParam=0.01, maxIter=30, standardization=False).fit(vectors)
    rows.unpersist()
    weights = {k: float(w) for k, w in enumerate(model.coefficients.toArray()) if abs(w) > 1e-12}
    return weights, float(model.intercept)


def score(weights: dict[int, float], intercept: float) -> Column:
    """Probability of block from the ``features`` column."""
    if not weights:
        return F.lit(1 / (1 + math.exp(-intercept)))
    table = F.split(F.lit(",".join(repr(weights.get(k, 0.0)) for k in range(DIMENSIONS))), ",").cast("array<double>")
    z = F.aggregate(F.col("features"), F.lit(intercept), lambda a, k: a + F.element_at(table, k + 1))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and score (probability of block) to every row."""
    weights, intercept = train(labelled)
    added = ["host", "path", "rule", "verdict", "score"]
    keep = [c for c in pages.columns if c not in added]
    rows = pages.select(*[pages[c].alias(f"_k{i}") for i, c in enumerate(keep)], pages[url].alias("_url"))
    rows = with_parts(rows, "_url").withColumn("features", features())
    rows = rows.withColumns({"r": longest_rule(rules), "score": score(weights, intercept)})
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), method).alias("verdict"), "score",
    )

