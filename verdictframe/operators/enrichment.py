"""Matching questions to resources and issues, and the enriched prompts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictframe.functions import charsim
from verdictframe.functions import keywords as kw
from verdictframe.functions.gramindex import PAIRS, GramIndex, best_texts
from verdictframe.session import truncate

# Weights of the relevance score per source.
SOURCES = ["stackoverflow", "official_docs", "github_repo"]
KEYWORD_WEIGHT = {"stackoverflow": 40.0, "official_docs": 50.0, "github_repo": 40.0}
TEXT_WEIGHT = {"stackoverflow": 20.0, "official_docs": 20.0, "github_repo": 30.0}
LANGUAGE_WEIGHT = 30.0
VOTE_WEIGHT, VOTE_CAP = 30.0, 5000.0
ANSWER_WEIGHT, ANSWER_CAP = 10.0, 50.0
TITLE_CHARS, ISSUE_CHARS = 100, 200
SAME_CATEGORY, OTHER_CATEGORY = 1.5, 0.5
LANGUAGES = list(kw.LANGUAGE_INDICATORS)


def _by_source(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for source, value in values.items():
        out = F.when(F.col("source") == source, F.lit(value)).otherwise(out)
    return out


def question_signatures(questions: DataFrame) -> DataFrame:
    """Questions with keyword set and language; without keywords nothing matches."""
    return questions.withColumn("q_keywords", kw.keywords(F.col("instruction"))).withColumn(
        "q_language", kw.language_of(F.col("instruction"))
    )


def resource_features(resources: DataFrame) -> DataFrame:
    """What the score needs of a resource, independent of the question.

    ``langs`` are the question languages that earn its language bonus: for docs
    those containing the doc language, for repositories those named in the repo.
    """
    vocabulary = F.array(*[F.lit(w) for w in kw.TECHNICAL_KEYWORDS])
    own = (
        F.when(F.col("source") == "stackoverflow", F.col("tags"))
        .when(F.col("source") == "official_docs", F.col("topics"))
        .otherwise(F.split("repo", "/"))
    )
    # coalesce: a resource without tags matches no keyword
    lowered = F.transform(F.coalesce(own, F.array().cast("array<string>")), F.lower)
    matched = F.array_sort(F.array_intersect(vocabulary, lowered))
    languages = F.array(*[F.lit(name) for name in LANGUAGES])
    doc_language = F.coalesce("language", F.lit(""))
    langs = (
        F.when(
            F.col("source") == "official_docs",
            F.filter(languages, lambda n: (doc_language != "") & n.contains(doc_language)),
        )
        .when(F.col("source") == "github_repo", F.filter(languages, lambda n: F.lower("repo").contains(n)))
        .otherwise(F.array().cast("array<string>"))
    )
    quality = F.least(F.coalesce("votes", F.lit(0)) / VOTE_CAP, F.lit(1.0)) * VOTE_WEIGHT + F.least(
        F.coalesce("answer_count", F.lit(0)) / ANSWER_CAP, F.lit(1.0)
    ) * ANSWER_WEIGHT
    return resources.filter(F.col("source").isin(SOURCES)).select(
        "rid", "source",
        matched.alias("r_keywords"), langs.alias("langs"),
        F.when(F.col("source") == "stackoverflow", quality).otherwise(F.lit(0.0)).alias("quality"),
        F.substring(F.lower(F.coalesce("title", F.lit(""))), 1, TITLE_CHARS).alias("text"),
    )


def _keyword_free(language: Column) -> Column:
    bonus = F.when(F.array_contains("langs", language), F.lit(LANGUAGE_WEIGHT)).otherwise(F.lit(0.0))
    return F.col("quality") + bonus


def _top(df: DataFrame, keys: list[str], score: str, k: int, name: str = "rank") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "rid")
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def match_resources(questions: DataFrame, resources: DataFrame, k: int = 5) -> DataFrame:
    """Top-k resources per question by the score without its text term, exact.

    Questions are reduced to distinct (keywords, language) signatures, resources
    to the k best of each (source, keywords, languages) class: members of a
    class differ only in their quality part, so no other member can reach a
    top-k. A signature then meets
    the classes it shares a keyword with, by an equi-join on the keyword, and
    the k best resources of its language that need no keyword at all. Neither
    side is crossed with the other.
    """
    signed = question_signatures(questions).filter(F.size("q_keywords") > 0)
    return _best_without_text(signed, resource_features(resources), k)


def _best_without_text(signed: DataFrame, features: DataFrame, k: int) -> DataFrame:
    signatures = signed.select("q_keywords", "q_language").distinct()
    best = _top(features.drop("text"), ["source", "r_keywords", "langs"], "quality", k, "_class").drop("_class")
    by_word = signatures.withColumn("word", F.explode("q_keywords")).join(
        best.withColumn("word", F.explode("r_keywords")), "word"
    ).drop("word")
    free = best.withColumn("q_language", F.explode(F.array(*[F.lit(n) for n in LANGUAGES])))
    free = free.withColumn("_free", _keyword_free(F.col("q_language")))
    free = _top(free.filter(F.col("_free") > 0), ["q_language"], "_free", k, "_r").drop("_free", "_r")
    by_language = signatures.join(free, "q_language")
    candidates = by_word.unionByName(by_language).dropDuplicates(["q_keywords", "q_language", "rid"])
    hits = F.size(F.array_intersect("q_keywords", "r_keywords")) / F.size("q_keywords")
    score = hits * _by_source(KEYWORD_WEIGHT) + _keyword_free(F.col("q_language"))
    scored = candidates.withColumn("score", score).filter(F.col("score") > 0)
    top = _top(scored, ["q_keywords", "q_language"], "score", k)
    return signed.select("uid", "q_keywords", "q_language").join(
        top.select("q_keywords", "q_language", "rid", "source", "score", "rank"),
        ["q_keywords", "q_language"],
    ).select("uid", "rid", "source", "score", "rank")


# -------------------------------------------------------- character similarity

#: Bytes of questions searched at once, and rows of one index, whose lists of grams are built together in memory.
QUESTION_BYTES, INDEX_ROWS = 8 << 20, 2_000
#: Texts per index and question that are tried for a first k-th best score, and rows to look for them in, at the least.
SEEDS, SEED_ROWS = 6, 1_000


def _blocks(rows: Iterator[Row], size: int) -> Iterator[list[Row]]:
    """Rows (uid, category, text) in blocks of about ``size`` bytes."""
    held, total = [], 0
    for row in rows:
        if held and total >= size:
            yield held
            held, total = [], 0
        held.append(row)
        total += 200 + 4 * len(row["text"] or "")
    if held:
        yield held


def match_issues(
    questions: DataFrame, issues: DataFrame, k: int = 3, question_bytes: int = QUESTION_BYTES, index_rows: int = INDEX_ROWS,
    tried: Accumulator | None = None,
) -> DataFrame:
    """Top-k issues per question by text similarity, own category weighted up.

    Equal scores keep the own category first, then the order of the issues. The issues stay where they are: each task builds
    inverted lists of grams over its own ones, and the questions come to it in broadcast blocks of a fixed size. A first pass tries the
    few most likely issues of a share of each index, which gives a score that the k-th best one reaches at least; in the second the
    lists of all issues leave only what can reach it. ``tried`` counts the ratios computed.
    """
    spark = questions.sparkSession
    prefix = F.substring(F.lower(F.coalesce("instruction", F.lit(""))), 1, ISSUE_CHARS).alias("text")
    right = issues.select(F.col("rid").cast("long").alias("rid"), "category", prefix)
    count = right.count()
    parts = max(math.ceil(count / index_rows), spark.sparkContext.defaultParallelism)
    right = truncate(right.repartition(parts, "rid"))
    few = right.filter(F.pmod(F.xxhash64("rid", F.lit("seeds")), F.lit(min(max(count // SEED_ROWS, 1), 16))) == 0)
    left = questions.select("uid", "category", prefix)
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("uid", left.schema["uid"].dataType)])
    schema = schema.add("rid", "long").add("score", "double").add("order", "long")
    best = Window.partitionBy("place", "uid").orderBy(F.desc("score"), "order")
    found = None
    for block in _blocks(left.toLocalIterator(), question_bytes):
        asked = spark.sparkContext.broadcast([(n, r["uid"], r["category"], r["text"]) for n, r in enumerate(block)])

        def search(where: DataFrame, floors: dict[int, float], at_most: int | None, asked=asked) -> DataFrame:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in _slices(batches, index_rows):
                    index = GramIndex(part["text"].tolist())
                    rid, category = part["rid"].to_numpy(), part["category"].to_numpy()
                    none, rows = np.zeros(len(part)), []

                    def weights(n, none=none, rid=rid, category=category):
                        same = category == asked.value[n][2]
                        return none, np.where(same, SAME_CATEGORY, OTHER_CATEGORY), rid + np.where(same, 0, 2**62)

                    texts = [text for *_, text in asked.value]
                    known = [floors.get(n, 0.0) for n in range(len(texts))]
                    for n, hits, count in best_texts(index, texts, weights, known, k, at_most):
                        rows += [(n, asked.value[n][1], int(rid[row]), score, order) for score, order, row in hits]
                        if tried is not None:
                            tried.add(count)
                    yield pd.DataFrame(rows, columns=["place", "uid", "rid", "score", "order"])

            hits = where.mapInPandas(run, schema)
            return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

        seeds = search(few, {}, k + SEEDS).filter(F.col("rank") == k).select("place", "score").collect()
        top = truncate(search(right, {r["place"]: r["score"] for r in seeds}, None))
        asked.unpersist()
        found = top if found is None else found.unionByName(top)
    if found is None:
        found = spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    return found.select("uid", "rid", "score", "rank")


def _slices(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a task, ``rows`` at the most together."""
    held, size = [], 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[: rows - size], batch.iloc[rows - size :]
            held.append(part)
            size += len(part)
            if size == rows:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


#: Resources per signature that are read for a first k-th best score.
FIRST_READ = 32


def _text_scores(pairs: DataFrame) -> DataFrame:
    """(uid, rid, source, score) of pairs (uid, q_text, rid, source, text, fixed, floor) that can reach their floor."""
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = ["uid", "q_text", "rid", "source", "text", "fixed", "floor"]
    # a question of very many candidates is dealt to several tasks; the work of a pair is far above its bytes
    dealt = pairs.select(*columns).repartition(parts, "uid", F.pmod(F.xxhash64("rid"), F.lit(8)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), PAIRS):
                part = batch.iloc[first : first + PAIRS]
                which, texts = pd.factorize(part["q_text"])
                a, a_bounds = charsim.codes_of(list(texts))
                b, bounds = charsim.codes_of(part["text"].tolist())
                length = np.maximum(np.diff(a_bounds)[which] + np.diff(bounds), 1)
                fixed, factor = part["fixed"].to_numpy(), part["source"].map(TEXT_WEIGHT).to_numpy()
                reach = fixed + factor * 2.0 * charsim.shared(a, a_bounds, which, b, bounds) / length
                able = np.flatnonzero(reach >= part["floor"].to_numpy() - 1e-9)
                part, which = part.iloc[able], which[able]
                b, bounds = charsim.codes_of(part["text"].tolist())
                found = charsim.matched(a, a_bounds, which, b, bounds, charsim.beginners(b, bounds))
                ratio = 2.0 * found / length[able]
                yield part[["uid", "rid", "source"]].assign(score=fixed[able] + factor[able] * ratio)

    kinds = [f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("uid", "rid", "source")]
    return dealt.mapInPandas(run, ", ".join([*kinds, "score double"])).filter("score > 0")


def _fixed_score(hits: Column, language: Column) -> Column:
    return hits * _by_source(KEYWORD_WEIGHT) + F.when(F.array_contains("langs", language), F.lit(LANGUAGE_WEIGHT)).otherwise(F.lit(0.0))


def resource_candidates(asked: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs of questions (uid, q_text, q_keywords, q_language, floor) and resources whose score may reach the floor.

    Resources are lists, one per source, keyword set and languages, ordered by quality. A signature of questions knows a list's
    other points, so it reads a list only down to the quality that, with the full text weight, still makes its lowest
    floor. Lists are cut by whole points of quality, the key of the join.
    """
    lists = ["source", "r_keywords", "langs"]
    tops = features.groupBy(*lists).agg(F.max("quality").alias("top"))
    signatures = asked.groupBy("q_keywords", "q_language").agg(F.min("floor").alias("lowest"))
    wanted = signatures.withColumn("source", F.explode(F.array(*[F.lit(s) for s in SOURCES])))
    opened = wanted.join(tops, "source")
    hits = F.size(F.array_intersect("q_keywords", "r_keywords")) / F.size("q_keywords")
    opened = opened.withColumn("rest", _fixed_score(hits, F.col("q_language")))
    need = F.greatest(F.col("lowest") - F.col("rest") - _by_source(TEXT_WEIGHT) - 1e-9, F.lit(0.0))
    opened = opened.withColumn("need", need).filter("top >= need").withColumn(
        "point", F.explode(F.sequence(F.floor("need"), F.floor("top")))
    )
    read = opened.join(features.withColumn("point", F.floor("quality")), [*lists, "point"]).filter("quality >= need")
    read = read.select("q_keywords", "q_language", "rid", "source", "text", (F.col("rest") + F.col("quality")).alias("fixed"))
    pairs = asked.join(read, ["q_keywords", "q_language"])
    return pairs.filter(F.col("fixed") + _by_source(TEXT_WEIGHT) >= F.col("floor") - 1e-9)


def match_resources_by_text(questions: DataFrame, resources: DataFrame, k: int = 5, first_read: int = FIRST_READ) -> DataFrame:
    """Top-k resources per question by the full score, text similarity included.

    A threshold search in two reads: the ``first_read`` best resources without the text term give a k-th score; then the
    lists are read down to the entries that cannot beat it any more.
    """
    asked = truncate(question_signatures(questions).filter(F.size("q_keywords") > 0).select(
        "uid", F.substring(F.lower("instruction"), 1, TITLE_CHARS).alias("q_text"), "q_keywords", "q_language"
    ))
    features = truncate(resource_features(resources))
    first = _best_without_text(asked, features, first_read).select("uid", "rid", F.col("score").alias("fixed"))
    pairs = first.join(asked, "uid").join(features.select("rid", "source", "text"), "rid").withColumn("floor", F.lit(0.0))
    by_score = Window.partitionBy("uid").orderBy(F.desc("score"), "rid")
    floors = _text_scores(pairs).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k)
    floors = truncate(floors.select("uid", F.col("score").alias("floor")))
    asked = asked.join(floors, "uid", "left").fillna(0.0, ["floor"])
    scored = _text_scores(resource_candidates(asked, features))
    top = scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return top.select("uid", "rid", "source", "score", "rank")


# ------------------------------------------------------------ enriched prompts

RULE = "=" * 80


def capped_per_source(matches: DataFrame, per_source: int = 2) -> DataFrame:
    """The first matches of each source of a question, in rank order."""
    order = Window.partitionBy("uid", "source").orderBy("rank")
    return matches.withColumn("source_rank", F.row_number().over(order)).filter(
        F.col("source_rank") <= per_source
    )


def enriched_prompts(questions: DataFrame, matches: DataFrame, resources: DataFrame) -> DataFrame:
    """Instruction plus a section per source with its two best resources.

    ``matches`` has at most k rows per question, so the collected sections are
    bounded. Questions without a match keep their instruction.
    """
    details = capped_per_source(matches).join(resources.drop("source"), "rid")
    one = F.format_string("_Relevance: %.1f/100_\n", "score")
    topics = F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 3), ", ")
    link = F.concat(F.lit("🔗 "), "url", F.lit("\n"))
    entry = (
        F.when(F.col("source") == "stackoverflow", F.concat(
            F.lit("\n**"), F.substring("title", 1, 80), F.lit("**\n👍 "),
            F.col("votes").cast("string"), F.lit(" votes | 💬 "),
            F.col("answer_count").cast("string"), F.lit(" answers\n"), link, one,
        ))
        .when(F.col("source") == "official_docs", F.concat(
            F.lit("\n**"), "title", F.lit("**\n"),
            F.when(topics != "", F.concat(F.lit("Topics: "), topics, F.lit("\n"))).otherwise(""),
            link, one,
        ))
        .otherwise(F.concat(F.lit("\n**"), "repo", F.lit("** - "), "title", F.lit("\n"), link, one))
    )
    # Section headings in display order.
    headings = {
        "stackoverflow": "\n### 💬 Stack Overflow Q&A\n",
        "official_docs": "\n### 📖 Official Documentation\n",
        "github_repo": "\n### 🐙 Code Examples\n",
    }

    def section(source: str) -> Column:
        rows = F.array_sort(F.collect_list(
            F.when(F.col("source") == source, F.struct(F.col("source_rank"), entry.alias("entry")))
        ))
        text = F.array_join(F.transform(rows, lambda r: r["entry"]), "")
        return F.when(text != "", F.concat(F.lit(headings[source]), text)).otherwise("")

    parts = details.groupBy("uid").agg(F.concat(*[section(s) for s in SOURCES]).alias("sections"))
    head = f"\n\n{RULE}\n📚 **HELPFUL RESOURCES & REFERENCES**\n{RULE}\n"
    joined = questions.join(parts, "uid", "left")
    text = F.when(
        F.col("sections").isNotNull(),
        F.concat("instruction", F.lit(head), "sections", F.lit(f"\n{RULE}")),
    ).otherwise(F.col("instruction"))
    return joined.select("uid", "category", text.alias("enriched"))


def issue_prompts(questions: DataFrame, matches: DataFrame, issues: DataFrame) -> DataFrame:
    """Instruction plus a numbered list of its related issues."""
    details = matches.join(issues.withColumnRenamed("instruction", "body").drop("category"), "rid")
    title = F.substring(F.split("body", "\n")[0], 1, 80)
    entry = F.concat(
        F.lit("\n"), F.col("rank").cast("string"), F.lit(". **"), title, F.lit("**\n   - Source: "),
        "source_name", F.lit("\n   - Difficulty: "), "difficulty", F.lit("\n   - Language: "),
        "language", F.lit("\n   - Link: "), "url", F.lit("\n"),
    )
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), entry.alias("entry"))))
    parts = details.groupBy("uid").agg(
        F.array_join(F.transform(rows, lambda r: r["entry"]), "").alias("entries")
    )
    head = "\n\n---\n\n**Related Real-World Examples from GitHub:**\n"
    joined = questions.join(parts, "uid", "left")
    text = F.when(
        F.col("entries").isNotNull(), F.concat("instruction", F.lit(head), "entries")
    ).otherwise(F.col("instruction"))
    return joined.select("uid", "category", text.alias("enriched"))


def packaged(questions: DataFrame, matches: DataFrame, resources: DataFrame) -> DataFrame:
    """Questions with their matches as one nested record."""
    details = matches.join(resources.drop("source"), "rid")
    rows = F.array_sort(F.collect_list(F.struct(
        F.col("rank"), "source", "title", F.round("score", 2).alias("score"),
        F.struct("votes", F.col("answer_count").alias("answers"), "repo").alias("metadata"),
    )))
    parts = details.groupBy("uid").agg(rows.alias("mapped"))
    empty = F.coalesce(F.size("mapped"), F.lit(0))
    joined = questions.join(parts, "uid", "left")
    return joined.select(
        "uid", "category",
        F.struct(
            F.col("instruction").alias("original_instruction"),
            F.col("mapped").alias("mapped_resources"),
            F.greatest(empty, F.lit(0)).alias("num_resources"),
            kw.keywords(F.col("instruction")).alias("detected_keywords"),
        ).alias("enrichment"),
    )


def enrichment_stats(packages: DataFrame, digits: int = 2) -> DataFrame:
    """Tasks and mean number of mapped resources per category."""
    return packages.groupBy("category").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.round(F.avg("enrichment.num_resources"), digits).alias("mean_resources"),
    )


# ---------------------------------------------------------- issues and sources

def collected_issues(issues: DataFrame) -> DataFrame:
    """Landed issues as tasks: no pull requests, with a body, 400 characters."""
    rows = issues.filter(~F.col("is_pull_request") & (F.coalesce("body", F.lit("")) != ""))
    repo = F.col("repo")
    return rows.select(
        F.concat(F.lit("github-"), F.replace(repo, F.lit("/"), F.lit("-")), F.lit("-"),
                 F.col("number").cast("string")).alias("uid"),
        F.substring(F.concat("title", F.lit("\n\n"), "body"), 1, 400).alias("instruction"),
        "category", kw.difficulty(F.col("labels")).alias("difficulty"),
        kw.repo_language(repo).alias("language"),
        F.concat(F.lit("https://github.com/"), repo, F.lit("/issues/"), F.col("number").cast("string")).alias("source"),
        F.concat(F.lit("GitHub - "), repo).alias("source_name"),
        F.lit("github").alias("source_type"), "author", "repo", "label_pos", "number",
    )


def capped_per_repo(tasks: DataFrame, n: int) -> DataFrame:
    """First n tasks of each repository in label order, then fetch order."""
    order = Window.partitionBy("repo").orderBy("label_pos", "number")
    return tasks.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def curated_docs(table: DataFrame) -> DataFrame:
    """``category -> language -> docs`` maps flattened to one row per doc."""
    rows = table.select("category", F.explode("languages").alias("lang", "docs"))
    docs = rows.select("category", "lang", F.explode("docs").alias("doc"))
    slug = F.replace(F.lower("doc.title"), F.lit(" "), F.lit("-"))
    return docs.select(
        F.concat(F.lit("docs-"), "lang", F.lit("-"), slug).alias("uid"),
        "category", F.col("doc.title").alias("title"), F.col("doc.url").alias("url"),
        F.col("doc.topics").alias("topics"), F.coalesce("doc.language", "lang").alias("language"),
        F.lit("official_docs").alias("source"),
    )
