"""Registered queries of the training-data operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.llm import (
    byte_bpe, chat_repair, decontaminate, fill_in_middle, line_dedup, ngram_join, pii, source_divergence, token_counts, toxicity,
    url_filter, voronoi_knn, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
NEIGHBOURS = 5
QUERY_STEP = 50


def query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_filter")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged; the labelled table is a bounded sample of the urls that a rule decides."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, RULES, url_filter.labelled_by_rules(pages, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query("op2_chat_format")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired and rendered, one row per piece."""
    return chat_repair.repair(table(spark, sf_dir, "conversations"))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item found in it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(documents, table(spark, sf_dir, "benchmark"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits that its own columns give."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = F.coalesce(F.length("text"), F.lit(0))
    edits = token_counts.edits_column(
        (F.floor(size / 3), F.floor(size / 3) + 8, F.col("source")),
        (F.floor(size * 2 / 3), F.floor(size * 2 / 3), F.concat(F.lit(" "), F.col("lang"))),
        (size - 5, size, F.lit("")),
    )
    return token_counts.edited_token_counts(documents, edits, keep=["doc_id"])


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document; every maximal repeated run counts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(documents, min_words=line_dedup.EVERY_RUN)
    return left.select(
        "doc_id", "lines_deleted", "longest_run", "run_copies", F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(documents, pii.train(documents), keep=["doc_id"]).drop("found")


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_documents(documents, keep=["doc_id"], ids=False)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(documents, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
both_hold AS (
  SELECT a.doc_id AS p, b.doc_id AS q, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM held a JOIN held b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT p, q FROM both_hold WHERE 100 * i >= 85 * (na + nb - i)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.q FROM reach r JOIN links l ON r.other = l.p),
counted AS (SELECT p, count(*) AS n FROM links GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id,
  CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS n_links
FROM sets s JOIN reach r USING (doc_id) LEFT JOIN counted c ON c.p = s.doc_id GROUP BY s.doc_id, len(s.s)
"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component and links: four words, 85 percent."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


OP10_SQL = f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= {NEIGHBOURS}
"""


@query("op10_exact_top_k", OP10_SQL)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every query vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return voronoi_knn.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), NEIGHBOURS)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM held GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT h.lang, h.source, h.term, count(*) AS n FROM held h JOIN kept k USING (lang, term) GROUP BY 1, 2, 3),
size AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(lang_n) AS HUGEINT) AS lang_total FROM kept GROUP BY 1),
total AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY 1, 2),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * s.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (s.lang_total + 5 * s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term
  WHERE a.source <> b.source GROUP BY 1, 2, 3),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against its language and the other sources."""
    return source_divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d),
k AS (SELECT *, regexp_extract(url, '^[^:/?#]*://([^/?#]*)([^#]*)', ['authority', 'rest']) AS x FROM f),
u AS (SELECT *, CASE WHEN NOT regexp_matches(url, '^[^:/?#]*://') THEN lower(url) ELSE
  array_to_string(list_reverse(string_split(regexp_replace(regexp_replace(lower(x.authority), '^.*@', ''), ':[0-9]*$', ''), '.')), ',')
  || ')' || CASE WHEN x.rest = '' THEN '/' ELSE lower(x.rest) END END AS urlkey FROM k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
  urlkey, CAST(row_number() OVER (PARTITION BY urlkey ORDER BY page_id % 100000000, page_id) AS BIGINT) AS capture_rank
FROM u
"""


@query("op12_warc", OP12_SQL)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back, with its rank in the history of its address."""
    records = warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "capture_rank")


OP13_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
formed AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
   WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut, put together anew and restored."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_in_middle.fill_in_middle(documents, keep=["doc_id"])
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
