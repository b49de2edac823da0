"""Cosine similarity join and greedy near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions.draws import dense_index
from verdictframe.operators import similarity
from verdictframe.plans.registry import query
from verdictframe.session import scratch_path
from verdictframe.sources.views import view

# The test vectors are nearly orthogonal: no pair reaches the usual 0.85.
THRESHOLD = 0.40

PAIRS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
 pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS s
  FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) {op} {t})"""


def greedy(order: str) -> str:
    """Sequential greedy pass over the ranked pairs as a recursive CTE."""
    return f"""ranked AS (SELECT i, j, row_number() OVER (ORDER BY {order}) AS n FROM pairs),
 pass(n, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT r.n,
   CASE WHEN list_contains(p.gone, r.i) OR list_contains(p.gone, r.j) THEN p.gone ELSE list_append(p.gone, r.j) END
   FROM pass p JOIN ranked r ON r.n = p.n + 1),
 removed AS (SELECT unnest(gone) AS vec_id FROM pass WHERE n = (SELECT max(n) FROM ranked))"""


BASE = PAIRS.format(op=">=", t=THRESHOLD)


@query("similar_pairs", f"WITH {BASE} SELECT i, j, round(s, 6) AS similarity FROM pairs")
def similar_pairs(spark, sf):
    pairs = similarity.similar_pairs(view(spark, sf, "embeddings"), "vec_id", "embedding", THRESHOLD)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


@query("similar_pairs_in_tiles", f"WITH {BASE} SELECT i, j, round(s, 6) AS similarity FROM pairs")
def similar_pairs_in_tiles(spark, sf):
    """The many-tile path, forced on small data by small tiles."""
    vectors = view(spark, sf, "embeddings")
    rows = max(64, vectors.count() // 6)
    pairs = similarity.similar_pairs(vectors, "vec_id", "embedding", THRESHOLD, tile_rows=rows)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


@query("deduplicated_vectors", f"WITH {BASE}, {greedy('s DESC, i, j')} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM removed)")
def deduplicated_vectors(spark, sf):
    return similarity.deduplicated(view(spark, sf, "embeddings"), "vec_id", "embedding", THRESHOLD).select("vec_id")


@query("deduplicated_by_index", f"""WITH {PAIRS.format(op='>', t=0.3)}, {greedy('i, j')}
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM removed)""")
def deduplicated_by_index(spark, sf):
    kept = similarity.deduplicated(view(spark, sf, "embeddings"), "vec_id", "embedding", 0.3, order="index")
    return kept.select("vec_id")


def with_hot_copies(spark, sf):
    """The vectors, and as many copies of the first one under other ids."""
    vectors = view(spark, sf, "embeddings").select("vec_id", "embedding")
    first = vectors.orderBy("vec_id").first()["embedding"]
    same = F.array(*[F.lit(float(x)) for x in first]).cast("array<float>")
    return vectors, vectors.select((F.col("vec_id") + 1_000_000).alias("vec_id"), same.alias("embedding"))


@query("dedup_with_copies", f"""WITH {PAIRS.format(op='>=', t=0.4)}, {greedy('s DESC, i, j')}
SELECT vec_id, 1 AS copy FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM removed)""")
def dedup_with_copies(spark, sf):
    """Half of all rows are copies of one vector; only the first survives."""
    vectors, hot = with_hot_copies(spark, sf)
    kept = similarity.deduplicated(vectors.unionByName(hot), "vec_id", "embedding", 0.4)
    return kept.select("vec_id", F.lit(1).alias("copy"))


@query("copy_stars", """SELECT (SELECT min(vec_id) FROM embeddings) AS i, vec_id + 1000000 AS j FROM embeddings""")
def copy_stars(spark, sf):
    vectors, hot = with_hot_copies(spark, sf)
    return similarity.copy_pairs(vectors.unionByName(hot), "vec_id", "embedding").select("i", "j")


# The vectors of the first hundred ids have two copies each, the first one as many as
# there are vectors: stars from the first id, ranked among the other pairs.
COPIED = f"""WITH {BASE}, stars AS (
  SELECT vec_id AS i, vec_id + 2000000 AS j, 1.0::DOUBLE AS s FROM embeddings WHERE vec_id < 100
  UNION ALL SELECT vec_id, vec_id + 3000000, 1.0 FROM embeddings WHERE vec_id < 100
  UNION ALL SELECT (SELECT min(vec_id) FROM embeddings), vec_id + 1000000, 1.0 FROM embeddings),
 every_pair AS (SELECT i, j, round(s, 9) AS s FROM (SELECT * FROM pairs UNION ALL SELECT * FROM stars))"""


def with_copies(spark, sf):
    vectors, hot = with_hot_copies(spark, sf)
    some = vectors.filter("vec_id < 100")
    for shift in (2_000_000, 3_000_000):
        vectors = vectors.unionByName(some.withColumn("vec_id", F.col("vec_id") + shift))
    return vectors.unionByName(hot)


def all_pairs(spark, sf):
    pairs = similarity.duplicate_pairs(with_copies(spark, sf), "vec_id", "embedding", THRESHOLD)
    return pairs.withColumn("similarity", F.round("similarity", 9))


@query("duplicate_pairs_with_copies", f"{COPIED} SELECT i, j, round(s, 6) AS similarity FROM every_pair")
def duplicate_pairs_with_copies(spark, sf):
    return all_pairs(spark, sf).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query("top_duplicate_pairs", f"{COPIED} SELECT i, j, round(s, 6) AS similarity FROM every_pair ORDER BY s DESC, i, j LIMIT 5")
def top_duplicate_pairs(spark, sf):
    """The most similar pairs, copies first; equal similarities by id."""
    pairs = similarity.ranked_pairs(all_pairs(spark, sf), 5)
    return pairs.select("i", "j", F.round("similarity", 6).alias("similarity"))


def ranked(pairs):
    """Global rank of every pair, numbered without a single-task sort; the pairs are found once and stored in columns."""
    folder = scratch_path(pairs.sparkSession, "ranked-pairs")
    pairs.write.parquet(folder)
    order = pairs.sparkSession.read.schema(pairs.schema).parquet(folder).select(similarity.pair_order().alias("order"))
    return dense_index(order, [], "order", "rank", bucket_by=F.col("order.s")).select("order.i", "order.j", "rank")


@query("ranked_duplicate_pairs", f"{COPIED} SELECT i, j, row_number() OVER (ORDER BY s DESC, i, j) - 1 AS rank FROM every_pair")
def ranked_duplicate_pairs(spark, sf):
    return ranked(all_pairs(spark, sf))


@query("ranked_text_id_pairs", f"""{COPIED} SELECT 'v' || lpad(i::VARCHAR, 9, '0') AS i, 'v' || lpad(j::VARCHAR, 9, '0') AS j,
 row_number() OVER (ORDER BY s DESC, i, j) - 1 AS rank FROM every_pair""")
def ranked_text_id_pairs(spark, sf):
    """Ids of any type."""
    vectors = with_copies(spark, sf).withColumn("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")))
    pairs = similarity.duplicate_pairs(vectors, "vec_id", "embedding", THRESHOLD).withColumn("similarity", F.round("similarity", 9))
    return ranked(pairs)


@query("deduplicated_text_ids", f"""WITH {BASE}, {greedy('s DESC, i, j')}
SELECT 'v' || lpad(vec_id::VARCHAR, 9, '0') AS vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM removed)""")
def deduplicated_text_ids(spark, sf):
    vectors = view(spark, sf, "embeddings").withColumn("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")))
    return similarity.deduplicated(vectors, "vec_id", "embedding", THRESHOLD).select("vec_id")


@query("deduplicated_labels", f"""WITH {BASE}, {greedy('s DESC, i, j')}
SELECT label, count(*) AS kept FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM removed) GROUP BY label""")
def deduplicated_labels(spark, sf):
    kept = similarity.deduplicated(view(spark, sf, "embeddings"), "vec_id", "embedding", THRESHOLD)
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
