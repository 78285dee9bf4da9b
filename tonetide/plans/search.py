"""Queries: embeddings, nearest neighbours, near-duplicates, term search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.operators import vectors
from tonetide.plans.views import DOC_TOKENS, _values
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources.embeddings import EmbeddingTable
from tonetide.sources.postings import TermIndex
from tonetide.sources.vector_groups import VectorGroups


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero vector elements of every document."""
    embedded = vectors.embed_text(fx.table(spark, sf_dir, "documents"), 64)
    cells = embedded.select("doc_id", F.posexplode("embedding").alias("position", "weight"))
    return cells.filter("weight <> 0").select(
        "doc_id", F.col("position").cast("long").alias("position"), F.round("weight", 6).alias("weight")
    )


def knn_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to the mean vector of every label."""
    corpus = fx.v_emb(spark, sf_dir)
    hits = vectors.knn_search(corpus, fx.v_centroids(spark, sf_dir), 10, ["label"])
    return hits.select(
        "query_id",
        "vec_id",
        F.col("rank").cast("long").alias("rank"),
        F.round("distance", 6).alias("distance"),
        F.round("similarity", 6).alias("similarity"),
        F.col("label").cast("long").alias("label"),
    )


def knn_search_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every twentieth vector, from a stored table of vector groups."""
    corpus = fx.v_emb(spark, sf_dir)
    index = VectorGroups.build(spark, fresh_path(spark, "vector-groups"), corpus)
    asked = corpus.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = index.search(asked, 10)
    return hits.select(
        "query_id",
        "vec_id",
        F.col("rank").cast("long").alias("rank"),
        F.abs(F.round("distance", 6)).alias("distance"),
    )


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vectors.near_duplicate_pairs(fx.v_emb_dups(spark, sf_dir))
    return pairs.withColumn("similarity", F.round("similarity", 6))


def drop_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.drop_near_duplicates(fx.v_emb_dups(spark, sf_dir))


def lookup_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the ids that labelled documents name."""
    ids = fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    found = vectors.lookup_embeddings(fx.v_emb(spark, sf_dir), ids)
    return found.select(
        "vec_id",
        F.size("embedding").cast("long").alias("width"),
        F.element_at("embedding", 1).cast("double").alias("first_element"),
    )


def upsert_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table upserted with later versions of half the labels, then new ids; folded in between."""
    current = fx.v_emb(spark, sf_dir).select("vec_id", "embedding", "created_at")
    path = fresh_path(spark, "embeddings")
    table = EmbeddingTable.create(spark, path, current.schema, 16)
    table.upsert(current)
    moved = F.transform("embedding", lambda x: (x * F.lit(2).cast("float")).cast("float"))
    newer = fx.v_emb(spark, sf_dir).filter("label >= 5").select(
        "vec_id", moved.alias("embedding"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at")
    )
    added = newer.withColumn("vec_id", F.col("vec_id") + 5_000_000)
    table.upsert(newer)
    table.compact()
    EmbeddingTable(spark, path).upsert(added)
    return table.read().select(
        "vec_id", "created_at", F.element_at("embedding", 1).cast("double").alias("first_element")
    )


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index: some sources first, with other texts; then all documents."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    some = docs.where("source < 'src5'")
    path = fresh_path(spark, "terms")
    index = TermIndex.create(spark, path, docs.schema["doc_id"], ("text",), 8)
    index.append(some.withColumn("text", F.concat_ws(" ", "text", "text")))
    index = TermIndex(spark, path)
    index.append(docs)
    hits = index.search(fx.v_terms(spark))
    return hits.withColumn("rank", F.col("rank").cast("long"))


def evict_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.evict_embeddings(fx.v_emb(spark, sf_dir), 317).select("vec_id", "created_at")


QUERIES = {
    f.__name__: f
    for f in (
        embed_text, knn_search, knn_search_grouped, near_duplicate_pairs, drop_near_duplicates, lookup_embeddings,
        upsert_embeddings, term_search, evict_embeddings,
    )
}

_PAIRS = """
units AS (SELECT vec_id, embedding::double[] AS e FROM v_emb_dups),
alike AS (SELECT b.vec_id, a.vec_id AS partner, list_cosine_similarity(a.e, b.e) AS s
  FROM units a JOIN units b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
pairs AS (SELECT vec_id, min(partner) AS duplicate_of, arg_min(s, partner) AS similarity FROM alike GROUP BY 1)"""
_TERMS = _values(fx.SEARCH_TERMS)

ORACLES = {
    "embed_text": f"""
WITH counts AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 AS position, count(*) AS n
  FROM (SELECT doc_id, unnest({DOC_TOKENS}) AS t FROM documents) GROUP BY 1, 2)
SELECT doc_id, position, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM counts""",
    "knn_search": """
WITH scored AS (SELECT query_id, vec_id, label,
    1 - list_cosine_similarity(v_emb.embedding::double[], v_centroids.embedding) AS distance FROM v_emb, v_centroids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, rank, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity,
  label::bigint AS label FROM ranked WHERE rank <= 10""",
    "knn_search_grouped": """
WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id,
    round(1 - list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 9) AS distance
  FROM v_emb v, v_emb q WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, rank, abs(round(distance, 6)) AS distance FROM ranked WHERE rank <= 10""",
    "near_duplicate_pairs": f"WITH {_PAIRS.strip()} SELECT vec_id, duplicate_of, round(similarity, 6) AS similarity FROM pairs",
    "drop_near_duplicates": f"""WITH {_PAIRS.strip()},
chain AS (SELECT vec_id AS node, duplicate_of AS root FROM pairs UNION
  SELECT node, duplicate_of FROM chain JOIN pairs ON root = vec_id),
roots AS (SELECT node, min(root) AS root FROM chain GROUP BY 1)
SELECT u.vec_id, duplicate_of IS NULL AS keep, duplicate_of, coalesce(root, u.vec_id) AS group_id
FROM units u LEFT JOIN pairs USING (vec_id) LEFT JOIN roots ON u.vec_id = node /* RECURSIVE */""",
    "lookup_embeddings": """
SELECT vec_id, len(embedding) AS width, embedding[1]::double AS first_element FROM v_emb
WHERE vec_id IN (SELECT doc_id FROM labels)""",
    "upsert_embeddings": """
SELECT vec_id, created_at, embedding[1]::double AS first_element FROM v_emb WHERE label < 5
UNION ALL SELECT vec_id, created_at + INTERVAL 1 DAY, (embedding[1] * 2)::double FROM v_emb WHERE label >= 5
UNION ALL SELECT vec_id + 5000000, created_at + INTERVAL 1 DAY, (embedding[1] * 2)::double FROM v_emb WHERE label >= 5""",
    "term_search": f"""
WITH terms AS (SELECT DISTINCT query_id, lower(term) AS term FROM (VALUES {_TERMS}) q(query_id, term)),
found AS (SELECT query_id, doc_id, count(*) AS hits, count(DISTINCT term) AS n
  FROM (SELECT doc_id, unnest({DOC_TOKENS}) AS term FROM documents) JOIN terms USING (term) GROUP BY 1, 2),
ranked AS (SELECT query_id::bigint AS query_id, doc_id, hits,
    row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank
  FROM found JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id, n))
SELECT * FROM ranked WHERE rank <= 10""",
    "evict_embeddings": """
SELECT vec_id, created_at FROM v_emb ORDER BY created_at DESC, vec_id DESC LIMIT 317""",
}
