import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tonetide.functions.vectors import bands_needed
from tonetide.operators import search, vectors
from tonetide.session import fresh_path
from tonetide.sources import tables

VECTORS = "vec_id long, embedding array<float>"


def frame(spark, rows, start=0, schema=VECTORS):
    return spark.createDataFrame([(start + i, [float(x) for x in v]) for i, v in enumerate(rows)], schema)


def test_four_wide_order(spark):
    corpus = frame(spark, [[1, 0, 0, 0], [0, 1, 0, 0], [0.7071, 0.7071, 0, 0]], 1)
    query = spark.createDataFrame([(9, [1.0, 0.1, 0.0, 0.0])], "query_id long, embedding array<float>")
    hits = vectors.knn_search(corpus, query, 3).orderBy("rank").collect()
    assert [h.vec_id for h in hits] == [1, 3, 2]
    assert [h.vec_id for h in vectors.knn_search(corpus, query, 2).orderBy("rank").collect()] == [1, 3]
    assert abs(hits[0].similarity + hits[0].distance - 1) < 1e-12


def test_identical_text_is_a_duplicate(spark):
    texts = spark.createDataFrame(
        [(1, "Apple stock price rises"), (2, "Apple stock price rises"), (3, "Central bank holds rates"), (4, "!!")],
        "doc_id long, text string",
    )
    embedded = vectors.embed_text(texts, 64)
    assert embedded.filter("embedding IS NULL").count() == 1
    usable, rejects = vectors.split_vectors(embedded.withColumnRenamed("doc_id", "vec_id"), 64)
    assert [r.reason for r in rejects.collect()] == ["null"]
    pairs = vectors.near_duplicate_pairs(usable).collect()
    assert [(p.vec_id, p.duplicate_of) for p in pairs] == [(2, 1)]
    assert pairs[0].similarity >= 0.95


def test_vector_rejects(spark):
    df = frame(spark, [[1, 2], [0, 0], [1, 2, 3]])
    usable, rejects = vectors.split_vectors(df, 2)
    assert [r.vec_id for r in usable.collect()] == [0]
    assert {r.vec_id: r.reason for r in rejects.collect()} == {1: "zero_norm", 2: "width"}


def test_scan_and_blocks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    corpus, asked = rng.standard_normal((300, 8)), rng.standard_normal((40, 8))
    corpus[17] = corpus[5]  # tie: smaller id first
    unit = corpus / np.linalg.norm(corpus, axis=1, keepdims=True)
    want = set()
    for q, v in enumerate(asked):
        d = np.round(1 - unit @ (v / np.linalg.norm(v)), 9)
        want |= {(q, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(300), d))[:7])}
    left = frame(spark, corpus, schema="vec_id long, embedding array<double>")
    right = frame(spark, asked, schema="query_id long, embedding array<double>")
    for options in ({}, {"query_bytes_bound": 0, "block_rows": 64}):
        hits = vectors.knn_search(left.repartition(5), right, 7, **options).collect()
        assert {(h.query_id, h.vec_id, h.rank) for h in hits} == want
    own = left.select(left.vec_id.alias("query_id"), "embedding")
    nearest = vectors.knn_search(left, own, 1, query_bytes_bound=0, block_rows=64).collect()
    assert {(h.query_id, h.vec_id) for h in nearest} == {(i, 5 if i == 17 else i) for i in range(300)}


def clustered(rng, groups=60, size=6, dim=16, noise=0.06):
    centres = rng.standard_normal((groups, dim))
    rows = np.repeat(centres, size, axis=0) + noise * rng.standard_normal((groups * size, dim))
    return rng.permutation(rows)


def first_partners(rows, threshold=0.95):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    similarity = unit @ unit.T
    found = {}
    for i in range(len(rows)):
        earlier = np.flatnonzero(similarity[i, :i] >= threshold)
        if len(earlier):
            found[i] = int(earlier[0])
    return found


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = clustered(rng).astype(np.float32).astype(np.float64)
    rows[100] = rows[3]
    rows[200] = rows[3]
    want = first_partners(rows)
    assert len(want) > 150
    df = frame(spark, rows, schema="vec_id long, embedding array<double>")
    for options in ({}, {"method": "lsh"}, {"method": "exact", "block_rows": 50}):
        found = {r.vec_id: r.duplicate_of for r in vectors.near_duplicate_pairs(df, **options).collect()}
        assert found == want
    marked = vectors.drop_near_duplicates(df).collect()
    assert {r.vec_id for r in marked if not r.keep} == set(want)
    for r in marked:
        root = r.vec_id
        while root in want:
            root = want[root]
        assert r.group_id == root


def test_near_duplicates_of_a_third_of_the_rows(spark):
    """A crowd of near copies costs one row per member, and is still whole."""
    rng = np.random.default_rng(1)
    crowd = rng.standard_normal(16) + 0.001 * rng.standard_normal((700, 16))
    rows = np.concatenate([crowd, rng.standard_normal((1400, 16))])
    df = frame(spark, rows, schema="vec_id long, embedding array<double>")
    pairs = vectors.near_duplicate_pairs(df, method="lsh")
    found = {r.vec_id: r.duplicate_of for r in pairs.collect()}
    assert found == first_partners(rows)
    assert sum(v == 0 for v in found.values()) == 699


def test_band_plan():
    agree = 1 - np.arccos(0.95) / np.pi
    for bits in (8, 12, 20):
        bands = bands_needed(0.95, bits, 1e-6)
        assert (1 - agree**bits) ** bands <= 1e-6 < (1 - agree**bits) ** (bands - 1)


def test_eviction_keeps_the_newest(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(seconds=(i * 7919) % 9000 // 50 * 50)) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, created_at timestamp_ntz")
    order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    for capacity in (1, 137, 899, 900, 5000):
        kept = vectors.evict_embeddings(df, capacity)
        assert {r.vec_id for r in kept.collect()} == {i for i, _ in order[:capacity]}


def test_upsert_rewrites_only_touched_buckets(spark, at):
    layout = "vec_id long, embedding array<float>, created_at timestamp_ntz"
    old = spark.createDataFrame([(i, [1.0, float(i)], at(0)) for i in range(50)], layout)
    path = fresh_path(spark, "vectors")
    tables.write_embedding_buckets(old, path, 8)
    new = spark.createDataFrame([(3, [9.0, 9.0], at(1)), (4, [8.0, 8.0], at(-1)), (99, [7.0, 7.0], at(1))], layout)
    tables.upsert_embedding_table(new, path, 8)
    stored = {r.vec_id: r.embedding[0] for r in spark.read.parquet(path).collect()}
    assert len(stored) == 51 and stored[3] == 9.0 and stored[4] == 1.0 and stored[99] == 7.0
    ids = spark.createDataFrame([(3,), (1000,)], "vec_id long")
    assert vectors.lookup_embeddings(spark.read.parquet(path), ids).count() == 1


def test_term_search(spark):
    docs = spark.createDataFrame(
        [(1, "Apple Stock News", "Apple stock rises on strong iPhone sales"),
         (2, "Tesla Update", "Tesla announces new model production"),
         (3, "Market Analysis", "Stock market shows positive trends")],
        "doc_id long, title string, body string",
    )
    queries = spark.createDataFrame([(1, "Apple"), (2, "stock"), (2, "MARKET"), (3, "none")], "query_id long, term string")
    for hits in (
        search.term_search(search.build_term_index(docs, ("title", "body")), queries),
        search.term_search_scan(docs, queries, fields=("title", "body")),
    ):
        assert {(h.query_id, h.doc_id, h.hits, h.rank) for h in hits.collect()} == {(1, 1, 2, 1), (2, 3, 3, 1)}


def test_embedding_buckets_are_md5_based(spark):
    import hashlib

    row = vectors.embed_text(spark.createDataFrame([(1, "Sky sky blue")], "doc_id long, text string"), 32).first()
    bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32
    assert abs(row.embedding[bucket("sky")] - 2 / 5**0.5) < 1e-12


def test_own_embedder(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, "a")], "doc_id long, text string")
    made = vectors.embed_text(
        texts, embedder=lambda df: df.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(1.0)))
    )
    assert {r.doc_id: r.embedding for r in made.collect()} == {1: [3.0, 1.0], 2: [1.0, 1.0]}


def test_one_over_wide_row_is_the_only_reject(spark):
    """The usual width is the valid one, not the widest."""
    good = [(i, [1.0, 0.1 * (i // 2), 0.0]) for i in range(6)]
    df = spark.createDataFrame([*good, (99, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    usable, rejects = vectors.split_vectors(df)
    assert usable.count() == 6
    assert [(r.vec_id, r.reason) for r in rejects.collect()] == [(99, "width")]
    for method in ("lsh", "exact"):
        found = {r.vec_id for r in vectors.near_duplicate_pairs(df, 0.999999, method).collect()}
        assert found == {1, 3, 5}
    queries = df.withColumnRenamed("vec_id", "query_id")
    for bound in (0, 1 << 24):
        hits = vectors.knn_search(df, queries, 2, query_bytes_bound=bound).collect()
        assert {h.query_id for h in hits} == set(range(6)) and len(hits) == 12


def test_embedding_counts_slices_not_whole_batches(spark):
    """Values do not depend on the slices that bound the working arrays."""
    import pyarrow as pa

    from tonetide.functions.vectors import TEXT_STEP, token_counts_to_unit

    rng = np.random.default_rng(3)
    words = pa.array([None if i == 7 else [f"w{j}" for j in rng.integers(0, 50, i % 9)] for i in range(650)])
    whole = token_counts_to_unit(16, 10_000).func(words)
    for step in (1, 7, TEXT_STEP):
        assert token_counts_to_unit(16, step).func(words).equals(whole)
    assert TEXT_STEP < 650 and len(token_counts_to_unit(16).func(words.slice(0, 0))) == 0
