import numpy as np
import pytest

from tonetide.functions.vectors import agreement
from tonetide.operators import sign_buckets, vectors
from tonetide.session import cut_lineage, fresh_path
from tonetide.sources.vector_groups import GROUP, VectorGroups

from test_vectors import first_partners, frame

DOUBLES = "vec_id long, embedding array<double>"


def nearest(corpus, asked, k):
    unit = corpus / np.linalg.norm(corpus, axis=1, keepdims=True)
    want = set()
    for q, v in enumerate(asked):
        d = np.round(1 - unit @ (v / np.linalg.norm(v)), 12)
        order = np.lexsort((np.arange(len(corpus)), d))[:k]
        want |= {(q, int(i), r + 1) for r, i in enumerate(order)}
    return want


def clouds(rng, groups=12, size=60, dim=8):
    return np.repeat(rng.standard_normal((groups, dim)), size, axis=0) + 0.05 * rng.standard_normal(
        (groups * size, dim)
    )


@pytest.fixture
def cloud(spark):
    rng = np.random.default_rng(11)
    rows = clouds(rng)
    rows[100:400] = rows[100]  # a third and more are one vector: ties, and a hot group
    asked = np.concatenate([rows[::37], rng.standard_normal((15, 8))])
    df = frame(spark, rows, schema=DOUBLES)
    queries = frame(spark, asked, schema=DOUBLES).withColumnRenamed("vec_id", "query_id")
    return rows, asked, df, queries


def test_groups_give_what_a_scan_gives(spark, cloud):
    rows, asked, df, queries = cloud
    path = fresh_path(spark, "groups")
    VectorGroups.build(spark, path, df.repartition(6))
    index = VectorGroups(spark, path)
    assert index.layout.counts.sum() == len(rows)
    want = nearest(rows, asked, 7)
    for options in ({}, {"query_bytes_bound": 0, "block_rows": 50}):
        hits = index.search(queries, 7, **options).collect()
        assert {(h.query_id, h.vec_id, h.rank) for h in hits} == want
    # k above the table: everything is found
    assert index.search(queries.limit(2), 1000).count() == 2 * len(rows)


def test_far_groups_are_not_read(spark, cloud):
    rows, _, df, _ = cloud
    index = VectorGroups.build(spark, fresh_path(spark, "groups"), df, 12)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    asked = unit[[3, 700]]
    kth = np.array([np.sort(1 - unit @ q)[4] for q in asked])
    first, further = index.layout.first_groups(asked, 5), index.layout.further_groups(asked, kth, 5)
    assert all(len(a) + len(b) <= 4 for a, b in zip(first, further))
    plan = index._scan(np.array([0]), asked[:1], first[:1], 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and f"{GROUP}#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_sampled_centres_and_odd_vectors(spark, cloud):
    rows, asked, df, queries = cloud
    odd = spark.createDataFrame(
        [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 9), (9004, [None] + [1.0] * 7)], DOUBLES
    )
    index = VectorGroups.build(spark, fresh_path(spark, "groups"), df.unionByName(odd), sample_rows=30)
    assert index.layout.counts.sum() == len(rows)
    bad = odd.withColumnRenamed("vec_id", "query_id")
    hits = index.search(queries.unionByName(bad), 3).collect()
    assert {(h.query_id, h.vec_id, h.rank) for h in hits} == nearest(rows, asked, 3)


def test_empty_tables(spark, cloud):
    _, _, df, queries = cloud
    index = VectorGroups.build(spark, fresh_path(spark, "groups"), df.limit(0))
    assert index.search(queries, 3).count() == 0
    full = VectorGroups.build(spark, fresh_path(spark, "groups"), df)
    for bound in (0, 1 << 24):
        assert full.search(queries.limit(0), 3, query_bytes_bound=bound).count() == 0
    with pytest.raises(FileNotFoundError):
        VectorGroups(spark, fresh_path(spark, "none"))


def test_crowded_buckets_split_and_lose_nothing(spark):
    """A narrow cone: nearly all vectors share their first signs, few are alike."""
    rng = np.random.default_rng(23)
    rows = 1.0 + 0.42 * rng.standard_normal((900, 24))
    rows[500:700] = rows[:200] + 0.05 * rng.standard_normal((200, 24))
    want = first_partners(rows)
    assert 200 <= len(want) < 700
    distinct = frame(spark, rows, schema="rep long, embedding array<double>")
    links = sign_buckets.links(distinct, 0.95, 1e-6, salts=3, few_open=16).collect()
    assert {r.rep: r.partner for r in links} == want


def test_split_plan_keeps_the_bound():
    for threshold in (0.8, 0.95, 0.99):
        for bits in (4, 10, 16):
            bands, subs = sign_buckets.plan(threshold, bits, 1e-6)
            same = agreement(threshold)
            a_split = 1 - (1 - same**sign_buckets.STEP_BITS) ** subs
            assert a_split >= 1 - sign_buckets.SPLIT_MISS
            assert (1 - same**bits * a_split**sign_buckets.SPLITS) ** bands <= 1e-6
    assert sign_buckets.first_bits(0) == 4 and sign_buckets.first_bits(10**9) == 16
    assert vectors.DUPLICATE_SIMILARITY == 0.95


def test_groups_of_near_copies_write_no_more_than_their_members(spark, monkeypatch):
    """Groups of 400 around a centre, at about the threshold from each other: one answer per band."""
    rng = np.random.default_rng(31)
    centres = np.repeat(rng.standard_normal((4, 24)), 400, axis=0)
    rows = centres + 0.22 * rng.standard_normal(centres.shape)
    distinct = frame(spark, rows, schema="rep long, embedding array<double>")
    written = []

    def counted(df, name):
        table = cut_lineage(df, name)
        written.append(table.count())
        return table

    monkeypatch.setattr(sign_buckets, "cut_lineage", counted)
    links = sign_buckets.links(distinct, 0.95, 1e-6).collect()
    bands, _ = sign_buckets.plan(0.95, sign_buckets.first_bits(len(rows)), 1e-6)
    assert {r.rep: r.partner for r in links} == first_partners(rows)
    assert sum(written) <= len(rows) * (bands + 1)


def test_buckets_beyond_a_task_give_the_same(spark):
    rng = np.random.default_rng(37)
    rows = 1.0 + 0.42 * rng.standard_normal((600, 24))
    rows[400:] = rows[:200] + 0.05 * rng.standard_normal((200, 24))
    distinct = frame(spark, rows, schema="rep long, embedding array<double>")
    links = sign_buckets.links(distinct, 0.95, 1e-6, salts=3, few_open=16, task_rows=100).collect()
    assert {r.rep: r.partner for r in links} == first_partners(rows)


def test_a_task_leaves_k_hits_per_query(spark):
    """However many groups and batches it scans; ties go to the smaller id."""
    rows = np.random.default_rng(41).standard_normal((1200, 8))
    rows[600:] = rows[:600]
    df = frame(spark, rows)
    index = VectorGroups.build(spark, fresh_path(spark, "groups"), df, groups=60)
    ids = index.layout.ids.tolist()
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = index._scan(np.arange(5), unit[:5], [ids] * 5, 4)
    assert found.count() <= 5 * 4 * found.rdd.getNumPartitions()
    queries = frame(spark, rows[:5]).withColumnRenamed("vec_id", "query_id")
    for bound in (0, 1 << 24):
        hits = index.search(queries, 4, query_bytes_bound=bound).collect()
        got = sorted((r.query_id, r.rank, r.vec_id) for r in hits)
        away = np.round(1.0 - unit[:5] @ unit.T, 12)
        want = [(q, i + 1, int(v)) for q in range(5) for i, v in enumerate(np.lexsort((np.arange(1200), away[q]))[:4])]
        assert got == want
