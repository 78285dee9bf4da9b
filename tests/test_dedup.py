import datetime as dt
import random

from pyspark.sql import functions as F

from tonetide.operators import dedup

MESSAGES = "id long, content_hash string, timestamp timestamp_ntz"


def model(messages, seen, ttl):
    """The rule, message by message: an entry lives ttl seconds after its last occurrence."""
    live, kept = dict(seen), []
    for ident, key, time in sorted(messages, key=lambda m: (m[2], m[0])):
        if not (key in live and live[key] > time):
            kept.append(ident)
        live[key] = time + dt.timedelta(seconds=ttl)
    return kept


def test_sliding_ttl_against_model(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    messages = [
        (i, rng.choice(["hot", "hot", "a", "b", f"rare{i % 40}"]), start + dt.timedelta(seconds=rng.randrange(0, 200_000) // 300 * 300))
        for i in range(1500)
    ]
    seen = [("a", start + dt.timedelta(hours=3)), ("b", start - dt.timedelta(hours=3))]
    df = spark.createDataFrame(messages, MESSAGES)
    state = spark.createDataFrame(seen, "content_hash string, expires_at timestamp_ntz")
    for ttl in (300, 3600, 40_000):
        kept = dedup.skip_recent_duplicates(df, state, ttl)
        assert sorted(r.id for r in kept.collect()) == sorted(model(messages, seen, ttl))


def test_gap_equal_to_ttl_passes(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, "h", t), (2, "h", t + dt.timedelta(seconds=3600)), (3, "h", t + dt.timedelta(seconds=7199))], MESSAGES
    )
    nothing = spark.createDataFrame([], "content_hash string, expires_at timestamp_ntz")
    assert sorted(r.id for r in dedup.skip_recent_duplicates(df, nothing).collect()) == [1, 2]


def test_renewed_state(spark):
    t = dt.datetime(2024, 1, 1)
    seen = spark.createDataFrame([("h", t), ("old", t)], "content_hash string, expires_at timestamp_ntz")
    df = spark.createDataFrame([(1, "h", t), (2, "h", t + dt.timedelta(seconds=5))], MESSAGES)
    found = {r.content_hash: r.expires_at for r in dedup.renew_seen(seen, df, 60).collect()}
    assert found == {"h": t + dt.timedelta(seconds=65), "old": t}


def test_scored_and_cached(spark):
    t = dt.datetime(2024, 1, 1)
    messages = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, content_hash string")
    results = spark.createDataFrame([("y",), ("y",)], "content_hash string")
    fresh, existing = dedup.skip_already_scored(messages, results)
    assert [r.id for r in fresh.collect()] == [1]
    assert [(r.content_hash, r.status) for r in existing.collect()] == [("y", "existing")]
    hour = dt.timedelta(hours=1)
    cache = spark.createDataFrame(
        [("y", "negative", 0.1, 0.2, t, t + hour), ("y", "positive", 0.9, 0.8, t + hour, t + 2 * hour),
         ("x", "neutral", 0.0, 0.1, t, t)],
        "content_hash string, sentiment string, score double, confidence double, "
        "cached_at timestamp_ntz, expires_at timestamp_ntz",
    )
    hydrated = {r.id: r.sentiment for r in dedup.hydrate_cached_scores(messages, cache, t).collect()}
    assert hydrated == {1: None, 2: "positive", 3: "positive"}


def test_latest_and_reconcile(spark, at):
    results = spark.createDataFrame(
        [(1, "h", at(5)), (2, "h", at(9)), (3, "h", at(9)), (4, "o", at(1))],
        "id long, content_hash string, processed_at timestamp_ntz",
    )
    assert {r.content_hash: r.id for r in dedup.latest_by_hash(results).collect()} == {"h": 2, "o": 4}
    raw = spark.createDataFrame(
        [("h", at(0)), ("h", at(2)), ("p", at(0))], "content_hash string, timestamp timestamp_ntz"
    )
    found = {r.content_hash: (r.status, r.delay_seconds) for r in dedup.reconcile_pipeline(raw, results).collect()}
    assert found == {"h": ("processed", 300.0), "p": ("pending", None), "o": ("orphan", None)}
    assert dedup.reconcile_delays(dedup.reconcile_pipeline(raw, results)).count() == 3


def test_hot_hash_is_split_over_tasks(spark):
    """A third of the rows under one hash must not meet in one window task."""
    rows = spark.range(30_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), "id")).alias("content_hash"),
        F.expr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("timestamp"),
    )
    nothing = spark.createDataFrame([], "content_hash string, expires_at timestamp_ntz")
    flagged = dedup.flag_recent_duplicates(rows, nothing, 3600)
    assert flagged.filter("is_duplicate").count() == 9_999
