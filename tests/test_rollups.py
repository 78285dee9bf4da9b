import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tonetide.operators import alerts, errors, logs, metrics, retention, summaries

RESULTS = (
    "source_id string, timestamp timestamp_ntz, source_type string, sentiment_score decimal(5,4), "
    "sentiment_label string, confidence_score decimal(5,4)"
)


def results(spark, rows):
    """(minute, source, score, label)"""
    start = dt.datetime(2024, 1, 1)
    full = [
        (f"s{i % 2}", start + dt.timedelta(minutes=m), s, Decimal(str(v)), label, Decimal("0.5"))
        for i, (m, s, v, label) in enumerate(rows)
    ]
    return spark.createDataFrame(full, RESULTS)


def test_hourly_daily_volume(spark):
    df = results(spark, [(0, "a", 0.5, "positive"), (30, "a", 0.7, "positive"), (61, "a", -0.2, "negative")])
    first = summaries.hourly_sentiment_summary(df).orderBy("hour").first()
    assert (first["count"], first.avg_score, first.min_score, first.max_score) == (2, 0.6, 0.5, 0.7)
    days = {r.sentiment_label: r.score_stddev for r in summaries.daily_sentiment_summary(df).collect()}
    assert days == {"positive": 0.141421, "negative": None}
    volume = summaries.source_volume_metrics(df).orderBy("hour").first()
    assert (volume.message_count, volume.unique_sources) == (2, 2)


def test_stats_bounds_inclusive_and_empty(spark, at):
    df = results(spark, [(0, "a", 0.5, "positive"), (10, "a", 0.1, "neutral"), (20, "b", -0.5, "negative")])
    rows = {r.sentiment: r for r in summaries.sentiment_stats(df, None, at(0), at(10)).collect()}
    assert rows["(total)"]["count"] == 2 and rows["(total)"].avg_score == 0.3
    assert set(rows) == {"positive", "neutral", "(total)"}
    empty = summaries.sentiment_stats(df, "zzz").collect()
    assert [(r.sentiment, r["count"], r.avg_score) for r in empty] == [("(total)", 0, 0.0)]


def test_recent_window_is_strict(spark, at):
    df = results(spark, [(0, "a", 0.5, "positive"), (1, "a", 0.5, "positive")])
    assert summaries.recent_window_summary(df, at(60)).first()["count"] == 1


def test_refresh_equals_full(spark, at):
    df = results(spark, [(m * 17, "ab"[m % 2], (m % 9) / 10, "positive") for m in range(200)])
    cut = F.lit(at(1000)).cast("timestamp_ntz")
    old, new = df.filter(F.col("timestamp") < cut), df.filter(F.col("timestamp") >= cut)
    for view, (summarise, _) in summaries.SUMMARY_VIEWS.items():
        fresh = summaries.refresh_summary(view, summarise(old), df, new)
        assert sorted(map(str, fresh.collect())) == sorted(map(str, summarise(df).collect()))


def test_error_sample_moves_at_101(spark, at):
    def log(first, last):
        return spark.createDataFrame(
            [(i, "c", "t", f"m{i}", at(i)) for i in range(first, last + 1)],
            "id long, component string, error_type string, message string, timestamp timestamp_ntz",
        )

    for n, sample in {1: "m1", 100: "m1", 101: "m101", 200: "m101", 201: "m201", 250: "m201"}.items():
        row = errors.error_summary(log(1, n)).first()
        assert (row.error_count, row.sample_message) == (n, sample)
    prior = errors.error_summary(log(1, 60))
    kept = errors.error_summary(log(61, 90), prior).first()
    assert (kept.error_count, kept.sample_message) == (90, "m1")
    moved = errors.error_summary(log(61, 130), prior).first()
    assert (moved.error_count, moved.sample_message, moved.first_occurrence) == (130, "m101", at(1))
    unseen = errors.error_summary(log(1, 2).withColumn("component", F.lit("d")), prior)
    assert unseen.count() == 2


def test_recent_errors_strict(spark, at):
    df = spark.createDataFrame(
        [("c", "t", 1, at(0), at(0), "m"), ("c", "u", 1, at(0), at(60), "m")],
        "component string, error_type string, error_count long, first_occurrence timestamp_ntz, "
        "last_occurrence timestamp_ntz, sample_message string",
    )
    found = errors.recent_errors(df, at(24 * 60)).collect()
    assert [(r.error_type, r.hours_since_last) for r in found] == [("u", 23.0)]


def test_exact_percentiles(spark, at):
    values = [1.5, 2.0, 2.0, 10.0, 500.25, 3.0, 0.0]
    df = spark.createDataFrame(
        [("c", "m", Decimal(str(v)), "ms", at(1)) for v in values],
        "component string, metric_name string, metric_value decimal(10,4), metric_unit string, timestamp timestamp_ntz",
    )
    row = metrics.performance_rollup(df).first()
    want = sorted(values)
    assert row.p50_value == want[3]
    assert row.p95_value == round(want[5] + (want[6] - want[5]) * 0.7, 6)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.4), ("a", 70.0)], "source string, latency_seconds double")
    found = {r.le: r.cumulative_count for r in metrics.latency_histogram(df).collect()}
    assert (found["0.1"], found["0.5"], found["60"], found["+Inf"]) == (1, 2, 2, 3)


def test_shift_needs_neighbouring_hours(spark):
    df = results(spark, [(0, "a", -0.5, "negative"), (60, "a", 0.5, "positive"), (240, "a", -0.5, "negative")])
    found = alerts.sentiment_shift_alerts(df, 0.9).collect()
    assert [(r.hour, r.change) for r in found] == [(dt.datetime(2024, 1, 1, 1), 1.0)]


def test_error_share(spark, at):
    rows = [(f"l{i}", "c", "ERROR" if i == 0 else "INFO", at(i / 10)) for i in range(15)]
    df = spark.createDataFrame(rows, "message string, component string, level string, timestamp timestamp_ntz")
    assert alerts.error_rate_alerts(df, 0.05).count() > 0
    assert alerts.error_rate_alerts(df.filter("level = 'INFO'"), 0.05).count() == 0


def test_retention(spark, at):
    raw = spark.createDataFrame(
        [(1, at(0), None), (2, at(0), at(1)), (3, at(11), at(11))],
        "id long, created_at timestamp_ntz, processed_at timestamp_ntz",
    )
    kept = retention.purge_processed(raw, at(12), dt.timedelta(minutes=5))
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    assert sorted(r.id for r in retention.purge_raw(raw, at(7 * 1440 + 5)).collect()) == [3]
    state = spark.createDataFrame([("a", at(5)), ("b", at(6))], "content_hash string, expires_at timestamp_ntz")
    assert [r.content_hash for r in retention.expire_state(state, at(5)).collect()] == ["b"]


def test_log_lines(spark):
    df = spark.createDataFrame(
        [("2025-08-02 12:13:33,825 - src.consumer - ERROR - Error: a - b",), ("Traceback (most recent call last):",)],
        "value string",
    )
    good, bad = logs.parse_app_logs(df).orderBy(F.desc("parsed")).collect()
    assert (good.timestamp, good.component, good.level, good.message) == (
        dt.datetime(2025, 8, 2, 12, 13, 33, 825000), "src.consumer", "ERROR", "Error: a - b",
    )
    assert not bad.parsed and bad.value.startswith("Traceback")


def test_access_lines(spark):
    df = spark.createDataFrame(
        [
            ('{"timestamp":"2024-01-01T00:00:00Z","level":"INFO","method":"POST","path":"/a","status_code":500,"duration":"1m2.5s","client_ip":"1.1.1.1","error":"boom"}',),
            ("2024-01-01T00:00:00Z [INFO] GET /b 200 250µs 2.2.2.2",),
            ("2024-01-01T00:00:00Z [INFO] GET /c 200 1.5ms",),
            ("junk",),
        ],
        "value string",
    )
    found = {r.path: r for r in logs.parse_access_logs(df).collect()}
    assert found["/a"].level == "ERROR" and found["/a"].duration_ms == 62_500
    assert found["/b"].duration_ms == 0.25 and found["/b"].client_ip == "2.2.2.2"
    assert found["/c"].duration_ms == 1.5 and found["/c"].client_ip is None
    assert not found[None].parsed
    summary = metrics.access_log_summary(logs.parse_access_logs(df).filter("parsed"))
    assert {r.path: r.requests_error for r in summary.collect()} == {"/a": 1, "/b": 0, "/c": 0}
