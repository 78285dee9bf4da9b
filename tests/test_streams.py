"""Streams over several files, one per micro-batch, against the batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tonetide.operators import alerts, dedup, ingest, metrics, summaries
from tonetide.operators.scoring import lexicon_scorer
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import tables, topics
from tonetide.streaming import live, pipeline, sinks, state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    """The events in four files ordered by time, as (batch table, stream)."""
    path = fresh_path(spark, "events-by-time")
    whole = fx.table(spark, SF, "events")
    for low in range(0, 1000, 250):
        part = whole.filter(F.col("event_id").between(low, low + 249)).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return spark.read.parquet(path), stream


def rows(df):
    return sorted(str(r) for r in df.select(sorted(df.columns)).collect())


def closed(df, end, batch):
    limit = batch.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    return df.filter(end <= F.lit(limit))


def test_hourly_and_volume(spark, events):
    batch, stream = events
    whole = batch.select(*fx.sentiment_of_event())
    live_rows = stream().select(*fx.sentiment_of_event())
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    hourly = summaries.hourly_sentiment_summary(whole).withColumn("hour", F.col("hour").cast("timestamp"))
    got = sinks.drain_to_table(live.stream_hourly_summary(live_rows), "hourly")
    assert rows(got) == rows(closed(hourly, end, batch))
    volume = summaries.source_volume_metrics(whole).withColumn("hour", F.col("hour").cast("timestamp"))
    got = sinks.drain_to_table(live.stream_source_volume(stream().select(*fx.sentiment_of_event())), "volume")
    assert rows(got) == rows(closed(volume, end, batch))
    near = sinks.drain_to_table(live.stream_source_volume_approx(stream().select(*fx.sentiment_of_event())), "approx")
    assert near.count() == got.count()


def test_alerts(spark, events):
    batch, stream = events
    want = alerts.error_rate_alerts(fx.logs_from(batch))
    got = sinks.drain_to_table(live.stream_error_rate_alerts(fx.logs_from(stream())), "errors")
    assert rows(got) == rows(closed(want, F.col("window_end"), batch))
    want = alerts.sentiment_shift_alerts(batch.select(*fx.sentiment_of_event()), 0.3)
    got = sinks.drain_to_table(live.stream_shift_alerts(stream().select(*fx.sentiment_of_event()), 0.3), "shift")
    assert got.count() > 0
    assert rows(got) == rows(closed(want, F.col("hour") + F.expr("INTERVAL 1 HOUR"), batch))
    want = alerts.threshold_alerts(batch.select(*fx.sentiment_of_event()), ["sentiment_score"])
    got = sinks.drain_to_table(
        live.stream_threshold_alerts(stream().select(*fx.sentiment_of_event()), ["sentiment_score"]), "threshold"
    )
    assert rows(got) == rows(want)


def test_dedup_over_micro_batches(spark, events):
    batch, stream = events
    ttl = 24 * 3600

    def messages(df):
        return fx.messages_from(df).withColumn("source_id", F.lpad(F.col("id").cast("string"), 9, "0"))

    nothing = spark.createDataFrame([], "content_hash string, expires_at timestamp")
    want = dedup.skip_recent_duplicates(messages(batch), nothing, ttl)
    got = sinks.drain_to_table(state.stream_dedup_ttl(messages(stream()), ttl, buckets=4), "ttl")
    assert rows(got) == rows(want)
    sessions = sinks.drain_to_table(state.stream_dedup_sessions(messages(stream()), ttl), "sessions")
    assert set(rows(sessions)) <= set(rows(want)) and sessions.count() > want.count() // 2


def published(spark, path, table):
    topics.write_topic_files(ingest.to_message_rows(table, published_at=F.col("timestamp")).coalesce(1), path)


def test_pipeline_restarts_and_never_repeats(spark):
    path, out, checkpoint = (fresh_path(spark, n) for n in ("topic", "outcomes", "checkpoint"))
    table = fx.v_pipeline(spark, SF)
    noon = F.lit(dt.datetime(2024, 1, 1, 1, 30)).cast("timestamp_ntz")
    scorer = lexicon_scorer(fx.LEXICON)

    def run():
        messages = topics.read_sentiment_topic(spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"})
        return pipeline.drain_pipeline(messages, scorer, out, checkpoint=checkpoint)

    published(spark, path, table.filter(F.col("timestamp") < noon))
    run()
    published(spark, path, table.filter(F.col("timestamp") >= noon))
    published(spark, path, table)
    outcomes = run()
    results = outcomes.filter("kind = 'result'")
    assert results.count() == results.select("content_hash").distinct().count()
    once = pipeline.drain_pipeline(one_batch(spark, table), scorer).filter("kind = 'result'")
    columns = ["content_hash", "source", "source_id", "sentiment_label", "sentiment_score"]
    assert rows(results.select(columns)) == rows(once.select(columns))
    # rejects are never remembered: each failed message counts, published twice = twice
    single = pipeline.drain_pipeline(one_batch(spark, table), scorer).filter("kind = 'reject'").count()
    assert single > 0 and outcomes.filter("kind = 'reject'").count() == 2 * single
    counters = metrics.pipeline_counters(pipeline.outcome_counters(outcomes))
    totals = {r.counter: r.value for r in counters.filter("label_1 = '(all)'").collect()}
    assert totals["messages_processed"] == results.count() and totals["errors"] == 2 * single


def one_batch(spark, table):
    path = fresh_path(spark, "topic")
    published(spark, path, table)
    return topics.read_sentiment_topic(spark, "parquet", {"path": path})


def test_pipeline_starts_over_existing_results(spark):
    table = fx.v_pipeline(spark, SF)
    scorer = lexicon_scorer(fx.LEXICON)
    first = pipeline.drain_pipeline(one_batch(spark, table), scorer)
    again = pipeline.drain_pipeline(
        one_batch(spark, table), scorer, already_scored=first.filter("kind = 'result'")
    )
    assert again.filter("kind = 'result'").count() == 0


def test_replayed_batch_replaces_itself(spark):
    path = fresh_path(spark, "results")
    df = spark.range(10)
    tables.write_results_batch(df, path, 0)
    tables.write_results_batch(df, path, 1)
    tables.write_results_batch(df, path, 1)
    assert spark.read.parquet(path).groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 10), (1, 10)]


def test_broken_messages_become_rejects(spark):
    path = fresh_path(spark, "topic")
    rows_in = [("sentiment_analysis_topic", "k", v, None, dt.datetime(2024, 1, 1)) for v in ("no json", "[1]", "{}")]
    spark.createDataFrame(rows_in, topics.FILE_SCHEMA).write.parquet(path)
    messages = topics.read_sentiment_topic(spark, "parquet", {"path": path})
    found = pipeline.drain_pipeline(messages).collect()
    assert [r.error_type for r in found] == ["missing_hash"] * 3 and {r.source for r in found} == {"unknown"}


def test_late_rows_are_counted(spark):
    """A row two days behind the watermark is refused by the roll-up, and counted."""
    path = fresh_path(spark, "late")
    layout = (
        "source_id string, timestamp timestamp, source_type string, sentiment_score decimal(5,4), "
        "sentiment_label string, confidence_score decimal(5,4)"
    )
    day = dt.datetime(2024, 1, 5)
    for moment in (day, day + dt.timedelta(hours=9), day - dt.timedelta(days=2)):
        row = [("s", moment, "a", None, "neutral", None)]
        spark.createDataFrame(row, layout).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(path)
    out = fresh_path(spark, "hours")
    query = sinks.start(live.stream_hourly_summary(stream), sinks.results_writer(out), None, None)
    query.awaitTermination()
    assert sinks.late_rows(query) == 1
    assert [r.hour for r in spark.read.parquet(out).collect()] == [day]
