"""Disordered streams, folded batch tables, the one-read pipeline, alias tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.operators import alerts, dedup, ingest, summaries, texts
from tonetide.operators.gazetteer import Gazetteer
from tonetide.operators.responses import financial_outlook
from tonetide.operators.scoring import lexicon_scorer
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import tables, topics
from tonetide.sources.batches import BatchTable
from tonetide.sources.files import stored
from tonetide.streaming import live, pipeline, rollup, seen

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(r) for r in df.select(sorted(df.columns)).collect())


def backwards(spark, path, files):
    """The events in files, the newest first."""
    whole = fx.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    size = -(-1000 // files)
    for low in reversed(range(0, 1000, size)):
        part = whole.filter(F.col("event_id").between(low, low + size - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)

    def stream():
        return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return batch, stream


@pytest.fixture(scope="module")
def events(spark):
    return backwards(spark, fresh_path(spark, "backwards"), 4)


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns if c in df.columns})


def forms(batch):
    """name -> (rows of a table of events, live form, batch form)"""
    sentiment = lambda df: df.select(*fx.sentiment_of_event())
    return {
        "hourly": (sentiment, live.hourly(), summaries.hourly_sentiment_summary),
        "volume": (sentiment, live.volume(), summaries.source_volume_metrics),
        "shifts": (sentiment, live.shifts(0.3), lambda df: alerts.sentiment_shift_alerts(df, 0.3)),
        "errors": (fx.logs_from, live.error_rates(), alerts.error_rate_alerts),
    }


@pytest.mark.parametrize("name", ["hourly", "volume", "shifts", "errors"])
def test_live_tables_are_whole_with_the_newest_files_first(spark, events, name):
    batch, stream = events
    of_events, form, want = forms(batch)[name]
    table = rollup.drain(of_events(stream()), fresh_path(spark, name), form, fold_every=2)
    stamps = ("hour", "window_start", "window_end")
    expected = ntz(want(of_events(batch)), *stamps)
    got = ntz(table.current(), *stamps)
    assert got.count() > 0
    assert rows(got.select(expected.columns)) == rows(expected)
    # every row behind its batch's border is kept and counted
    counts = {r.batch_id: r for r in table.counts().collect()}
    assert len(counts) == 4 and sum(r.rows for r in counts.values()) == 1000
    late = table.late_rows().count()
    assert late == sum(r.late for r in counts.values()) > 500
    corrected = table.corrected(2)
    assert 0 < corrected.count() <= table.partials.read().count()


def test_live_table_over_more_than_a_hundred_batches(spark):
    batch, stream = backwards(spark, fresh_path(spark, "hundred"), 105)
    of_events, form, want = forms(batch)["hourly"]
    table = rollup.drain(of_events(stream()), fresh_path(spark, "hourly"), form, fold_every=25)
    expected = ntz(want(of_events(batch)), "hour")
    assert rows(ntz(table.current(), "hour")) == rows(expected)
    counts = table.counts().collect()
    assert len(counts) >= 100 and sum(r.rows for r in counts) == 1000
    assert sum(r.late for r in counts) == table.late_rows().count() > 900


def test_a_replayed_batch_changes_nothing(spark, events):
    batch, _ = events
    whole = batch.select(*fx.sentiment_of_event())
    table = rollup.LiveTable(spark, fresh_path(spark, "replayed"), live.hourly(), whole.schema)
    even, odd = whole.filter("id % 2 = 0"), whole.filter("id % 2 = 1")
    for part, number in ((even, 0), (odd, 1), (odd, 1), (even, 0)):
        table.write(part, number)
    expected = summaries.hourly_sentiment_summary(whole)
    assert rows(ntz(table.current(), "hour")) == rows(ntz(expected, "hour"))
    assert sum(r.rows for r in table.counts().collect()) == 1000


def test_late_rows_find_their_closed_window(spark):
    layout = T.StructType.fromDDL(
        "source_id string, timestamp timestamp, source_type string, sentiment_score decimal(5,4), "
        "sentiment_label string, confidence_score decimal(5,4)"
    )
    day = dt.datetime(2024, 1, 5)
    table = rollup.LiveTable(spark, fresh_path(spark, "late"), live.hourly(), layout)
    times = [day, day + dt.timedelta(hours=9), day + dt.timedelta(minutes=30), None]
    for number, moment in enumerate(times):
        table.write(spark.createDataFrame([("s", moment, "a", None, "neutral", None)], layout), number)
    assert [(r.batch_id, r.late) for r in table.counts().orderBy("batch_id").collect()] == [
        (0, 0), (1, 0), (2, 1), (3, 0)
    ]
    assert {(r.hour, r["count"]) for r in table.current().collect()} == {
        (day, 2), (day + dt.timedelta(hours=9), 1), (None, 1)
    }
    assert [r.timestamp for r in table.late_rows().collect()] == [day + dt.timedelta(minutes=30)]


# ---- tables by batch --------------------------------------------------------------------------

LAYOUT = T.StructType(
    [T.StructField("day", T.DateType()), T.StructField("key", T.StringType()), T.StructField("n", T.LongType())]
)


def summed(df):
    return df.groupBy("day", "key").agg(F.sum("n").cast("bigint").alias("n")).select(*df.columns)


def some(spark, *found):
    return spark.createDataFrame([(dt.date(2024, 1, d) if d else None, k, n) for d, k, n in found], LAYOUT)


def files(spark, path):
    return {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}


def test_batches_fold_into_few_files_without_doubles(spark):
    path = fresh_path(spark, "folding")
    table = BatchTable(spark, path, LAYOUT, "day", summed)
    assert table.read().count() == 0 and table.fold(10) == []
    for number in range(6):
        table.write(some(spark, (1, "a", 1), (None, "x", 1), (2 if number == 3 else 1, "b", 1)), number)
    before = rows(table.read())
    folded = table.fold(5, least=2)
    assert set(folded) == {dt.date(2024, 1, 1), None}
    assert rows(table.read()) == before
    assert len(files(spark, f"{path}/open")) <= 3  # the last batch's, and the day with one batch
    # a folded batch that is written again is not read; the next fold goes on from the first
    table.write(some(spark, (1, "a", 100)), 2)
    assert rows(table.read()) == before
    table.write(some(spark, (1, "a", 1)), 6)
    table.write(some(spark, (1, "a", 1)), 6)
    after = rows(table.read())
    assert table.fold(7) == [dt.date(2024, 1, 1), None] or table.fold(7) == []
    assert rows(table.read()) == after


def test_a_fold_that_dies_before_its_commit_changes_nothing(spark, monkeypatch):
    path = fresh_path(spark, "dying")
    table = BatchTable(spark, path, LAYOUT, "day", summed)
    for number in range(3):
        table.write(some(spark, (1, "a", 1)), number)
    before = rows(table.read())
    real = spark.createDataFrame

    def dies(data, schema=None, **more):
        if schema is table.commit_schema and data:
            raise RuntimeError("lost")
        return real(data, schema, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: dies(*a, **k))
    with pytest.raises(RuntimeError):
        table.fold(3)
    monkeypatch.undo()
    assert rows(table.read()) == before
    table.write(some(spark, (1, "a", 5)), 3)
    assert table.fold(4, tidy=False) == [dt.date(2024, 1, 1)]
    assert [r.n for r in table.read().collect()] == [8]


def test_only_absent_tables_are_taken_for_none(spark, tmp_path):
    assert stored(spark, f"{tmp_path}/nothing") is None
    (tmp_path / "broken").mkdir()
    assert stored(spark, f"{tmp_path}/broken") is None
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        tables.write_aggregates(
            spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' time_bucket, 'a' source, 'b' sentiment"),
            f"{tmp_path}/broken",
        )


# ---- deduplication ----------------------------------------------------------------------------


def test_first_seen_equals_the_batch_form_in_any_order(spark, events):
    batch, stream = events
    ttl = 24 * 3600

    def messages(df):
        return fx.messages_from(df).withColumn("source_id", F.lpad(F.col("id").cast("string"), 9, "0"))

    nothing = spark.createDataFrame([], "content_hash string, expires_at timestamp")
    flagged = dedup.flag_recent_duplicates(messages(batch), nothing, ttl)
    want = flagged.filter("not is_duplicate").drop("is_duplicate")
    assert rows(dedup.skip_recent_duplicates(messages(batch), nothing, ttl)) == rows(want)
    table = rollup.drain(messages(stream()), fresh_path(spark, "seen"), seen.first_seen(ttl, buckets=4))
    assert rows(table.current()) == rows(want)
    assert table.late_rows().count() > 500


def test_sessions_join_through_a_late_message(spark, at):
    layout = "id long, content_hash string, timestamp timestamp_ntz, source_id string"
    message = lambda i, minute: (i, "h", at(minute), str(i))
    form = seen.first_seen(600)
    table = rollup.LiveTable(
        spark, fresh_path(spark, "bridge"), form, T.StructType.fromDDL(layout)
    )
    shown = []
    for number, (i, minute) in enumerate([(1, 20), (2, 35), (3, 28), (4, 10), (5, 11)]):
        table.write(spark.createDataFrame([message(i, minute)], layout), number)
        shown.append(sorted(r.id for r in table.current().collect()))
    # 20 and 35 stand apart until 28 joins them; a gap of exactly ten minutes is none
    assert shown == [[1], [1, 2], [1], [1, 4], [4]]


def test_a_hash_that_fills_one_hour_is_combined_before_the_shuffle(spark):
    busy = spark.range(5000).selectExpr(
        "id", "'same' content_hash", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 3000) timestamp"
    )
    nothing = spark.createDataFrame([], "content_hash string, expires_at timestamp_ntz")
    passed = dedup.skip_recent_duplicates(busy, nothing, 3600)
    assert [r.id for r in passed.collect()] == [0]
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    known = spark.createDataFrame([("same", dt.datetime(2024, 1, 1, 0, 0, 1))], "content_hash string, expires_at timestamp_ntz")
    assert dedup.skip_recent_duplicates(busy, known, 3600).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------


def topic(spark, path, table, files=1):
    sent = ingest.to_message_rows(table, published_at=F.col("timestamp"))
    topics.write_topic_files(sent.repartition(files, "key"), path)


def test_pipeline_reads_its_source_once_and_fills_all_fields(spark):
    path, out = fresh_path(spark, "topic"), fresh_path(spark, "outcomes")
    table = fx.v_pipeline(spark, SF)
    topic(spark, path, table, 3)
    messages = topics.read_sentiment_topic(spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"})
    aliases = Gazetteer(texts.gazetteer_table(spark, fx.GAZETTEER))
    stages = (lambda df: aliases.with_entities(df, "content_hash"), financial_outlook)
    query = pipeline.stream_pipeline(
        messages, out, lexicon_scorer(fx.LEXICON), interval_seconds=None, stages=stages, fold_every=2
    )
    query.awaitTermination()
    assert sum(p.numInputRows for p in query.recentProgress) == table.count()
    assert not any(p.stateOperators for p in query.recentProgress)
    outcomes = pipeline.Outcomes(spark, out).read()
    results = outcomes.where("kind = 'result'")
    assert results.where("entities is null or financial_sentiment is null or processed_at is null").count() == 0
    assert results.where("processing_time_ms >= 0").count() == results.count() > 0
    assert results.where("size(entities) > 0 and size(financial_sentiment.financial_entities) = size(entities)").count() > 0
    want = texts.with_entities(results.select("content_hash", "text"), fx.GAZETTEER)
    assert rows(results.select("content_hash", "text", "entities")) == rows(want)


def test_pipeline_asks_only_the_buckets_met(spark):
    table = pipeline.Outcomes(spark, fresh_path(spark, "buckets"))
    hashes = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    table.remember(hashes, 0)
    layout = ", ".join(f"{c} string" for c in pipeline.ROW_FIELDS if c != "timestamp") + ", timestamp timestamp"
    known = hashes.first()[0]
    folded = spark.createDataFrame(
        [("result", "s", "1", h, "t", None, None) for h in (known, "new")]
        + [("reject", "s", "2", known, None, "no_text", None)],
        layout,
    )
    left = table.unscored(folded, 1)
    assert sorted((r.kind, r.content_hash) for r in left.collect()) == [("reject", known), ("result", "new")]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    # a replay of the batch that stored them does not see its own hashes
    assert table.unscored(folded, 0).count() == 3


# ---- aliases ----------------------------------------------------------------------------------


def test_a_hundred_thousand_aliases_stay_out_of_the_plan(spark, tmp_path):
    entry = ("'company' entity_type", "concat('E', id) entity_value", "'equity' asset_class")
    spark.range(100_000).selectExpr(
        "concat_ws(' ', 'the', concat('word', translate(id, '0123456789', 'abcdefghij')), if(id % 7 = 0, 'of the far west', null)) alias",
        *entry,
    ).write.parquet(f"{tmp_path}/aliases")
    table = spark.read.parquet(f"{tmp_path}/aliases")
    docs = spark.createDataFrame(
        [(1, "The wordbc. THE wordh of the far west and the wordb"), (2, "the wordh of the far"), (3, None), (4, "")],
        "doc_id long, text string",
    )
    linked = texts.link_entities(docs, table)
    assert {(r.doc_id, r.entity_value) for r in linked.collect()} == {(1, "E12"), (1, "E7"), (1, "E1")}
    assert "wordbc" not in linked._jdf.queryExecution().executedPlan().toString()
    listed = Gazetteer(table).with_entities(docs, "doc_id")
    found = {r.doc_id: [e.entity_value for e in r.entities] for r in listed.collect()}
    assert found == {1: ["E1", "E12", "E7"], 2: [], 3: [], 4: []}


def test_an_empty_gazetteer_links_nothing(spark):
    none = spark.createDataFrame(
        [(None, "a", "b", "c"), ("", "a", "b", "c")],
        "alias string, entity_type string, entity_value string, asset_class string",
    )
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert texts.link_entities(docs, none).count() == 0
    assert texts.with_entities(docs, []).first().entities == []
