"""Adapters: the given tables as the tables the operators work on.

Every adapter is a projection of a whole table. Where rows must differ in shape
(broken JSON, absent fields, …) the first md5 digit of the key decides.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.functions.stage import literal_table, with_once
from tonetide.operators.scoring import lexicon_scorer
from tonetide.operators.texts import Instrument, with_entities
from tonetide.operators.vectors import split_vectors

AS_OF = dt.datetime(2024, 1, 31)
START = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"

# --- fixed values: small word tables over the fixture vocabulary ---------------
LEXICON = {"and": 1, "is": 2, "la": -1, "that": 1, "of": -1, "to": 1, "der": -2, "de": -1, "que": 2, "und": 1}
GAZETTEER = (
    Instrument("the", "company", "Theta Holdings", "equity"),
    Instrument("of the", "index", "OTH 100", "index"),
    Instrument("the the the", "company", "Triple T", "equity"),
    Instrument("la", "currency", "LAC", "fx"),
    Instrument("la", "index", "LA 50", "index"),
    Instrument("der", "commodity", "Derium", "commodity"),
    Instrument("los", "company", "Los Mineros", "equity"),
    Instrument("les", "bond", "LES 2030", "bond"),
)
SEARCH_TERMS = ((1, "The"), (2, "que"), (3, "und"), (3, "der"), (4, "les"), (4, "la"), (5, "Nowhere"))
# -------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; ``ts`` as TIMESTAMP, which watermarks need."""
    layout = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(layout)
        .option("maxFilesPerTrigger", 1)
        # a file stream wants a folder or a pattern; this one fits a file and a folder of parts
        .parquet(f"{sf_dir}/events.parque[t]")
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def shape(key: str) -> Column:
    """0–15 from the first md5 digit of a key."""
    digit = F.substring(F.md5(F.col(key).cast("string")), 1, 1)
    return F.instr(F.lit("0123456789abcdef"), digit) - 1


def sentiment_of_event() -> list[Column]:
    score = F.greatest(
        F.least(
            ((F.col("value").cast("decimal(12,2)") - 50) * F.lit("0.02").cast("decimal(3,2)")).cast(
                "decimal(12,4)"
            ),
            F.lit(1),
        ),
        F.lit(-1),
    ).cast("decimal(5,4)")
    confidence = (
        F.pmod("event_id", F.lit(10001)).cast("decimal(10,0)") * F.lit("0.0001").cast("decimal(5,4)")
    ).cast("decimal(5,4)")
    margin = F.lit("0.1").cast("decimal(5,4)")
    label = F.when(score > margin, "positive").when(score < -margin, "negative").otherwise("neutral")
    return [
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("source_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("source_type"),
        score.alias("sentiment_score"),
        label.alias("sentiment_label"),
        confidence.alias("confidence_score"),
    ]


def v_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*sentiment_of_event())


def json_text(name: str) -> Column:
    """A string column as a quoted JSON string."""
    return F.regexp_replace(F.to_json(F.array(F.col(name))), r"^\[|\]$", "")


SOURCE_ORDER = ("truedata", "news", "twitter", "reddit", "economic")


def source_of_document() -> Column:
    return F.element_at(
        F.array(*[F.lit(s) for s in SOURCE_ORDER]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")
    )


def payload_of_document(source: Column, body: Column) -> Column:
    """Canonical JSON of a document as its source would send it."""
    ident = F.concat(F.lit('"id":"d'), F.col("doc_id"), F.lit('"'))
    stamp = F.concat(
        F.lit('"timestamp":"'),
        F.date_format(F.col("arrived"), "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('Z"'),
    )
    return (
        F.when(
            source == "truedata",
            F.concat(
                F.lit("{"), ident, F.lit(',"price":'), F.col("n_chars"), F.lit('.5,"symbol":'), body,
                F.lit(","), stamp, F.lit(',"volume":'), F.col("doc_id") + 1, F.lit("}"),
            ),
        )
        .when(
            source == "news",
            F.concat(
                F.lit('{"headline":'), body, F.lit(","), ident, F.lit(',"source":"'), F.col("source"),
                F.lit('","summary":"'), F.col("lang"), F.lit('",'), stamp,
                F.lit(',"url":"https://news.example/'), F.col("doc_id"), F.lit('"}'),
            ),
        )
        .when(
            source == "twitter",
            F.concat(
                F.lit("{"), ident, F.lit(',"likes":'), F.col("n_chars"), F.lit(',"text":'), body,
                F.lit(","), stamp, F.lit(',"user":"'), F.col("source"), F.lit('"}'),
            ),
        )
        .when(
            source == "reddit",
            F.concat(
                F.lit('{"body":'), body, F.lit(","), ident, F.lit(',"title":"'), F.col("lang"), F.lit('"}')
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"content":'), F.col("n_chars"), F.lit(',"description":'), body, F.lit(","),
                ident, F.lit("}"),
            )
        )
    )


def _documents_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn(
        "arrived", F.expr(f"{START} + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)")
    )


def v_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents_in_time(spark, sf_dir).withColumn("kind", source_of_document())
    processed = F.when(shape("doc_id") < 6, F.col("arrived") + F.expr("INTERVAL 5 MINUTES"))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("kind").alias("source"),
        F.concat(F.lit("d"), "doc_id").alias("source_id"),
        payload_of_document(F.col("kind"), json_text("text")).alias("content"),
        F.col("arrived").alias("timestamp"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("arrived").alias("created_at"),
        processed.alias("processed_at"),
    )


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON lines of all sources: id, source, value, received_at.

    By shape: 15 cut in half, 14 a numeric id, 13 without the main text field,
    12 a JSON list, 11 blank; the rest whole, with blanks around the JSON.
    """
    docs = _documents_in_time(spark, sf_dir).withColumn("kind", source_of_document()).withColumn(
        "shape", shape("doc_id")
    )
    whole = payload_of_document(F.col("kind"), json_text("text"))
    quoted_id = F.concat(F.lit('"id":"d'), F.col("doc_id"), F.lit('"'))
    plain_id = F.concat(F.lit('"id":'), F.col("doc_id"))
    bare = F.concat(F.lit("{"), quoted_id, F.lit(',"lang":"'), F.col("lang"), F.lit('"}'))
    value = (
        F.when(F.col("shape") == 15, F.substr("whole", F.lit(1), F.floor(F.length("whole") / 2).cast("int")))
        .when(F.col("shape") == 14, F.replace("whole", quoted_id, plain_id))
        .when(F.col("shape") == 13, bare)
        .when(F.col("shape") == 12, F.concat(F.lit("["), "whole", F.lit("]")))
        .when(F.col("shape") == 11, F.lit("  "))
        .otherwise(F.concat(F.lit(" "), "whole", F.lit(" ")))
    )
    return with_once(docs, {"whole": whole}).select(
        F.col("doc_id").alias("id"),
        F.col("kind").alias("source"),
        value.alias("value"),
        F.col("arrived").alias("received_at"),
    )


def v_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per event whose content is the event's ``props`` key, so contents
    repeat at many distances in time."""
    return messages_from(table(spark, sf_dir, "events"))


def messages_from(events: DataFrame) -> DataFrame:
    events = events.select(
        F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("source"),
    )
    return events.select(
        "id", "source", "timestamp", F.sha2(F.concat(F.lit("k"), "k"), 256).alias("content_hash")
    )


def v_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen-hash state: the labelled documents, live or expired by quality."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    expiry = F.when(F.col("quality") == 1, F.lit(AS_OF + dt.timedelta(minutes=30))).otherwise(
        F.lit(AS_OF - dt.timedelta(minutes=30))
    )
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(
        F.max(expiry.cast("timestamp_ntz")).alias("expires_at")
    )


def v_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows for the pipeline: shape 13 without text, shape 10 without hash."""
    docs = _documents_in_time(spark, sf_dir).withColumn("kind", source_of_document()).withColumn(
        "shape", shape("doc_id")
    )
    bare = F.concat(F.lit('{"id":"d'), F.col("doc_id"), F.lit('","lang":"'), F.col("lang"), F.lit('"}'))
    whole = payload_of_document(F.col("kind"), json_text("text"))
    return docs.select(
        F.col("kind").alias("source"),
        F.concat(F.lit("d"), "doc_id").alias("source_id"),
        F.when(F.col("shape") == 13, bare).otherwise(whole).alias("content"),
        F.when(F.col("shape") == 10, "").otherwise(F.sha2("text", 256)).alias("content_hash"),
        F.col("arrived").alias("timestamp"),
    )


def v_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results: the labelled documents as scored before."""
    docs = _documents_in_time(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("d"), "doc_id").alias("source_id"),
        F.sha2("text", 256).alias("content_hash"),
        (F.col("arrived") + F.expr("INTERVAL 7 MINUTES")).alias("processed_at"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise(
            "neutral"
        ).alias("sentiment"),
        (F.col("quality") * 0.5 + 0.25).cast("double").alias("score"),
    )


def v_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached scores of the stored results, expiring by quality."""
    return v_results(spark, sf_dir).select(
        "content_hash",
        "sentiment",
        "score",
        F.lit(0.5).alias("confidence"),
        F.col("processed_at").alias("cached_at"),
        F.when(
            F.col("score") > 0.5, F.lit(AS_OF + dt.timedelta(minutes=30))
        ).otherwise(F.lit(AS_OF - dt.timedelta(minutes=30))).cast("timestamp_ntz").alias("expires_at"),
    )


def v_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored with the fixture lexicon and linked with the gazetteer."""
    docs = _documents_in_time(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("arrived").alias("timestamp"),
        source_of_document().alias("source_type"),
    )
    return with_entities(lexicon_scorer(LEXICON)(docs), GAZETTEER)


def v_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers per document, eight shapes from fenced JSON to a JSON list."""
    docs = table(spark, sf_dir, "documents").withColumn("shape", F.pmod(shape("doc_id"), F.lit(8)))
    score = F.concat(F.lit("0."), F.pmod("n_chars", F.lit(9)) + 1)
    entity = F.concat(
        F.lit('[{"type":"lang","name":"'), "lang", F.lit('","sentiment":"positive"}]')
    )
    full = F.concat(
        F.lit('{"sentiment":"positive","score":'), score, F.lit(',"confidence":0.75,"entities":'),
        entity, F.lit(',"summary":"'), F.col("source"), F.lit('"}'),
    )
    response = (
        F.when(F.col("shape") == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(F.col("shape") == 1, full)
        .when(F.col("shape") == 2, F.concat(F.lit(' {"sentiment":"negative","summary":"'), F.col("lang"), F.lit('"} ')))
        .when(F.col("shape") == 3, F.lit("{}"))
        .when(F.col("shape") == 4, F.concat(F.lit('{"sentiment": '), F.col("lang")))
        .when(F.col("shape") == 5, F.lit(""))
        .when(F.col("shape") == 6, F.lit('{"sentiment":"positive","score":"high"}'))
        .otherwise(F.concat(F.lit("["), full, F.lit("]")))
    )
    return docs.select("doc_id", response.alias("response"))


def v_financial_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("shape", F.pmod(shape("doc_id"), F.lit(4)))
    full = F.concat(
        F.lit('{"market_sentiment":"bullish","financial_entities":["'), F.col("lang"), F.lit('","'),
        F.col("source"), F.lit('"],"risk_level":"high","time_horizon":"short-term","trading_signal":"buy"}'),
    )
    response = (
        F.when(F.col("shape") == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(F.col("shape") == 1, F.lit('{"trading_signal":"sell"}'))
        .when(F.col("shape") == 2, F.lit("no json"))
        .otherwise(full)
    )
    return docs.select("doc_id", response.alias("response"))


def v_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from(table(spark, sf_dir, "events"))


def logs_from(events: DataFrame) -> DataFrame:
    level = (
        F.when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "signup", "WARN")
        .when(F.col("event_type") == "view", "DEBUG")
        .otherwise("INFO")
    )
    return events.select(
        F.col("event_id").alias("id"),
        level.alias("level"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(10))).alias("component"),
        F.col("event_type").alias("error_type"),
        F.concat_ws(" ", "event_type", "event_id").alias("message"),
        F.col("ts").alias("timestamp"),
    )


def v_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App log lines; shape 7 has no level and cannot be parsed."""
    line = F.concat(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), F.col("component")
    )
    tail = F.when(shape("id") == 7, F.concat(F.lit(" : "), F.col("message"))).otherwise(
        F.concat(F.lit(" - "), F.col("level"), F.lit(" - "), F.col("message"))
    )
    return v_logs(spark, sf_dir).select("id", F.concat(line, tail).alias("value"))


def v_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(10))).alias("component"),
        F.col("event_type").alias("metric_name"),
        F.col("value").cast("decimal(10,4)").alias("metric_value"),
        F.lit("ms").alias("metric_unit"),
        F.col("ts").alias("timestamp"),
    )


def v_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message latencies: a tenth of the event value, in seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source_type"),
        F.col("ts").alias("timestamp"),
        (F.col("value").cast("decimal(12,2)") * F.lit("0.1").cast("decimal(2,1)")).alias(
            "latency_seconds"
        ),
    )


def v_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing outcomes: events of type error failed, the others were written."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.pmod("user_id", F.lit(7))).alias("source"),
        F.when(failed, "error").otherwise("processed").alias("outcome"),
        F.when(failed, F.when(F.col("value") > 50, "no_text").otherwise("processing_error")).alias(
            "error_type"
        ),
        F.when(~failed, "insert_batch").alias("operation"),
        F.when(~failed, F.when(F.col("value") > 200, "failure").otherwise("success")).alias(
            "write_status"
        ),
    )


def v_access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access log lines: JSON for most shapes, plain text for shapes 0–3, junk for 4."""
    events = table(spark, sf_dir, "events").withColumn("shape", shape("event_id"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("shape") == 5, 400).otherwise(200)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    path = F.concat(F.lit("/webhook/"), F.col("event_type"))
    duration = F.concat(F.col("value").cast("decimal(12,2)"), F.lit("ms"))
    client = F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(50)))
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    error = F.when(F.col("event_type") == "error", F.lit(',"error":"failed"')).otherwise(F.lit(""))
    as_json = F.concat(
        F.lit('{"timestamp":"'), stamp, F.lit('","level":"'), level,
        F.lit('","component":"http_server","method":"POST","path":"'), path,
        F.lit('","status_code":'), status, F.lit(',"duration":"'), duration,
        F.lit('","client_ip":"'), client, F.lit('"'), error, F.lit("}"),
    )
    plain = F.concat(
        stamp, F.lit(" ["), level, F.lit("] POST "), path, F.lit(" "), status, F.lit(" "), duration,
        F.lit(" "), client,
    )
    value = (
        F.when(F.col("shape") == 4, F.lit("--"))
        .when(F.col("shape") < 4, plain)
        .otherwise(as_json)
    )
    return events.select(F.col("event_id").alias("id"), value.alias("value"))


def v_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    created = F.expr(f"{START} + make_dt_interval(0, 0, CAST(vec_id AS INT), 0)")
    usable, _ = split_vectors(
        vectors.select("vec_id", "embedding", "label", created.alias("created_at")), 64
    )
    return usable


def v_emb_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors plus a near copy of each: id + 1,000,000, first element + 0.01."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    moved = F.concat(
        F.array((F.element_at("embedding", 1) + F.lit(0.01).cast("float")).cast("float")),
        F.slice("embedding", F.lit(2), F.size("embedding") - 1),
    )
    copies = vectors.select((F.col("vec_id") + 1_000_000).alias("vec_id"), moved.alias("embedding"))
    return vectors.unionByName(copies)


def v_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query table for nearest-neighbour search: the mean vector of each label."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(
        (F.sum(F.col("x").cast("decimal(20,10)")).cast("double") / F.count(F.lit(1))).alias("x")
    )
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias(
            "embedding"
        )
    )


def v_terms(spark: SparkSession) -> DataFrame:
    return literal_table(spark, SEARCH_TERMS, "query_id long, term string")
