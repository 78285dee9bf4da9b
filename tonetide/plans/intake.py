"""Queries: payload intake, validation, text, scoring, deduplication, table layouts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetide.operators import dedup, ingest, responses, retention, scoring, summaries, texts, validate
from tonetide.schemas import PAYLOAD_RULES, SENTIMENT_RESULTS, SOURCES
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import tables
from tonetide.plans.views import DOC_TOKENS, TOKENS, _values


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, _ = ingest.ingest_payloads(fx.v_lines(spark, sf_dir), F.col("source"), F.col("received_at"))
    return raw


def ingest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir).select("id", "source", "source_id", "content_hash", "timestamp")


def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source ingested on its own, then united."""
    lines = fx.v_lines(spark, sf_dir)
    parts = []
    for source in SOURCES:
        own = lines.filter(F.col("source") == source)
        parts.append(ingest.ingest_payloads(own, source, F.col("received_at"))[0])
    return ingest.union_sources(*parts).select("id", "source", "source_id", "content_hash", "timestamp")


def append_new_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = ingest.append_new_raw(fx.v_results(spark, sf_dir), fx.v_raw(spark, sf_dir))
    return fresh.select("id", "source", "source_id", "content_hash")


def to_message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.to_message_rows(fx.v_raw(spark, sf_dir), published_at=F.col("timestamp"))
    headers = F.transform(
        "headers", lambda h: F.concat_ws("=", h["key"], h["value"].cast("string"))
    )
    return rows.withColumn("headers", F.array_join(headers, ","))


def write_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = summaries.bucket_sentiment(fx.v_scored(spark, sf_dir))
    path = fresh_path(spark, "aggregated-sentiment")
    # two writes into the same days
    even = F.hour("time_bucket") % 2 == 0
    tables.write_aggregates(buckets.filter(even), path)
    tables.write_aggregates(buckets.filter(~even), path)
    stored = spark.read.parquet(path)
    return stored.select(
        "time_bucket", "source", "sentiment", "count", "avg_score", "avg_confidence",
        F.array_join("entities", ",").alias("entities"),
        F.col("bucket_date").cast("string").alias("bucket_date"),
    )


def partition_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "raw-monthly")
    tables.write_monthly(fx.v_raw(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return (
        tables.with_month(stored.drop("y", "m"))
        .groupBy("partition_name", F.col("y").cast("long").alias("y"), F.col("m").cast("long").alias("m"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("timestamp").alias("first_row"),
            F.max("timestamp").alias("last_row"),
        )
    )


def partition_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "logs-daily")
    tables.write_daily(fx.v_logs(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return (
        tables.with_day(stored.drop("log_date"))
        .groupBy("partition_name", F.col("log_date").cast("string").alias("log_date"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("timestamp").alias("first_row"),
            F.max("timestamp").alias("last_row"),
        )
    )


def reject_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = validate.reject_malformed(fx.v_lines(spark, sf_dir))
    return rejects.select("id", "source", "reason")


def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate_required(_accepted(spark, sf_dir))
    return checked.select("id", "source", F.array_join("violations", ",").alias("violations"))


def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as unchecked result rows: some labels, scores and ids break the rules."""
    label = (
        F.when(F.col("event_type") == "error", "negative")
        .when(F.col("event_type") == "click", "neutral")
        .when(F.col("event_type") == "purchase", "positive")
        .otherwise(F.col("event_type"))
    )
    unchecked = fx.table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("source_id"),
        F.sha2("props", 256).alias("content_hash"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("source_type"),
        ((F.col("value").cast("decimal(12,2)") - 50) * F.lit("0.02").cast("decimal(3,2)"))
        .cast("string").alias("sentiment_score"),
        label.alias("sentiment_label"),
        (F.col("value").cast("decimal(12,2)") / 100).cast("decimal(12,4)").alias("confidence_score"),
    )
    return validate.check_constraints(unchecked, validate.result_constraints())


def validate_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table held against the layout of the results table."""
    return validate.validate_schema(fx.table(spark, sf_dir, "events"), SENTIMENT_RESULTS)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplied = F.when(F.col("event_type") == "click", "supplied").when(F.col("event_type") == "view", "")
    messages = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("content"), supplied.alias("content_hash")
    )
    return ingest.content_hash(messages).select("id", "content_hash")


def drop_missing_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplied = F.when(F.col("event_type") == "click", F.sha2("props", 256)).when(
        F.col("event_type") == "view", ""
    )
    messages = fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), supplied.alias("content_hash")
    )
    kept, rejects = ingest.drop_missing_hash(messages)
    return kept.withColumn("error_type", F.lit(None).cast("string")).unionByName(rejects)


def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_text, rejects = texts.extract_text(_accepted(spark, sf_dir))
    return with_text.select(
        "id", "source", F.sha2("text", 256).alias("text_hash"), F.lit(None).cast("string").alias("error_type")
    ).unionByName(
        rejects.select("id", "source", F.lit(None).cast("string").alias("text_hash"), "error_type")
    )


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.table(spark, sf_dir, "pages")
    return texts.clean_text(pages, "html").select("page_id", "clean_text")


def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts.detect_language(fx.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "lang", "language", "language_hits")


def unprocessed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page, behind a first one of 25 rows."""
    raw = fx.v_raw(spark, sf_dir)
    token = ingest.page_token(ingest.unprocessed_after(raw, 25))
    return ingest.unprocessed_after(raw, 50, token).select("id", "source", "created_at")


def lookup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.lookup_by_hash(fx.v_raw(spark, sf_dir), fx.v_seen(spark, sf_dir))
    return found.select("id", "source", "content_hash")


def mark_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases name the finished ids; many of them do not exist."""
    finished = fx.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id")
    )
    path = fresh_path(spark, "raw-monthly")
    tables.write_monthly(fx.v_raw(spark, sf_dir), path)
    unknown = tables.mark_processed_table(spark, path, finished, fx.AS_OF)
    return spark.read.parquet(path).select("id", F.lit("stored").alias("state"), "processed_at").unionByName(
        unknown.select("id", F.lit("not_found").alias("state"), F.lit(None).cast("timestamp_ntz").alias("processed_at"))
    )


def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").withColumn("context", F.struct("lang", "source"))
    parts = [responses.build_prompts(docs, kind) for kind in ("sentiment", "financial", "context")]
    return ingest.union_sources(*parts).withColumn("max_tokens", F.col("max_tokens").cast("long"))


def parse_model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_model_responses(fx.v_responses(spark, sf_dir))
    named = F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["name"], e["sentiment"]))
    return parsed.withColumn("entities", F.array_join(named, ","))


def parse_financial_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = responses.parse_financial_responses(fx.v_financial_responses(spark, sf_dir))
    return parsed.withColumn("financial_entities", F.array_join("financial_entities", ","))


def score_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score_sentiment(docs, scoring.lexicon_scorer(fx.LEXICON))
    return scored.select(
        "doc_id",
        "sentiment_label",
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        F.col("confidence_score").cast("double").alias("confidence_score"),
    )


def _seen_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    expiry = F.when(F.col("quality") == 1, F.lit(dt.datetime(2024, 1, 1, 6))).otherwise(
        F.lit(dt.datetime(2023, 12, 31, 23))
    )
    return fx.table(spark, sf_dir, "labels").select(
        F.sha2(F.concat(F.lit("k"), "doc_id"), 256).alias("content_hash"),
        expiry.cast("timestamp_ntz").alias("expires_at"),
    )


def skip_recent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.skip_recent_duplicates(fx.v_messages(spark, sf_dir), _seen_k(spark, sf_dir), 12 * 3600)
    return kept.select("id", "source", "content_hash")


def skip_already_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, existing = dedup.skip_already_scored(fx.v_raw(spark, sf_dir), fx.v_results(spark, sf_dir))
    return fresh.select("content_hash", "id", F.lit("fresh").alias("status")).unionByName(
        existing.select("content_hash", F.lit(None).cast("long").alias("id"), "status")
    )


def hydrate_cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    hydrated = dedup.hydrate_cached_scores(
        fx.v_raw(spark, sf_dir), fx.v_cache(spark, sf_dir), fx.AS_OF
    )
    return hydrated.select("id", "content_hash", "sentiment", "score", "confidence", "cached_at")


def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.link_entities(fx.table(spark, sf_dir, "documents"), fx.GAZETTEER)


def reconcile_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against raw rows of which the oldest four hours are purged already."""
    raw = retention.purge_raw(fx.v_raw(spark, sf_dir), dt.datetime(2024, 1, 8, 4))
    return dedup.reconcile_pipeline(raw, fx.v_results(spark, sf_dir))


def latest_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.v_messages(spark, sf_dir).withColumnRenamed("timestamp", "processed_at")
    return dedup.latest_by_hash(results)


def first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_by_hash(fx.v_messages(spark, sf_dir))


def dedup_exact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_exact_text(fx.table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_payloads, union_sources, append_new_raw, to_message_rows, write_aggregates,
        partition_monthly, partition_daily, reject_malformed, validate_required, check_constraints,
        validate_schema, content_hash, drop_missing_hash, extract_text, clean_text, detect_language,
        unprocessed_page, lookup_by_hash, mark_processed, build_prompts, parse_model_responses,
        parse_financial_responses, score_sentiment, skip_recent_duplicates, skip_already_scored,
        hydrate_cached_scores, link_entities, reconcile_pipeline, latest_by_hash, first_by_hash,
        dedup_exact_text,
    )
}


def _violations_sql() -> str:
    rules = _values([(i, r.source, r.field, r.kind, int(r.required)) for i, r in enumerate(PAYLOAD_RULES)])
    return f"""
WITH rules(pos, source, field, kind, required) AS (VALUES {rules}),
checks AS (SELECT a.id, a.source, r.pos, r.field, r.kind, r.required, json_type(a.content, '$.' || r.field) AS t,
    a.content ->> ('$.' || r.field) AS v FROM v_accepted a LEFT JOIN rules r USING (source)),
found AS (SELECT *, CASE
    WHEN field IS NULL THEN NULL
    WHEN t IS NULL OR t = 'NULL' THEN CASE WHEN required = 1 THEN 'missing' END
    WHEN kind IN ('string', 'url', 'time') AND t <> 'VARCHAR' THEN 'type'
    WHEN kind = 'integer' AND t NOT IN ('BIGINT', 'UBIGINT') THEN 'type'
    WHEN kind = 'number' AND t NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'type'
    WHEN required = 1 AND kind IN ('string', 'url', 'time') AND v = '' THEN 'missing'
    WHEN required = 1 AND kind IN ('integer', 'number') AND v::double = 0 THEN 'missing'
    WHEN kind = 'url' AND NOT regexp_matches(v, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^\\s/?#]+') THEN 'url'
    WHEN kind = 'time' AND try_cast(v AS timestamptz) IS NULL THEN 'time' END AS problem FROM checks)
SELECT id, source, coalesce(string_agg(field || ':' || problem, ',' ORDER BY pos) FILTER (WHERE problem IS NOT NULL), '') AS violations
FROM found GROUP BY 1, 2"""


def _prompt_sql(kind: str) -> str:
    request = responses.REQUESTS[kind]
    tail = "\n\nAnswer with one JSON object and nothing else. Fields:\n" + request["fields"].replace("; ", "\n")
    context = (
        """ || chr(10) || chr(10) || 'Context: {"lang":"' || lang || '","source":"' || source || '"}'"""
        if kind == "context"
        else ""
    )
    return f"""SELECT doc_id, '{kind}' AS kind, '{request['task']}' || chr(10) || chr(10) || 'Text: ' || text{context}
 || '{tail}' AS prompt, 0.1::double AS temperature, 0.9::double AS top_p, 512::bigint AS max_tokens FROM documents"""


def _language_sql() -> str:
    rows = _values([(w, lang) for lang, words in texts.STOP_WORDS.items() for w in words])
    return f"""
WITH hits AS (SELECT doc_id, s.lang AS language, count(*) AS n
  FROM (SELECT doc_id, unnest({DOC_TOKENS}) AS word FROM documents) JOIN (VALUES {rows}) s(word, lang) USING (word)
  GROUP BY 1, 2),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, language) = 1)
SELECT doc_id, d.lang, coalesce(language, 'und') AS language, coalesce(n, 0) AS language_hits
FROM documents d LEFT JOIN best USING (doc_id)"""


def _instruments_sql() -> str:
    rows = _values([(g.alias, g.entity_type, g.entity_value, g.asset_class) for g in fx.GAZETTEER])
    words = TOKENS.format(text="text")
    return f"""
SELECT DISTINCT doc_id, z.entity_type, z.entity_value, z.asset_class FROM (
  SELECT doc_id, unnest(list_concat(words, list_transform(list_zip(words[1:len(words)-1], words[2:len(words)]),
    lambda p: p[1] || ' ' || p[2]), list_transform(list_zip(words, words[2:len(words)], words[3:len(words)]),
    lambda p: p[1] || ' ' || p[2] || ' ' || p[3]))) AS gram FROM (SELECT doc_id, {words} AS words FROM documents))
JOIN (VALUES {rows}) z(alias, entity_type, entity_value, asset_class) ON gram = z.alias"""


_ACCEPTED = 'SELECT id, source, source_id, sha256(content) AS content_hash, "timestamp" FROM v_accepted'
_MEANS = (
    "sum(sentiment_score)::double / count(*) AS avg_score, "
    "sum(confidence_score)::double / count(*) AS avg_confidence"
)

ORACLES = {
    "ingest_payloads": _ACCEPTED,
    "union_sources": _ACCEPTED,
    "append_new_raw": """
SELECT id, source, source_id, content_hash FROM v_raw
WHERE content_hash NOT IN (SELECT content_hash FROM v_results)
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY "timestamp", source_id, id) = 1""",
    "to_message_rows": """
SELECT 'sentiment_analysis_topic' AS topic, content_hash AS key,
  '{"source":"' || source || '","source_id":"' || source_id || '","content":' || content || ',"content_hash":"'
  || content_hash || '","timestamp":' || epoch("timestamp")::bigint || '}' AS value,
  'source=ingestion-service,message_type=raw_data' AS headers, "timestamp" FROM v_raw""",
    "write_aggregates": f"""
WITH cells AS (SELECT date_trunc('hour', "timestamp")::timestamp AS time_bucket, source_type AS source,
    sentiment_label AS sentiment, count(*) AS count, {_MEANS} FROM v_scored GROUP BY 1, 2, 3),
named AS (SELECT DISTINCT date_trunc('hour', "timestamp")::timestamp AS time_bucket, source_type AS source,
    sentiment_label AS sentiment, entity_value FROM v_scored JOIN v_entities USING (id)),
lists AS (SELECT time_bucket, source, sentiment, string_agg(entity_value, ',' ORDER BY entity_value) AS entities
    FROM named GROUP BY 1, 2, 3)
SELECT cells.*, coalesce(entities, '') AS entities, strftime(time_bucket, '%Y-%m-%d') AS bucket_date
FROM cells LEFT JOIN lists USING (time_bucket, source, sentiment)""",
    "partition_monthly": """
SELECT 'raw_data_' || strftime("timestamp", 'y%Ym%m') AS partition_name, year("timestamp") AS y, month("timestamp") AS m,
  count(*) AS rows, min("timestamp") AS first_row, max("timestamp") AS last_row FROM v_raw GROUP BY 1, 2, 3""",
    "partition_daily": """
SELECT 'system_logs_' || strftime("timestamp", 'y%Ym%md%d') AS partition_name, strftime("timestamp", '%Y-%m-%d') AS log_date,
  count(*) AS rows, min("timestamp") AS first_row, max("timestamp") AS last_row FROM v_logs GROUP BY 1, 2""",
    "reject_malformed": """
SELECT id, source, CASE WHEN trim(value) = '' THEN 'empty' WHEN NOT json_valid(value) THEN 'malformed_json'
  ELSE 'not_an_object' END AS reason
FROM v_lines WHERE CASE WHEN json_valid(value) THEN json_type(value) <> 'OBJECT' ELSE true END""",
    "validate_required": _violations_sql(),
    "check_constraints": """
WITH rows_in AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS source_id,
    (value::decimal(12,2) - 50) * 0.02::decimal(3,2) AS score, value::decimal(12,2)::double / 100 AS confidence,
    event_type FROM events),
counts AS (SELECT count(*) AS n, count(*) FILTER (WHERE source_id IS NULL) AS a,
    count(*) FILTER (WHERE event_type IN ('signup', 'view')) AS b,
    count(*) FILTER (WHERE score NOT BETWEEN -1 AND 1) AS c,
    count(*) FILTER (WHERE confidence NOT BETWEEN 0 AND 1) AS d FROM rows_in)
SELECT rule, CASE rule WHEN 'source_id_null' THEN a WHEN 'label_domain' THEN b WHEN 'score_range' THEN c
  WHEN 'confidence_range' THEN d ELSE 0 END AS violations, n AS rows
FROM counts, (VALUES ('source_id_null'), ('source_id_length'), ('content_hash_null'), ('content_hash_length'),
  ('timestamp_null'), ('source_type_null'), ('source_type_length'), ('label_domain'), ('score_range'),
  ('confidence_range')) r(rule)""",
    "validate_schema": """
WITH wanted(column_name, expected_type) AS (VALUES ('id', 'bigint'), ('source_id', 'string'), ('content_hash', 'string'),
  ('timestamp', 'timestamp_ntz'), ('source_type', 'string'), ('content', 'string'), ('sentiment_score', 'decimal(5,4)'),
  ('sentiment_label', 'string'), ('confidence_score', 'decimal(5,4)')),
found AS (SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DOUBLE' THEN 'double' END AS found_type FROM (DESCRIBE events))
SELECT column_name, expected_type, found_type, CASE WHEN found_type IS NULL THEN 'missing'
  WHEN expected_type IS NULL THEN 'extra' ELSE 'type_mismatch' END AS problem
FROM wanted FULL JOIN found USING (column_name)
WHERE expected_type IS DISTINCT FROM found_type""",
    "content_hash": """
SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'supplied' ELSE sha256(json(props)::varchar) END AS content_hash
FROM events""",
    "drop_missing_hash": """
SELECT event_id AS id, CASE event_type WHEN 'click' THEN sha256(props) WHEN 'view' THEN '' END AS content_hash,
  CASE WHEN event_type <> 'click' THEN 'missing_hash' END AS error_type FROM events""",
    "extract_text": r"""
WITH picked AS (SELECT id, source, CASE source
    WHEN 'news' THEN CASE WHEN content ->> '$.headline' IS NOT NULL OR content ->> '$.summary' IS NOT NULL
      THEN regexp_replace(coalesce(content ->> '$.headline', '') || '. ' || coalesce(content ->> '$.summary', ''), '^\s+|\s+$', '', 'g') END
    WHEN 'twitter' THEN content ->> '$.text' WHEN 'truedata' THEN content ->> '$.symbol'
    ELSE coalesce(
      CASE WHEN json_type(content, '$.text') = 'VARCHAR' THEN content ->> '$.text' END,
      CASE WHEN json_type(content, '$.content') = 'VARCHAR' THEN content ->> '$.content' END,
      CASE WHEN json_type(content, '$.body') = 'VARCHAR' THEN content ->> '$.body' END,
      CASE WHEN json_type(content, '$.description') = 'VARCHAR' THEN content ->> '$.description' END,
      content) END AS text FROM v_accepted)
SELECT id, source, sha256(nullif(text, '')) AS text_hash, CASE WHEN nullif(text, '') IS NULL THEN 'no_text' END AS error_type
FROM picked""",
    "clean_text": r"""
SELECT page_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), 'https?://[^\s]+', ' ', 'g'),
  '[\x00-\x1f\x7f]', ' ', 'g'), ' +', ' ', 'g'))) AS clean_text FROM pages""",
    "detect_language": _language_sql(),
    "unprocessed_page": """
SELECT id, source, created_at FROM v_raw WHERE processed_at IS NULL ORDER BY created_at, id LIMIT 50 OFFSET 25""",
    "lookup_by_hash": """
SELECT id, source, content_hash FROM v_raw WHERE content_hash IN (SELECT content_hash FROM v_seen)""",
    "mark_processed": """
WITH finished AS (SELECT event_id AS id FROM events WHERE event_type = 'purchase')
SELECT id, 'stored' AS state, CASE WHEN id IN (SELECT id FROM finished) THEN TIMESTAMP '2024-01-31' ELSE processed_at END AS processed_at
FROM v_raw UNION ALL
SELECT id, 'not_found', NULL FROM finished WHERE id NOT IN (SELECT id FROM v_raw)""",
    "build_prompts": " UNION ALL ".join(_prompt_sql(k) for k in ("sentiment", "financial", "context")),
    "parse_model_responses": r"""
WITH bare AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(response, '^\s+|\s+$', '', 'g'), '^```json', ''), '```$', '') AS r FROM v_responses),
ok AS (SELECT doc_id, r, CASE WHEN json_valid(r) THEN json_type(r) = 'OBJECT'
    AND (json_type(r, '$.score') IS NULL OR try_cast(r ->> '$.score' AS double) IS NOT NULL) ELSE false END AS fine FROM bare)
SELECT doc_id, CASE WHEN fine THEN coalesce(r ->> '$.sentiment', 'neutral') ELSE 'neutral' END AS sentiment,
  CASE WHEN fine THEN coalesce((r ->> '$.score')::double, 0.5) ELSE 0.5 END::double AS score,
  CASE WHEN fine THEN coalesce((r ->> '$.confidence')::double, 0.5) ELSE 0.1 END::double AS confidence,
  CASE WHEN fine THEN coalesce((r ->> '$.entities[0].type') || ':' || (r ->> '$.entities[0].name') || ':' || (r ->> '$.entities[0].sentiment'), '') ELSE '' END AS entities,
  CASE WHEN fine THEN coalesce(r ->> '$.summary', '') ELSE 'Failed to parse response' END AS summary,
  NOT fine AS parse_failed FROM ok""",
    "parse_financial_responses": """
SELECT doc_id, CASE WHEN shape IN (0, 3) THEN 'bullish' ELSE 'neutral' END AS market_sentiment,
  CASE WHEN shape IN (0, 3) THEN 'high' ELSE 'medium' END AS risk_level,
  CASE WHEN shape IN (0, 3) THEN 'short-term' ELSE 'medium-term' END AS time_horizon,
  CASE shape WHEN 1 THEN 'sell' WHEN 2 THEN 'hold' ELSE 'buy' END AS trading_signal,
  CASE WHEN shape IN (0, 3) THEN lang || ',' || source ELSE '' END AS financial_entities,
  shape = 2 AS parse_failed
FROM (SELECT *, (instr('0123456789abcdef', substr(md5(doc_id::varchar), 1, 1)) - 1) % 4 AS shape FROM documents)""",
    "score_sentiment": """
SELECT id AS doc_id, sentiment_label, sentiment_score::double AS sentiment_score,
  confidence_score::double AS confidence_score FROM v_scored""",
    "skip_recent_duplicates": """
WITH ordered AS (SELECT *, lag("timestamp") OVER (PARTITION BY content_hash ORDER BY "timestamp", id) AS before FROM v_messages)
SELECT id, source, o.content_hash FROM ordered o LEFT JOIN v_seen_k s USING (content_hash)
WHERE CASE WHEN before IS NOT NULL THEN "timestamp" >= before + INTERVAL 12 HOUR
  ELSE coalesce(s.expires_at <= "timestamp", true) END""",
    "skip_already_scored": """
SELECT content_hash, id, 'fresh' AS status FROM v_raw WHERE content_hash NOT IN (SELECT content_hash FROM v_results)
UNION ALL SELECT DISTINCT content_hash, NULL::bigint, 'existing' FROM v_raw
WHERE content_hash IN (SELECT content_hash FROM v_results)""",
    "hydrate_cached_scores": """
WITH live AS (SELECT * FROM v_cache WHERE expires_at > TIMESTAMP '2024-01-31'
  QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY cached_at DESC, score DESC, sentiment DESC) = 1)
SELECT r.id, r.content_hash, sentiment, score, confidence, cached_at FROM v_raw r LEFT JOIN live USING (content_hash)""",
    "link_entities": _instruments_sql(),
    "reconcile_pipeline": """
WITH stored AS (SELECT content_hash, min("timestamp") AS stored_at, count(*) AS raw_rows FROM v_raw
    WHERE created_at >= TIMESTAMP '2024-01-01 04:00:00' GROUP BY 1),
scored AS (SELECT content_hash, min(processed_at) AS scored_at FROM v_results GROUP BY 1)
SELECT content_hash, CASE WHEN stored_at IS NULL THEN 'orphan' WHEN scored_at IS NULL THEN 'pending' ELSE 'processed' END AS status,
  coalesce(raw_rows, 0) AS raw_rows, (epoch_us(scored_at) - epoch_us(stored_at)) / 1000000.0::double AS delay_seconds
FROM stored FULL JOIN scored USING (content_hash)""",
    "latest_by_hash": """
SELECT id, source, "timestamp" AS processed_at, content_hash FROM v_messages
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY "timestamp" DESC, id) = 1""",
    "first_by_hash": """
SELECT id, source, "timestamp", content_hash FROM v_messages
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY "timestamp", id) = 1""",
    "dedup_exact_text": """
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""",
}
