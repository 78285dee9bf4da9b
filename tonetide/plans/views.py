"""The fixture adapters once more, as SQL, for the side-by-side check."""

from __future__ import annotations

import re

SHAPE = "(instr('0123456789abcdef', substr(md5({key}::varchar), 1, 1)) - 1)"
DOC_SHAPE = SHAPE.format(key="doc_id")
EVENT_SHAPE = SHAPE.format(key="event_id")
ARRIVED = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id))"
KIND = "(['truedata','news','twitter','reddit','economic'])[(doc_id % 5 + 1)::int]"
TOKENS = r"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}]+'), lambda t: t <> '')"
DOC_TOKENS = TOKENS.format(text="text")

_IDENT = """'"id":"d' || doc_id || '"'"""
_STAMP = f"""'"timestamp":"' || strftime({ARRIVED}, '%Y-%m-%dT%H:%M:%S') || 'Z"'"""
_BODY = "to_json(text)::varchar"
PAYLOAD = f"""CASE {KIND}
 WHEN 'truedata' THEN '{{' || {_IDENT} || ',"price":' || n_chars || '.5,"symbol":' || {_BODY}
   || ',' || {_STAMP} || ',"volume":' || (doc_id + 1) || '}}'
 WHEN 'news' THEN '{{"headline":' || {_BODY} || ',' || {_IDENT} || ',"source":"' || source
   || '","summary":"' || lang || '",' || {_STAMP} || ',"url":"https://news.example/' || doc_id || '"}}'
 WHEN 'twitter' THEN '{{' || {_IDENT} || ',"likes":' || n_chars || ',"text":' || {_BODY}
   || ',' || {_STAMP} || ',"user":"' || source || '"}}'
 WHEN 'reddit' THEN '{{"body":' || {_BODY} || ',' || {_IDENT} || ',"title":"' || lang || '"}}'
 ELSE '{{"content":' || n_chars || ',"description":' || {_BODY} || ',' || {_IDENT} || '}}' END"""


def weigh(words: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{t}' THEN {w}" for t, w in weights.items())
    return f"coalesce(list_sum(list_transform({words}, lambda t: CASE t {cases} ELSE 0 END)), 0)::bigint"


def _values(rows) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def _scored_sql() -> str:
    from tonetide.sources.fixtures import LEXICON

    net = weigh("words", LEXICON)
    hits = weigh("words", {t: 1 for t in LEXICON})
    return f"""
SELECT id, text, "timestamp", source_type, words, score AS sentiment_score,
  CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN hits = 0 THEN 0.5 ELSE ((hits * 10000) // len(words)) * 0.0001::decimal(5,4) END::decimal(5,4) AS confidence_score
FROM (SELECT *, (greatest(least({net}, 10), -10)::decimal(10,0) * 0.1::decimal(2,1))::decimal(5,4) AS score,
        {hits} AS hits
      FROM (SELECT doc_id AS id, text, {ARRIVED} AS "timestamp", {KIND} AS source_type, {DOC_TOKENS} AS words
            FROM documents))"""


def gazetteer_values() -> str:
    from tonetide.sources.fixtures import GAZETTEER

    return _values([(g.alias, g.entity_type, g.entity_value, g.asset_class) for g in GAZETTEER])


def _entities_sql() -> str:
    return f"""
SELECT DISTINCT g.id, z.entity_type, z.entity_value, z.asset_class
FROM (SELECT id, unnest(list_concat(words, list_transform(
        list_zip(words[1:len(words)-1], words[2:len(words)]), lambda p: p[1] || ' ' || p[2]),
        list_transform(list_zip(words, words[2:len(words)], words[3:len(words)]),
        lambda p: p[1] || ' ' || p[2] || ' ' || p[3]))) AS gram
      FROM v_scored) g
JOIN (VALUES {gazetteer_values()}) z(alias, entity_type, entity_value, asset_class) ON g.gram = z.alias"""


VIEWS: dict[str, str] = {
    "v_sentiment": """
SELECT event_id AS id, user_id::varchar AS source_id, ts AS "timestamp", event_type AS source_type,
  score AS sentiment_score,
  CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  ((event_id % 10001)::decimal(10,0) * 0.0001::decimal(5,4))::decimal(5,4) AS confidence_score
FROM (SELECT *, greatest(least(((value::decimal(12,2) - 50) * 0.02::decimal(3,2))::decimal(12,4), 1), -1)::decimal(5,4) AS score
      FROM events)""",
    "v_raw": f"""
SELECT doc_id AS id, {KIND} AS source, 'd' || doc_id AS source_id, {PAYLOAD} AS content,
  {ARRIVED} AS "timestamp", sha256(text) AS content_hash, {ARRIVED} AS created_at,
  CASE WHEN {DOC_SHAPE} < 6 THEN {ARRIVED} + INTERVAL 5 MINUTE END AS processed_at
FROM documents""",
    "v_lines": f"""
SELECT id, source, received_at,
  CASE shape WHEN 15 THEN substr(whole, 1, length(whole) // 2)
    WHEN 14 THEN replace(whole, '"id":"d' || id || '"', '"id":' || id)
    WHEN 13 THEN '{{"id":"d' || id || '","lang":"' || lang || '"}}'
    WHEN 12 THEN '[' || whole || ']'
    WHEN 11 THEN '  ' ELSE ' ' || whole || ' ' END AS value
FROM (SELECT doc_id AS id, {KIND} AS source, lang, {ARRIVED} AS received_at, {DOC_SHAPE} AS shape,
        {PAYLOAD} AS whole FROM documents)""",
    "v_accepted": """
SELECT id, source, received_at AS "timestamp", trim(value) AS content,
  CASE WHEN json_type(value, '$.id') = 'VARCHAR' THEN value ->> '$.id' ELSE '' END AS source_id
FROM v_lines WHERE CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END""",
    "v_pipeline": f"""
SELECT source, source_id, "timestamp", content_hash, nullif(text, '') AS text FROM (
  SELECT {KIND} AS source, 'd' || doc_id AS source_id, {ARRIVED} AS "timestamp",
    CASE WHEN shape = 10 THEN '' ELSE sha256(text) END AS content_hash,
    CASE WHEN shape = 13 THEN CASE WHEN {KIND} IN ('reddit', 'economic')
        THEN '{{"id":"d' || doc_id || '","lang":"' || lang || '"}}' END
      WHEN {KIND} = 'news' THEN regexp_replace(text || '. ' || lang, '^\\s+|\\s+$', '', 'g')
      ELSE text END AS text
  FROM (SELECT *, {DOC_SHAPE} AS shape FROM documents))""",
    "v_messages": """
SELECT event_id AS id, event_type AS source, ts AS "timestamp",
  sha256('k' || (props ->> '$.k')) AS content_hash FROM events""",
    "v_seen": """
SELECT sha256(text) AS content_hash, max(CASE WHEN quality = 1 THEN TIMESTAMP '2024-01-31 00:30:00'
  ELSE TIMESTAMP '2024-01-30 23:30:00' END) AS expires_at
FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "v_seen_k": """
SELECT DISTINCT sha256('k' || doc_id) AS content_hash, CASE WHEN quality = 1
  THEN TIMESTAMP '2024-01-01 06:00:00' ELSE TIMESTAMP '2023-12-31 23:00:00' END AS expires_at
FROM labels""",
    "v_results": f"""
SELECT doc_id AS id, 'd' || doc_id AS source_id, sha256(text) AS content_hash,
  {ARRIVED} + INTERVAL 7 MINUTE AS processed_at,
  CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
  quality * 0.5::double + 0.25::double AS score
FROM documents JOIN labels USING (doc_id)""",
    "v_cache": """
SELECT content_hash, sentiment, score, 0.5::double AS confidence, processed_at AS cached_at,
  CASE WHEN score > 0.5 THEN TIMESTAMP '2024-01-31 00:30:00' ELSE TIMESTAMP '2024-01-30 23:30:00' END AS expires_at
FROM v_results""",
    "v_scored": "",  # set below
    "v_entities": "",
    "v_responses": f"""
SELECT doc_id, CASE shape WHEN 0 THEN '```json' || chr(10) || full_answer || chr(10) || '```'
  WHEN 1 THEN full_answer
  WHEN 2 THEN '{{"sentiment":"negative","summary":"' || lang || '"}}'
  WHEN 3 THEN '{{}}' WHEN 4 THEN '{{"sentiment": ' || lang WHEN 5 THEN ''
  WHEN 6 THEN '{{"sentiment":"positive","score":"high"}}' ELSE '[' || full_answer || ']' END AS response
FROM (SELECT doc_id, lang, {DOC_SHAPE} % 8 AS shape,
  '{{"sentiment":"positive","score":0.' || (n_chars % 9 + 1) || ',"confidence":0.75,"entities":[{{"type":"lang","name":"'
  || lang || '","sentiment":"positive"}}],"summary":"' || source || '"}}' AS full_answer FROM documents)""",
    "v_logs": """
SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN'
    WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  'c' || (user_id % 10) AS component, event_type AS error_type, event_type || ' ' || event_id AS message,
  ts AS "timestamp" FROM events""",
    "v_metrics": """
SELECT event_id AS id, 'c' || (user_id % 10) AS component, event_type AS metric_name,
  value::decimal(10,4) AS metric_value, 'ms' AS metric_unit, ts AS "timestamp" FROM events""",
    "v_latencies": """
SELECT event_id AS id, event_type AS source_type, ts AS "timestamp",
  value::decimal(12,2) * 0.1::decimal(2,1) AS latency_seconds FROM events""",
    "v_outcomes": """
SELECT 'u' || (user_id % 7) AS source,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'processed' END AS outcome,
  CASE WHEN event_type = 'error' THEN CASE WHEN value > 50 THEN 'no_text' ELSE 'processing_error' END END AS error_type,
  CASE WHEN event_type <> 'error' THEN 'insert_batch' END AS operation,
  CASE WHEN event_type <> 'error' THEN CASE WHEN value > 200 THEN 'failure' ELSE 'success' END END AS write_status
FROM events""",
    "v_access": f"""
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  'POST' AS method, '/webhook/' || event_type AS path,
  (CASE WHEN event_type = 'error' THEN 500 WHEN shape = 5 THEN 400 ELSE 200 END)::bigint AS status_code,
  value::decimal(12,2)::double AS duration_ms, '10.0.0.' || (user_id % 50) AS client_ip,
  CASE WHEN event_type = 'error' AND shape > 4 THEN 'failed' END AS error,
  date_trunc('second', ts) AS "timestamp"
FROM (SELECT *, {EVENT_SHAPE} AS shape FROM events) WHERE shape <> 4""",
    "v_emb": """
SELECT vec_id, embedding, label, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(vec_id) AS created_at
FROM embeddings""",
    "v_emb_dups": """
SELECT vec_id, embedding FROM embeddings UNION ALL
SELECT vec_id + 1000000, list_concat([(embedding[1] + 0.01::float)::float], embedding[2:]) FROM embeddings""",
    "v_centroids": """
SELECT query_id, list(x ORDER BY pos) AS embedding FROM (
  SELECT label::bigint AS query_id, pos, sum(x::decimal(20,10))::double / count(*) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY 1, 2) GROUP BY 1""",
}
VIEWS["v_scored"] = _scored_sql()
VIEWS["v_entities"] = _entities_sql()


def _needed(sql: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def with_views(sql: str, recursive: bool = False) -> str:
    """``sql`` preceded by the CTEs it refers to, directly or not."""
    names: list[str] = []
    _needed(sql, names)
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        ctes.append(body)
        return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes)
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
