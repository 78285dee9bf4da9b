import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tonetide.operators import ingest, texts, validate
from tonetide.schemas import RAW

LINES = "id long, value string"


def raw_rows(spark, rows):
    """(id, source, source_id, content, hash, minute, processed)"""
    start = dt.datetime(2024, 1, 1)
    full = [
        (i, s, sid, c, start + dt.timedelta(minutes=m), h, start + dt.timedelta(minutes=m), p)
        for i, s, sid, c, h, m, p in rows
    ]
    return spark.createDataFrame(full, RAW)


def test_source_id_only_from_string_id(spark):
    lines = spark.createDataFrame(
        [(1, '{"id":"a"}'), (2, '{"id":5}'), (3, "{}"), (4, '{"id":null}')], LINES
    )
    raw, rejects = ingest.ingest_payloads(lines, "news")
    found = {r.id: r.source_id for r in raw.collect()}
    assert found == {1: "a", 2: "", 3: "", 4: ""}
    assert rejects.count() == 0
    assert raw.select("source").distinct().collect()[0].source == "news"


def test_rejects_and_reasons(spark):
    lines = spark.createDataFrame(
        [(1, "{"), (2, "[1]"), (3, " "), (4, None), (5, '"text"'), (6, ' \n {"a":1} '), (7, '{"a":1,"a":2}')],
        LINES,
    )
    accepted, rejects = validate.reject_malformed(lines)
    assert [r.id for r in accepted.collect()] == [6]
    assert {r.id: r.reason for r in rejects.collect()} == {
        1: "malformed_json", 2: "not_an_object", 3: "empty", 4: "empty", 5: "not_an_object",
        7: "malformed_json",
    }


def test_hash_ignores_key_order_and_blanks(spark):
    rng = random.Random(5)

    def shuffled(value):
        if isinstance(value, dict):
            keys = list(value)
            rng.shuffle(keys)
            return {k: shuffled(value[k]) for k in keys}
        return [shuffled(v) for v in value] if isinstance(value, list) else value

    def made(depth):
        kind = rng.choice("sndl" if depth else "sn")
        if kind == "s":
            return rng.choice(["", "a<b>&c", "naïve", 'q"\\', "line\n", "😀"])
        if kind == "n":
            return rng.choice([0, 1, -5, 2.5, True, None])
        if kind == "l":
            return [made(depth - 1) for _ in range(3)]
        return {rng.choice("abcdefgh"): made(depth - 1) for _ in range(4)}

    rows = []
    for n in range(150):
        value = {"metadata": made(3), "x": made(2), "n": n}
        for form in range(3):
            text = json.dumps(
                shuffled(value), ensure_ascii=form == 1, indent=2 if form == 2 else None
            )
            rows.append((n, text))
    hashed = ingest.content_hash(spark.createDataFrame(rows, "id long, content string"))
    counts = hashed.groupBy("id").agg(F.count_distinct("content_hash").alias("n"))
    assert counts.filter("n <> 1").count() == 0
    assert hashed.select("content_hash").distinct().count() == 150


def test_supplied_hash_is_kept(spark):
    df = spark.createDataFrame(
        [(1, "{}", "given"), (2, "{}", ""), (3, "{}", None)], "id long, content string, content_hash string"
    )
    found = {r.id: r.content_hash for r in ingest.content_hash(df).collect()}
    assert found[1] == "given" and found[2] == found[3] and len(found[2]) == 64


def test_append_skips_known_and_repeated_content(spark):
    existing = raw_rows(spark, [(1, "news", "a", "{}", "h1", 0, None)])
    batch = raw_rows(
        spark,
        [
            (2, "news", "other-id", "{}", "h1", 1, None),
            (3, "", "x", "{}", "h2", 3, None),
            (4, "", "w", "{}", "h2", 2, None),
            (5, "", "v", "{}", "h2", 2, None),
        ],
    )
    fresh = ingest.append_new_raw(existing, batch).collect()
    assert [(r.id, r.source) for r in fresh] == [(5, "")]
    assert ingest.append_new_raw(existing, batch.limit(0)).count() == 0


def test_lookup_finds_only_known_hashes(spark):
    raw = raw_rows(spark, [(1, "news", "a", "{}", "h1", 0, None)])
    wanted = spark.createDataFrame([("h1",), ("missing",), ("",)], "content_hash string")
    assert [r.id for r in ingest.lookup_by_hash(raw, wanted).collect()] == [1]


def test_mark_and_page(spark):
    raw = raw_rows(spark, [(1, "news", "a", "{}", "h1", 0, None), (2, "news", "b", "{}", "h2", 0, None)])
    finished = spark.createDataFrame([(1,), (99999,), (0,)], "id long")
    marked, unknown = ingest.mark_processed(raw, finished, dt.datetime(2024, 1, 2))
    assert sorted(r.id for r in unknown.collect()) == [0, 99999]
    assert {r.id: r.processed_at for r in marked.collect()} == {1: dt.datetime(2024, 1, 2), 2: None}
    for (limit, offset), rows in {(10, 0): 1, (1, 0): 1, (10, 1): 0}.items():
        assert ingest.unprocessed_page(marked, limit, offset).count() == rows


def test_message_rows(spark):
    raw = raw_rows(spark, [(1, "news", "a", '{"b":1}', "h1", 0, None), (2, "news", "a", "{}", "", 0, None)])
    rows = {r.key: r for r in ingest.to_message_rows(raw).collect()}
    assert rows["h1"].topic == "sentiment_analysis_topic"
    assert json.loads(rows["h1"].value) == {
        "source": "news", "source_id": "a", "content": {"b": 1}, "content_hash": "h1", "timestamp": 1704067200,
    }
    headers = [(h.key, bytes(h.value).decode()) for h in rows["h1"].headers]
    assert headers == [("source", "ingestion-service"), ("message_type", "raw_data")]
    assert None in rows
    alert = ingest.to_message_rows(raw.limit(1), "alert").first()
    assert alert.topic == "alert_topic" and alert.key is None


def test_text_per_source(spark):
    cases = [
        ("news", '{"headline":"H","summary":"S"}', "H. S"),
        ("news", '{"headline":"H"}', "H."),
        ("news", '{"summary":"S"}', ". S"),
        ("news", '{"body":"x"}', None),
        ("twitter", '{"text":"t"}', "t"),
        ("twitter", '{"text":""}', None),
        ("truedata", '{"symbol":"ABC","price":1}', "ABC"),
        ("reddit", '{"text":5,"content":{"a":1},"body":"b","title":"t"}', "b"),
        ("economic", '{"value":1,"a":"z"}', '{"value":1,"a":"z"}'),
        ("economic", '"plain"', "plain"),
        ("economic", "not json", "not json"),
    ]
    df = spark.createDataFrame(
        [(i, s, c) for i, (s, c, _) in enumerate(cases)], "id long, source string, content string"
    )
    with_text, rejects = texts.extract_text(df)
    found = {r.id: r.text for r in with_text.collect()}
    assert found == {i: t for i, (_, _, t) in enumerate(cases) if t is not None}
    assert {r.id for r in rejects.collect()} == {i for i, c in enumerate(cases) if c[2] is None}
    assert {r.error_type for r in rejects.collect()} == {"no_text"}


def test_field_rules(spark):
    cases = [
        ("truedata", '{"id":"1","symbol":"A","price":1.5,"volume":3,"timestamp":"2024-01-01T00:00:00Z"}', []),
        ("truedata", '{"id":1,"symbol":"","price":"x","volume":0}',
         ["id:type", "symbol:missing", "price:type", "volume:missing", "timestamp:missing"]),
        ("news", '{"id":"1","source":"s","headline":"h","url":"no url","timestamp":"yesterday"}',
         ["url:url", "timestamp:time"]),
        ("twitter", '{"id":"1","user":"u","text":"t","likes":"many","timestamp":"2024-01-01T00:00:00Z"}',
         ["likes:type"]),
        ("reddit", "{}", []),
    ]
    df = spark.createDataFrame(
        [(i, s, c) for i, (s, c, _) in enumerate(cases)], "id long, source string, content string"
    )
    found = {r.id: r.violations for r in validate.validate_required(df).collect()}
    assert found == {i: v for i, (_, _, v) in enumerate(cases)}


def test_constraints_and_schema(spark):
    df = spark.createDataFrame(
        [("a" * 300, "h", None, "s", "1.5", "great", "0.5"), (None, "h", None, "s", "x", "neutral", "2")],
        "source_id string, content_hash string, timestamp timestamp_ntz, source_type string, "
        "sentiment_score string, sentiment_label string, confidence_score string",
    )
    rules = validate.result_constraints()
    counts = {r.rule: r.violations for r in validate.check_constraints(df, rules).collect()}
    assert counts["source_id_length"] == counts["source_id_null"] == counts["label_domain"] == 1
    assert counts["score_range"] == 2 and counts["confidence_range"] == 1 and counts["timestamp_null"] == 2
    assert validate.violating_rows(df, rules).count() == 2
    assert validate.validate_schema(raw_rows(spark, []), RAW).count() == 0
    odd = raw_rows(spark, []).drop("source").withColumn("id", F.lit("x")).withColumn("more", F.lit(1))
    found = {r.column_name: r.problem for r in validate.validate_schema(odd, RAW).collect()}
    assert found == {"source": "missing", "id": "type_mismatch", "more": "extra"}
