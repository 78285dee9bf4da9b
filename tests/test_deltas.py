"""Embedding deltas, daily result tables, page tokens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tonetide.operators import ingest
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources.embeddings import EmbeddingTable
from tonetide.streaming import sinks

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, created_at timestamp_ntz"


def files(spark, path):
    return {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}


def test_an_upsert_writes_its_delta_and_nothing_else(spark, at):
    path = fresh_path(spark, "vectors")
    old = spark.createDataFrame([(i, [float(i)], at(0)) for i in range(1000)], VECTORS)
    table = EmbeddingTable.create(spark, path, old.schema, 4)
    assert table.read().count() == 0 and table.upsert(old) == 0
    before = files(spark, f"{path}/open")
    new = spark.createDataFrame([(i, [-1.0], at(1)) for i in range(950, 1050)], VECTORS)
    assert table.upsert(new) == 1
    stored = {r.vec_id: r.embedding for r in table.read().collect()}
    assert len(stored) == 1050 and stored[949] == [949.0] and stored[950] == [-1.0] == stored[1049]
    assert before < files(spark, f"{path}/open")
    added = spark.read.parquet(f"{path}/open").where("batch_id = 1")
    assert added.count() == 100
    # an older version loses whatever delta it comes in; of equal times the later delta wins
    table.upsert(spark.createDataFrame([(950, [5.0], at(-1)), (951, [6.0], at(1)), (951, [7.0], at(0))], VECTORS))
    again = EmbeddingTable(spark, path)
    assert again.buckets == 4
    assert again.compact() == [0, 1, 2, 3] and again.compact() == []
    stored = {r.vec_id: r.embedding for r in again.read().collect()}
    assert len(stored) == 1050 and stored[950] == [-1.0] and stored[951] == [6.0]
    found = again.lookup(spark.createDataFrame([(951,), (951,), (-4,)], "vec_id long"))
    assert [(r.vec_id, r.embedding) for r in found.collect()] == [(951, [6.0])]
    assert again.upsert(new.limit(0)) == 3
    with pytest.raises(FileNotFoundError):
        EmbeddingTable(spark, f"{path}-none")


def test_a_day_of_batches_ends_as_few_files(spark):
    path, out = fresh_path(spark, "parts"), fresh_path(spark, "results")
    rows = fx.v_sentiment(spark, SF).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    day = rows.where("timestamp < TIMESTAMP '2024-01-03 00:00:00'")
    for n in range(6):
        day.where(F.pmod("id", F.lit(6)) == n).coalesce(1).write.mode("append").parquet(path)
    layout = spark.read.parquet(path).schema
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(path)
    table = sinks.results_table(spark, out, layout)
    write = sinks.daily_writer(table, fold_every=4)
    sinks.start(stream, write, None, None).awaitTermination()
    assert table.read().drop(sinks.DAY).exceptAll(day).count() == 0 and table.read().count() == day.count()
    table.fold(6, 1)
    days = {r[0] for r in table.read().select(sinks.DAY).distinct().collect()}
    assert len(files(spark, f"{out}/folded")) <= 2 * len(days)
    write(spark.read.parquet(path).where("id % 6 = 0"), 5)  # replayed after it was folded
    assert table.read().count() == day.count()


def test_pages_follow_their_tokens(spark, at):
    rows = [(i, at(i // 3) if i % 5 else None, at(0) if i % 4 == 0 else None) for i in range(40)]
    raw = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, processed_at timestamp_ntz")
    whole = [r.id for r in ingest.unprocessed_page(raw, 100).collect()]
    got, token = [], None
    while True:
        page = ingest.unprocessed_after(raw, 7, token)
        ids = [r.id for r in page.collect()]
        if not ids:
            break
        got += ids
        token = ingest.page_token(page)
    assert got == whole and len(got) == 30
    assert ingest.page_token(raw.limit(0)) is None
    assert isinstance(token[0], dt.datetime)
