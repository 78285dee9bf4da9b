"""Summary views refreshed by day, the stored error summary."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tonetide.operators import errors, summaries
from tonetide.operators.ordering import row_at_rank
from tonetide.session import fresh_path
from tonetide.sources import fixtures as fx
from tonetide.sources import tables
from tonetide.sources.errors import COLUMNS, ErrorTable
from tonetide.sources.files import remove
from tonetide.sources.summaries import DAY, SummaryTable, in_days, touched_days, with_day_of

SF = "/root/testdata/sf0.001"
LOG = "id long, component string, error_type string, message string, timestamp timestamp_ntz"


def lines(df):
    return sorted(map(str, df.collect()))


def plain_summary(batches):
    """The summary by a loop over the batches in time order."""
    state = {}
    for batch in batches:
        for number, component, kind, message, time in sorted(
            batch, key=lambda r: (r[4] or dt.datetime.min, r[0])
        ):
            n, first, last, sample = state.get((component, kind), (0, None, None, None))
            times = [t for t in (first, last, time) if t is not None]
            state[component, kind] = (
                n + 1, min(times, default=None), max(times, default=None), message if n % 100 == 0 else sample
            )
    return sorted(map(str, ((*k, *v) for k, v in state.items())))


def found(table):
    return sorted(str(tuple(r)) for r in table.read().select(*COLUMNS).collect())


def test_errors_stored_batch_by_batch(spark, at):
    rng = random.Random(5)
    batches = [
        [
            (1000 * b + i, rng.choice(["c", "c", "c", None]), rng.choice(["t", "u"]), f"m{b}-{i}",
             at(60 * b + rng.randrange(300)) + dt.timedelta(seconds=rng.randrange(5)))
            for i in range(n)
        ]
        for b, n in enumerate((130, 0, 7, 300, 95, 400))
    ]
    table = ErrorTable(spark, fresh_path(spark, "errors"))
    assert found(table) == []
    for b, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, LOG).repartition(3)
        table.add(frame, b)
        if b in (2, 5):
            table.add(frame, b)  # a replay
        if b == 3:
            assert table.fold(3)
        assert found(table) == plain_summary(batches[: b + 1])


def test_all_errors_in_one_second_use_many_tasks(spark, at):
    n = 20_000
    frame = spark.range(n).select(
        "id", F.lit("c").alias("component"), F.lit("t").alias("error_type"),
        F.concat(F.lit("m"), "id").alias("message"), F.lit(at(1)).cast("timestamp_ntz").alias("timestamp"),
    )
    row = errors.error_summary(frame).first()
    assert (row.error_count, row.sample_message) == (n, "m19900")
    keys = ["component", "error_type"]
    ranks = spark.createDataFrame([("c", "t", 19_901), ("d", "t", 1)], "component string, error_type string, rank long")
    dealt = frame.repartitionByRange(*keys, "timestamp", "id")
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # or these few rows become one range
    spark.conf.set(small, "false")
    try:
        sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < n / 2
        assert [r.id for r in row_at_rank(frame, keys, ["timestamp", "id"], ranks).collect()] == [19_900]
    finally:
        spark.conf.unset(small)


def test_errors_without_time_or_message(spark, at):
    rows = [(1, "c", "t", None, at(0)), (2, "c", "u", "a", None), (3, "c", "u", "b", at(0)), (4, None, None, "x", None)]
    table = ErrorTable(spark, fresh_path(spark, "errors"))
    table.add(spark.createDataFrame(rows, LOG), 0)
    assert found(table) == plain_summary([rows])


def stored_results(spark, rows):
    path = fresh_path(spark, "results")
    tables.write_partitioned(with_day_of(rows), path, [DAY])
    layout = with_day_of(rows).schema
    return path, lambda: spark.read.schema(layout).parquet(path)


def test_a_refresh_reads_and_overwrites_the_touched_days(spark):
    rows = fx.v_sentiment(spark, SF)
    path, opened = stored_results(spark, rows)
    out = fresh_path(spark, "view")
    days = touched_days(rows)
    assert len(days) > 20
    for view, (summarise, _) in summaries.SUMMARY_VIEWS.items():
        table = SummaryTable(spark, f"{out}-{view}", view, opened)
        assert table.read().count() == 0
        assert table.refresh(rows.limit(0)) == []
        table.refresh_days(days)
        assert lines(table.read()) == lines(summarise(rows))

    def files(folder):
        return {r[0] for r in spark.read.parquet(folder).select("_metadata.file_path").distinct().collect()}

    before = files(f"{out}-hourly")
    first, last = min(days), max(days)
    changed = rows.where(F.to_date("timestamp").isin(first, last))
    tables.write_partitioned(with_day_of(changed), path, [DAY])
    hourly = SummaryTable(spark, f"{out}-hourly", "hourly", opened)
    assert sorted(hourly.refresh(changed)) == [first, last]
    assert lines(hourly.read()) == lines(summaries.hourly_sentiment_summary(opened()))
    after = files(f"{out}-hourly")
    assert {f.split(f"{DAY}=")[1][:10] for f in before - after} == {str(first), str(last)}
    read = opened().where(in_days([first, last]))
    assert {r[0] for r in read.select(DAY).distinct().collect()} == {first, last}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert f"{DAY}#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_removed_and_undated_rows(spark, at):
    rows = fx.v_sentiment(spark, SF).limit(200)
    undated = rows.limit(3).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    both = rows.unionByName(undated).cache()
    path, opened = stored_results(spark, both)
    table = SummaryTable(spark, fresh_path(spark, "view"), "daily", opened)
    table.refresh(both)
    assert lines(table.read()) == lines(summaries.daily_sentiment_summary(both))
    day = min(d for d in touched_days(both) if d)
    gone = both.where(F.to_date("timestamp") == F.lit(day))
    remove(spark, [f"{path}/{DAY}={day}"])
    assert table.refresh(gone) == [day] == table.refresh(gone)
    kept = both.where(F.coalesce(F.to_date("timestamp") != F.lit(day), F.lit(True)))
    assert lines(table.read()) == lines(summaries.daily_sentiment_summary(kept))
