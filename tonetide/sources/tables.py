"""Partitioned Parquet tables: layout, replay-safe writes, upserts, partition drops."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tonetide.operators.ingest import mark_processed
from tonetide.operators.retention import purge_raw
from tonetide.operators.vectors import upsert_embeddings
from tonetide.schemas import RAW_RETENTION_DAYS
from tonetide.session import cut_lineage
from tonetide.sources.files import remove, stored

OUT_OF_RANGE = "default"


def with_month(df: DataFrame, time: str = "timestamp", table: str = "raw_data") -> DataFrame:
    """Add ``y``, ``m`` and the partition name ``<table>_yYYYYmMM`` (``_default`` for no time)."""
    return df.select(
        "*",
        F.year(time).alias("y"),
        F.month(time).alias("m"),
        F.coalesce(
            F.concat(F.lit(f"{table}_"), F.date_format(time, "'y'yyyy'm'MM")),
            F.lit(f"{table}_{OUT_OF_RANGE}"),
        ).alias("partition_name"),
    )


def with_day(df: DataFrame, time: str = "timestamp", table: str = "system_logs") -> DataFrame:
    """Add ``log_date`` and the partition name ``<table>_yYYYYmMMdDD``."""
    return df.select(
        "*",
        F.to_date(time).alias("log_date"),
        F.coalesce(
            F.concat(F.lit(f"{table}_"), F.date_format(time, "'y'yyyy'm'MM'd'dd")),
            F.lit(f"{table}_{OUT_OF_RANGE}"),
        ).alias("partition_name"),
    )


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Parquet by partition columns; ``overwrite`` replaces only the partitions it writes."""
    writer = df.write.mode(mode).partitionBy(*by)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_monthly(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Raw rows into month partitions (y, m), range-partitioned by time: each month gets
    few, time-ordered files, and a large one is still written by many tasks."""
    rows = with_month(raw).drop("partition_name")
    write_partitioned(rows.repartitionByRange("y", "m", "timestamp"), path, ["y", "m"], mode)


def write_daily(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Log rows into day partitions (log_date)."""
    rows = with_day(logs).drop("partition_name")
    write_partitioned(rows.repartitionByRange("log_date", "timestamp"), path, ["log_date"], mode)


def write_results_batch(results: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch into its own ``batch_id`` partition; a replay replaces it."""
    write_partitioned(
        results.withColumn("batch_id", F.lit(batch_id).cast("long")), path, ["batch_id"], "overwrite"
    )


def write_aggregates(aggregates: DataFrame, path: str) -> None:
    """Aggregated buckets; one that is stored already is replaced, its day's others stay.

    Only the days written to are read and rewritten.
    """
    rows = aggregates.withColumn("bucket_date", F.to_date("time_bucket"))
    before = stored(aggregates.sparkSession, path)
    if before is not None:
        keys = ["time_bucket", "source", "sentiment"]
        day = before.join(rows.select("bucket_date").distinct(), "bucket_date", "left_semi")
        new = rows.select(*[F.col(k).alias(f"new_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys]
        others = day.join(new, same, "left_anti").select(*rows.columns)
        rows = cut_lineage(others.unionByName(rows), "aggregates")
    write_partitioned(rows.repartition("bucket_date"), path, ["bucket_date"], "overwrite")


def write_embedding_buckets(embeddings: DataFrame, path: str, buckets: int = 64) -> None:
    rows = embeddings.withColumn("bucket", _bucket(buckets))
    write_partitioned(rows.repartition("bucket"), path, ["bucket"], "overwrite")


def upsert_embedding_table(incoming: DataFrame, path: str, buckets: int = 64) -> None:
    """Store or replace vectors in a bucketed table, rewriting only touched buckets.

    Touched buckets are read through partition pruning; the merged rows are
    staged before they replace the files they were read from.
    """
    spark = incoming.sparkSession
    new = incoming.withColumn("bucket", _bucket(buckets))
    touched = new.select("bucket").distinct()
    current = spark.read.parquet(path).join(touched, "bucket", "left_semi")
    merged = upsert_embeddings(
        current.select(*incoming.columns), incoming
    ).withColumn("bucket", _bucket(buckets))
    staged = cut_lineage(merged, "embedding-upsert")
    write_partitioned(staged.repartition("bucket"), path, ["bucket"], "overwrite")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("vec_id"), F.lit(buckets)).cast("int")


def _in_months(months: Sequence[Row]) -> Column:
    """Rows of some month partitions; partition pruning applies."""
    return reduce(
        or_,
        [F.col("y").eqNullSafe(F.lit(r.y)) & F.col("m").eqNullSafe(F.lit(r.m)) for r in months],
        F.lit(False),
    )


def mark_processed_table(
    spark: SparkSession, path: str, finished: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Set ``processed_at`` of finished ids in a table written by ``write_monthly``.

    Only months that hold such ids are read whole and rewritten. Returns the ids that do not
    exist.
    """
    raw = spark.read.parquet(path)
    ids = cut_lineage(finished.select("id").distinct(), "finished")
    months = raw.select("id", "y", "m").join(ids, "id", "left_semi").select("y", "m").distinct()
    unknown = cut_lineage(ids.join(raw.select("id"), "id", "left_anti"), "unknown")
    touched = months.collect()  # partitions, not rows
    if touched:
        marked, _ = mark_processed(raw.filter(_in_months(touched)), ids, as_of)
        staged = cut_lineage(marked, "marked")
        rows = staged.repartitionByRange("y", "m", "timestamp")
        write_partitioned(rows, path, ["y", "m"], "overwrite")
    return unknown


def purge_raw_table(
    spark: SparkSession, path: str, as_of: dt.datetime, days: int = RAW_RETENTION_DAYS
) -> list[str]:
    """Delete raw rows created before the cutoff from a table written by ``write_monthly``.

    Months without younger rows are dropped as directories, months that hold both are
    rewritten, the others are not touched. Returns the dropped directories.
    """
    raw = spark.read.parquet(path)
    cutoff = as_of - dt.timedelta(days=days)
    bounds = raw.groupBy("y", "m").agg(
        F.min("created_at").alias("oldest"), F.max("created_at").alias("youngest")
    )
    months = bounds.filter(F.col("oldest") < F.lit(cutoff).cast("timestamp_ntz")).collect()
    mixed = [r for r in months if r.youngest >= cutoff]
    if mixed:
        staged = cut_lineage(purge_raw(raw.filter(_in_months(mixed)), as_of, days), "kept-raw")
        rows = staged.repartitionByRange("y", "m", "timestamp")
        write_partitioned(rows, path, ["y", "m"], "overwrite")
    dropped = [_month_folder(r) for r in months if r.youngest < cutoff]
    remove(spark, [f"{path}/{folder}" for folder in dropped])
    return sorted(dropped)


def _month_folder(month: Row) -> str:
    name = lambda value: "__HIVE_DEFAULT_PARTITION__" if value is None else value
    return f"y={name(month.y)}/m={name(month.m)}"


def drop_log_days(spark: SparkSession, path: str, as_of: dt.datetime, days: int) -> list[str]:
    """Delete whole day partitions older than the cutoff; returns the dropped days."""
    first_day = (as_of - dt.timedelta(days=days)).date().isoformat()
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        day = name.partition("=")[2]
        if name.startswith("log_date=") and day[:1].isdigit() and day < first_day:
            files.delete(status.getPath(), True)
            dropped.append(day)
    return sorted(dropped)
