"""A table that micro-batches write and a fold keeps small; replays and crashes leave no double.

Each micro-batch replaces its own ``batch_id`` partition below ``open/<by>=…``. ``fold`` merges
the batches of a partition into one set of files below ``folded/<by>=…/version=…`` and then
commits: one small file that says, per partition, which version holds it and up to which batch.
Readers take the committed version plus open batches beyond it. So a fold that dies before its
commit changes nothing, a batch that is written again after it was folded is not read, and
removing what a fold has replaced is only tidying up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetide.sources.files import remove, stored

BATCH = "batch_id"
VERSION = "version"


class BatchTable:
    """Rows of ``schema`` at ``path``, partitioned by its column ``by``.

    ``merge`` brings rows of several batches together (default: they stay as they are).
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        by: str,
        merge: Callable[[DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.path, self.by, self.merge = spark, path.rstrip("/"), by, merge
        names = [f.name for f in schema if f.name != by]
        self.columns = schema.names
        kept = [schema[n] for n in names]
        key = schema[by]
        self.open_schema = T.StructType([*kept, key, T.StructField(BATCH, T.LongType())])
        self.folded_schema = T.StructType([*kept, key, T.StructField(VERSION, T.LongType())])
        self.commit_schema = T.StructType(
            [key, *(T.StructField(n, T.LongType()) for n in ("held", "upto", VERSION))]
        )

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of one micro-batch; writing it again replaces them."""
        named = rows.select(*self.columns).withColumn(BATCH, F.lit(batch_id).cast("long"))
        # few files per partition; adaptive execution splits a large one
        (
            named.hint("rebalance", F.col(self.by))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(self.by, BATCH)
            .parquet(f"{self.path}/open")
        )

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _commits(self) -> DataFrame:
        """Per partition: the version that holds it and the last batch in there."""
        rows = stored(self.spark, f"{self.path}/commits", self.commit_schema)
        if rows is None:
            return self._empty(self.commit_schema)
        last = rows.agg(F.max(VERSION)).first()[0]
        return rows.where(F.col(VERSION) == last)

    def _open(self, commits: DataFrame) -> DataFrame:
        rows = stored(self.spark, f"{self.path}/open", self.open_schema)
        rows = self._empty(self.open_schema) if rows is None else rows
        done = commits.select(F.col(self.by).alias("__by"), "upto")
        # commits have a row per partition; dealt by partition, few tasks would read all rows
        joined = rows.join(F.broadcast(done), F.col(self.by).eqNullSafe(F.col("__by")), "left")
        return joined.where(F.col("upto").isNull() | (F.col(BATCH) > F.col("upto"))).select(*rows.columns)

    def _folded(self, commits: DataFrame) -> DataFrame:
        rows = stored(self.spark, f"{self.path}/folded", self.folded_schema)
        rows = self._empty(self.folded_schema) if rows is None else rows
        held = commits.select(F.col(self.by).alias("__by"), "held")
        same = F.col(self.by).eqNullSafe(F.col("__by")) & (F.col(VERSION) == F.col("held"))
        return rows.join(F.broadcast(held), same).select(*rows.columns)

    def read(
        self, before: int | None = None, chosen: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """All rows, merged; only those of batches below ``before``, if it is given (batches that
        are folded are taken to be). ``chosen`` narrows the rows before they are merged; it must
        keep or leave out all rows that merge."""
        commits = self._commits()
        open_ = self._open(commits)
        if before is not None:
            open_ = open_.where(F.col(BATCH) < before)
        parts = [self._folded(commits), open_]
        rows = parts[0].select(*self.columns).union(parts[1].select(*self.columns))
        rows = chosen(rows) if chosen else rows
        return self.merge(rows) if self.merge else rows

    def of_batch(self, batch_id: int) -> DataFrame:
        """What one micro-batch wrote, as long as it is not folded and tidied."""
        rows = stored(self.spark, f"{self.path}/open", self.open_schema)
        rows = self._empty(self.open_schema) if rows is None else rows
        return rows.where(F.col(BATCH) == batch_id).select(*self.columns)

    def fold(self, before: int, least: int = 2, tidy: bool = True) -> list:
        """Merge the batches below ``before`` of each partition that has ``least`` or more of them.

        The latest batch must stay outside, since a replay may write it again. Returns the
        folded partition values.
        """
        commits = self._commits()
        open_ = self._open(commits).where(F.col(BATCH) < before)
        found = open_.groupBy(self.by).agg(
            F.countDistinct(BATCH).alias("n"), F.max(BATCH).alias("upto")
        )
        due = found.where(F.col("n") >= least).collect()  # partitions, not rows
        if not due:
            return []
        known = {r[self.by]: r for r in commits.collect()}
        version = 1 + max((r[VERSION] for r in known.values()), default=-1)
        days = self.spark.createDataFrame([(r[self.by],) for r in due], T.StructType([self.commit_schema[0]]))
        days = days.withColumnRenamed(self.by, "__day")
        picked = [
            part.join(days, F.col(self.by).eqNullSafe(F.col("__day")), "left_semi").select(*self.columns)
            for part in (open_, self._folded(commits))
        ]
        rows = picked[0].union(picked[1])
        rows = self.merge(rows) if self.merge else rows
        (
            rows.withColumn(VERSION, F.lit(version).cast("long"))
            .hint("rebalance", F.col(self.by))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(self.by, VERSION)
            .parquet(f"{self.path}/folded")
        )
        state = {k: (r["held"], r["upto"]) for k, r in known.items()}
        state |= {r[self.by]: (version, r["upto"]) for r in due}
        lines = [(k, held, upto, version) for k, (held, upto) in state.items()]
        commit = self.spark.createDataFrame(lines, self.commit_schema).coalesce(1)
        commit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            VERSION
        ).parquet(f"{self.path}/commits")
        if tidy:
            self._tidy([r[self.by] for r in due], known, version)
        return [r[self.by] for r in due]

    def _tidy(self, values: list, known: dict, version: int) -> None:
        """Remove what the fold has replaced."""
        replaced = {v: known[v]["held"] for v in values if v in known}
        old = [f"{self.path}/folded/{self._folder(v)}/{VERSION}={held}" for v, held in replaced.items()]
        rows = stored(self.spark, f"{self.path}/open", self.open_schema)
        upto = {r[self.by]: r["upto"] for r in self._commits().collect()}
        for r in rows.select(self.by, BATCH).distinct().collect():
            if r[self.by] in values and r[BATCH] <= upto[r[self.by]]:
                old.append(f"{self.path}/open/{self._folder(r[self.by])}/{BATCH}={r[BATCH]}")
        if version:
            old.append(f"{self.path}/commits/{VERSION}={version - 1}")
        remove(self.spark, old)

    def _folder(self, value) -> str:
        return f"{self.by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
