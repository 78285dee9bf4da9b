"""Questions and removals that Spark's readers and writers do not offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The Parquet table at ``path``; None where there is none yet. Other errors are raised."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in NOT_THERE:
            return None
        raise


def remove(spark: SparkSession, folders: Sequence[str]) -> None:
    """Delete folders, wherever Hadoop's file systems reach; absent ones are fine."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
