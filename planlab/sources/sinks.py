"""Sinks: discard, delimited text, Parquet, nested JSON; and reload of stored features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discard(df: DataFrame) -> None:
    """Run the whole plan, keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_features(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Feature or result table as CSV with header, or Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """One id per line as text."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_job_log(jobs: DataFrame, path: str) -> None:
    """Nested job records as JSON lines."""
    jobs.write.mode("overwrite").json(path)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reload persisted CSV features under their declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)
