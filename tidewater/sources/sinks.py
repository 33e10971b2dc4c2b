"""Sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def write_partitioned(df: DataFrame, path: str, column: str) -> None:
    """Overwrites; rows of one partition value are brought together first, so each gets few files."""
    df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Fails if anything is there."""
    df.write.mode("errorifexists").parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes to the shared folder and reads back: every later pass sees the same bits, which sums of doubles made anew don't give."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_single_csv(df: DataFrame, path: str, sort: list[str] | None = None) -> None:
    """One CSV file with a header, for small results; array columns are left out."""
    plain = df.select(*(f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct"))).coalesce(1)
    (plain.sortWithinPartitions(*sort) if sort else plain).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
