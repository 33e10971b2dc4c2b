"""Scans: bars from gz CSV, JSON lines, guarded Parquet, discovery and streams."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.core import minute_of_day, ns_to_wall

#: Applied by position; volume is fractional in newer files.
BAR_DDL = "ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
DIVIDEND_DDL = (
    "id string, ticker string, ex_dividend_date string, record_date string, pay_date string, declaration_date string, frequency long, cash_amount double, "
    "currency string, distribution_type string, historical_adjustment_factor double, split_adjusted_cash_amount double"
)
METADATA_DDL = (
    "ticker string, market string, locale string, type string, active boolean, last_updated_utc string, "
    "address struct<address1:string,address2:string,city:string,state:string,postal_code:string>, description string, list_date string, sic_code string, "
    "sic_description string, market_cap double, total_employees long, weighted_shares_outstanding long, primary_exchange string, delisted_utc string, overview_error string"
)


def read_bars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Day bars: the header's names are ignored, the date is wall-clock in New York."""
    df = spark.read.schema(BAR_DDL).option("header", True).csv(paths)
    return df.withColumn("date_et", F.to_date(ns_to_wall("window_start")))


def read_minute_bars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    df = spark.read.schema(BAR_DDL).option("header", True).csv(paths).withColumn("ts_et", ns_to_wall("window_start"))
    return df.withColumn("date_et", F.to_date("ts_et")).withColumn("min_of_day", minute_of_day("ts_et"))


def read_dividends(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    df = spark.read.schema(DIVIDEND_DDL).json(paths)
    dates = {c: F.expr(f"try_to_date({c})") for c in ("record_date", "pay_date", "declaration_date")}
    return df.withColumns(dates | {"ex_date": F.expr("try_to_date(ex_dividend_date)")}).drop("ex_dividend_date")


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    df = spark.read.schema(METADATA_DDL).json(paths)
    return df.withColumn("list_date", F.expr("try_to_date(list_date)")).withColumn("delisted_date", F.expr("try_to_date(substring(delisted_utc, 1, 10))"))


class MissingSource(ValueError):
    pass


def read_required_parquet(spark: SparkSession, path: str, label: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingSource(f"{label}: nothing at {path}; build it first or correct the path") from e
        raise


def is_csv_path(path: str) -> bool:
    """True if the last part of the path speaks of csv."""
    return "csv" in path.rstrip("/").rpartition("/")[2].lower()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if is_csv_path(path) else spark.read.parquet(path)


def discover_months(spark: SparkSession, root: str, prefix: str = "day_") -> list[str]:
    """The yyyy-MM of directories named <prefix>yyyy-MM, in order, in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(m[1] for n in names if (m := re.fullmatch(re.escape(prefix) + r"(\d{4}-\d{2})", n)))


def path_status(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified_ms): provenance of a source."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    s = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    return spark.createDataFrame([(path, s.getLen(), s.getModificationTime())], "path string, length long, modified_ms long")


def bar_stream_from_files(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Replay of JSON bar files in the order they were written."""
    return spark.readStream.schema(BAR_DDL).option("maxFilesPerTrigger", per_trigger).json(path)


def bar_stream_from_kafka(spark: SparkSession, servers: str, topic: str, latest: bool = True, per_trigger: int = 200_000) -> DataFrame:
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    raw = raw.option("startingOffsets", "latest" if latest else "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select(F.from_json(F.col("value").cast("string"), BAR_DDL).alias("b")).select("b.*")
