"""The session that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, because wall-clock times are derived with from_utc_timestamp; adaptive execution sizes shuffles and splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidewater", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()
