"""The roles of an event study, filled from the local star-schema tables.

Brands stand for tickers, line items for trades, large returned lines for
dividends and user events for minute bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.core import in_session, minute_of_day

MARKET = "MKT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    return line.join(part, "l_partkey").select(
        "ticker", F.to_date("l_shipdate").alias("date_et"), F.try_divide("l_extendedprice", "l_quantity").alias("px"), "l_quantity", "l_discount",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
    )


def _bars(df: DataFrame, *keys: str) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px")
    return df.groupBy(*keys).agg(
        F.min(order)["px"].alias("open"), F.max(order)["px"].alias("close"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.sum("l_quantity").alias("volume"), F.count("*").alias("transactions"),
    )


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all tickers, and of the market as one more ticker."""
    t = trades(spark, sf_dir)
    market = _bars(t, "date_et").withColumn("ticker", F.lit(MARKET))
    return _bars(t, "ticker", "date_et").unionByName(market)


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("declaration_date"))
    t = trades(spark, sf_dir).filter("l_returnflag = 'R' AND l_quantity >= 40").join(orders, "l_orderkey", "left")
    return t.select("ticker", F.col("date_et").alias("ex_date"), (F.col("px") * F.col("l_discount")).alias("cash_amount"), F.col("l_linestatus").alias("distribution_type"), F.col("l_linenumber").cast("long").alias("frequency"), "declaration_date")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active row per brand; #11, #12 and #13 once more as delisted, under an older description."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.max("p_type").alias("top"), F.min("p_type").alias("low"))
    odd = F.substring("ticker", -1, 1).cast("int") % 2 == 1
    active = brands.select(
        "ticker", F.lit(True).alias("active"), F.lit("CS").alias("type"), F.lit("1995-01-01").cast("date").alias("list_date"), F.lit(None).cast("date").alias("delisted_date"),
        F.when(odd, F.col("top")).alias("sic_description"), F.when(F.col("ticker") != "Brand#15", F.col("top")).alias("description"),
    )
    old = brands.filter(F.col("ticker").isin("Brand#11", "Brand#12", "Brand#13")).select(
        "ticker", F.lit(False), F.lit("CS"), F.lit("1990-01-01").cast("date"), F.lit("1994-06-30").cast("date"), F.when(F.col("ticker") == "Brand#13", F.col("low")), F.col("low")
    )
    return active.union(old)


def pseudo_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_type").alias("pseudo_sector"))
    return brands.filter(F.substring("ticker", -1, 1).isin("2", "4")).withColumn("label_level", F.lit("hybrid")).withColumn("sec_type", F.lit("CS"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts_et"), F.col("value").alias("price"), "event_id")
    ev = ev.withColumn("date_et", F.to_date("ts_et")).withColumn("min_of_day", minute_of_day("ts_et"))
    return ev.filter(in_session("min_of_day"))
