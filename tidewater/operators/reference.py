"""Entity reference data: which attributes held when, sector states, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.core import blank_to_null, truthy

UNKNOWN = "UNKNOWN"


class ContractError(ValueError):
    pass


def asof_metadata(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Each event with the attributes valid on its ex-date: the candidate delisted first after it, never-delisted last.

    The validity stands in the join condition, so events without a candidate stay, with nulls.
    """
    m = meta.select(F.col("ticker").alias("m_ticker"), F.col("delisted_date").alias("m_delisted"), "sic_description", "active")
    valid = (F.col("ticker") == F.col("m_ticker")) & (F.col("m_delisted").isNull() | (F.col("m_delisted") >= F.col("ex_date")))
    first = Window.partitionBy("ticker", "ex_date").orderBy(F.col("m_delisted").asc_nulls_last(), F.col("active").desc_nulls_last(), F.col("sic_description").asc_nulls_last())
    return events.join(m, valid, "left").withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "m_ticker")


def prefer_active(meta: DataFrame) -> DataFrame:
    """One row per ticker, an active one if there is any."""
    first = Window.partitionBy("ticker").orderBy(F.col("active").desc_nulls_last(), F.col("list_date").desc_nulls_last())
    return meta.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def label_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label, and their labels in order."""
    df = rows.groupBy(key).agg(F.count_distinct(label).alias("n_labels"), F.array_join(F.sort_array(F.collect_set(label)), "; ").alias("labels"))
    return df.filter("n_labels > 1")


def unambiguous_sic(meta: DataFrame) -> DataFrame:
    """(ticker, sic, list_date): tickers whose rows agree on one description, with their earliest listing."""
    df = meta.withColumn("sic", blank_to_null("sic_description")).groupBy("ticker").agg(F.count_distinct("sic").alias("n"), F.max("sic").alias("sic"), F.min("list_date").alias("list_date"))
    return df.filter("n = 1").drop("n")


def enrich_sic(grain: DataFrame, meta: DataFrame) -> DataFrame:
    """sic_description of every event: UNKNOWN where none is known, or the event precedes the listing."""
    sic = unambiguous_sic(meta).withColumnRenamed("ticker", "__t")
    known = truthy(F.col("sic").isNotNull() & ~truthy(F.col("ex_date") < F.col("list_date")))
    return grain.join(sic, F.col("ticker") == F.col("__t"), "left").withColumn("sic_description", F.when(known, F.col("sic")).otherwise(UNKNOWN)).drop("__t", "sic", "list_date")


def pseudo_lookup(source: DataFrame, level: str) -> DataFrame:
    """The lookup of one label level; an absent level, blank keys or conflicting labels are errors, never a fallback."""
    missing = {"ticker", "pseudo_sector", "label_level"} - set(source.columns)
    if missing:
        raise ContractError(f"pseudo-sector source lacks {sorted(missing)}")
    rows = source.select(blank_to_null("ticker").alias("ticker"), blank_to_null("pseudo_sector").alias("pseudo_sector"), blank_to_null("label_level").alias("label_level"))
    rows = rows.filter((F.col("label_level") == level) & F.col("ticker").isNotNull() & F.col("pseudo_sector").isNotNull()).distinct()
    if rows.isEmpty():
        raise ContractError(f"no pseudo-sector rows of level {level!r}")
    if not label_conflicts(rows, "ticker", "pseudo_sector").isEmpty():
        raise ContractError("conflicting pseudo-sector labels for a ticker")
    return rows


def sector_states(base: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds pseudo_sector and the disjoint states; the lookup has a row per ticker, so rows never multiply."""
    p = lookup.withColumnRenamed("ticker", "__t")
    joined = base.join(p, F.col("ticker") == F.col("__t"), "left").drop("__t")
    known = F.col("sic_description") != UNKNOWN
    found = F.col("pseudo_sector").isNotNull()
    return joined.withColumns({
        "direct_sic_known": known,
        "pseudo_recovered": ~known & found,
        "still_unresolved": ~known & ~found,
        "sector_state": F.when(known, "direct_sic_known").when(found, "pseudo_recovered").otherwise("still_unresolved"),
        "sector_source": F.when(known, "direct_sic_current_reference").when(found, "model_predicted_pseudo_sector").otherwise("unresolved"),
    })


def sector_bridge(states: DataFrame) -> DataFrame:
    """Events and tickers of each state, with their share of all events."""
    df = states.groupBy("sector_state").agg(F.count("*").alias("n_events"), F.count_distinct("ticker").alias("n_tickers"))
    return df.withColumn("event_share", F.col("n_events") / F.sum("n_events").over(Window.partitionBy(F.lit(0))))


def coverage_bucket(described: str, sic: str):
    """TRAIN: text and label; FILLABLE: text only; SIC_ONLY: label only."""
    d, s = F.col(described), F.col(sic)
    return F.when(d & s, "TRAIN").when(d, "FILLABLE").when(s, "SIC_ONLY").otherwise("UNREACHABLE")


def deterministic_sample(df: DataFrame, bucket: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of every bucket in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def dedupe_text(df: DataFrame, text: str, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(text).orderBy(order))).filter("__n = 1").drop("__n")
