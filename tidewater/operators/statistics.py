"""Group summaries, buckets, curves, audits and diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.core import exact_percentile, ratio
from tidewater.sources.sinks import stored


def summary_columns() -> list[Column]:
    mean, med = lambda c: F.avg(c).alias(f"mean_{c}"), lambda c, p, name: exact_percentile(c, p).alias(f"{name}_{c}")
    share = lambda cond, c: F.avg(F.when(F.col(c).isNotNull(), cond.cast("double")))
    return [
        F.count("*").alias("n_events"), F.count_distinct("ticker").alias("n_tickers"),
        F.count("capture_ret_abn").alias("n_capture_ret_abn"), F.count("capture_ret").alias("n_capture_ret"), F.count("drop_ratio").alias("n_drop_ratio"),
        mean("capture_ret_abn"), F.stddev_samp("capture_ret_abn").alias("stddev_capture_ret_abn"),
        med("capture_ret_abn", 0.5, "median"), med("capture_ret_abn", 0.25, "p25"), med("capture_ret_abn", 0.75, "p75"),
        share(F.col("capture_ret_abn") > 0, "capture_ret_abn").alias("positive_capture_ret_abn_rate"),
        mean("capture_ret"), med("capture_ret", 0.5, "median"),
        mean("drop_ratio"), med("drop_ratio", 0.5, "median"), med("drop_ratio", 0.25, "p25"), med("drop_ratio", 0.75, "p75"),
        share(F.col("drop_ratio") < 1, "drop_ratio").alias("drop_ratio_lt_1_rate"),
    ]


def with_interval(df: DataFrame, c: str, n: str) -> DataFrame:
    """Standard error and 95% interval of mean_<c>, where more than one value gives them."""
    ok = (F.col(n) > 1) & F.col(f"stddev_{c}").isNotNull()
    df = df.withColumn(f"se_{c}", F.when(ok, F.col(f"stddev_{c}") / F.sqrt(n)))
    return df.withColumns({f"ci95_low_{c}": F.col(f"mean_{c}") - 1.96 * F.col(f"se_{c}"), f"ci95_high_{c}": F.col(f"mean_{c}") + 1.96 * F.col(f"se_{c}")})


def group_summary(frame: DataFrame, group: str | None = None, min_events: int = 1, min_tickers: int = 1) -> DataFrame:
    """The 26-column summary, by group or overall.  Shares are of the frame's own totals, joined as one row rather than collected."""
    made = (frame.groupBy(group) if group else frame.groupBy()).agg(*summary_columns())
    totals = frame.agg(F.count("*").alias("all_events"), F.count_distinct("ticker").alias("all_tickers"))
    made = with_interval(made.join(F.broadcast(totals)), "capture_ret_abn", "n_capture_ret_abn")
    low_n, low_t = F.col("n_events") < min_events, F.col("n_tickers") < min_tickers
    return made.withColumns({
        "event_share": ratio("n_events", "all_events"), "ticker_share": ratio("n_tickers", "all_tickers"),
        "low_n_flag": low_n, "low_ticker_flag": low_t, "report_eligible_flag": ~(low_n | low_t),
    }).drop("all_events", "all_tickers")


def distinct_cuts(candidates: Sequence[float | None], maximum: float) -> list[float]:
    """Cut points below the maximum, near-equal ones once."""
    cuts: list[float] = []
    for c in sorted(x for x in candidates if x is not None):
        if c >= maximum or math.isclose(c, maximum, abs_tol=1e-12):
            continue
        if not cuts or not math.isclose(c, cuts[-1], abs_tol=1e-12):
            cuts.append(float(c))
    return cuts


def quantile_cuts(sample: DataFrame, value: str, k: int) -> list[float]:
    """Exact cut points at i/k, in one aggregation; k numbers reach the driver.  None where no row has a value."""
    row = sample.agg(F.max(value), *(exact_percentile(value, i / k) for i in range(1, k))).head()
    return [] if row[0] is None else distinct_cuts(row[1:], row[0])


def quantile_bucket(sample: DataFrame, value: str, bucket: str, k: int, required: bool = False) -> DataFrame:
    """Adds Q01..Qk by intervals (lower, upper]; a null value has no bucket.  `required`: a sample without values is an error.

    A cut is some row's value, so the sample is stored first: made anew, that row's value may differ in its last bit and fall beyond the cut.
    """
    sample = stored(sample, bucket)
    cuts = quantile_cuts(sample, value, k)
    if required and not cuts and sample.filter(F.col(value).isNotNull()).isEmpty():
        raise ValueError(f"no usable {value}")
    number = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(1))
    return sample.withColumn(bucket, F.when(F.col(value).isNotNull(), F.concat(F.lit("Q"), F.lpad(number.cast("string"), 2, "0"))))


def bucket_boundaries(bucketed: DataFrame, dimension: str, value: str, bucket: str) -> DataFrame:
    """Observed bounds of every bucket: the upper one is a cut, the lower one the cut below."""
    df = bucketed.groupBy(F.col(bucket).alias("bucket_label")).agg(F.max(value).alias("observed_max"), F.min(value).alias("observed_min"), F.count("*").alias("n_events"))
    return df.withColumn("dimension", F.lit(dimension))


def event_time_curve(stable: DataFrame, panel: DataFrame) -> DataFrame:
    """Abnormal returns by offset over events with all their bars."""
    keys = stable.select("ticker", "ex_date").distinct()
    rows = panel.filter(F.col("abn_ret_cc").isNotNull()).join(keys, ["ticker", "ex_date"], "left_semi")
    curve = rows.groupBy("offset").agg(
        F.count("*").alias("n_events"), F.count_distinct("ticker").alias("n_tickers"), F.avg("abn_ret_cc").alias("mean_abn_ret_cc"), F.stddev_samp("abn_ret_cc").alias("stddev_abn_ret_cc"),
        *(exact_percentile("abn_ret_cc", p).alias(f"{n}_abn_ret_cc") for p, n in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"))),
    )
    top = date_concentration(rows)
    curve = with_interval(curve, "abn_ret_cc", "n_events").join(top, "offset", "left")
    return curve.withColumn("top_calendar_date_share", ratio("top_calendar_date_events", "n_events"))


def date_concentration(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("offset", "bar_date").agg(F.count("*").alias("n"))
    return per.groupBy("offset").agg(F.count("*").alias("n_calendar_dates"), F.max("n").alias("top_calendar_date_events"))


def overnight_summary(base: DataFrame) -> DataFrame:
    parts: list[Column] = [F.count("*").alias("n_events"), F.count_distinct("ticker").alias("n_tickers")]
    for c in ("stock_overnight_ret", "abn_overnight_ret", "capture_ret"):
        parts += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"stddev_{c}")]
        parts += [exact_percentile(c, p).alias(f"{n}_{c}") for p, n in ((0.5, "median"), (0.25, "p25"), (0.75, "p75"))]
    return base.agg(*parts)


#: Two sides that must agree, by name.
IDENTITIES = {
    "drop_pct_is_ratio_times_yield": ("drop_pct", "drop_ratio * div_yield"),
    "capture_is_yield_less_drop": ("capture_ret", "div_yield - drop_pct"),
    "abnormal_is_capture_less_market": ("capture_ret_abn", "capture_ret - mkt_overnight_ret"),
    "overnight_is_minus_drop": ("stock_overnight_ret", "-drop_pct"),
    "abnormal_overnight_is_overnight_less_market": ("abn_overnight_ret", "stock_overnight_ret - mkt_overnight_ret"),
}


def metric_identities(grain: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Per identity: eligible rows, violations, largest error; all in one pass, then unpivoted."""
    gap = {n: F.abs(F.col(a) - F.expr(b)) for n, (a, b) in IDENTITIES.items()}
    one = grain.agg(*(F.struct(F.count(g).alias("n_eligible"), F.coalesce(F.sum((g > tolerance).cast("long")), F.lit(0)).alias("n_violations"), F.max(g).alias("max_abs_error")).alias(n) for n, g in gap.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("identity"), F.col(f"{n}.n_eligible"), F.col(f"{n}.n_violations"), F.col(f"{n}.max_abs_error")) for n in gap))
    return one.select(F.inline(rows))


def sample_funnel(grain: DataFrame, market: str) -> DataFrame:
    """Events that pass each filter in turn, and those usable for each analysis, counted in one pass."""
    cash = "cash_amount > 0"
    core = f"{cash} AND has_core"
    contiguous = f"{core} AND window_contiguous"
    base = f"{contiguous} AND ticker <> '{market}'"
    filters = [("raw", "true"), ("cash_positive", cash), ("has_core", core), ("window_contiguous", contiguous), ("benchmark_excluded", base)]
    uses = [("yield_usable", "div_yield IS NOT NULL"), ("volatility_usable", "pre_vol IS NOT NULL"), ("liquidity_usable", "pre_avg_dollar_volume IS NOT NULL")]
    if "sic_description" in grain.columns:
        uses += [("sic_known", "sic_description <> 'UNKNOWN'"), ("sic_unknown", "sic_description = 'UNKNOWN'")]
    uses += [("full_event_time_window", "n_bars = 9")]
    if "sector_state" in grain.columns:
        uses += [(s, f"sector_state = '{s}'") for s in ("pseudo_recovered", "still_unresolved")]
    stages = [(n, c, "sequential_filter") for n, c in filters] + [(n, f"{base} AND {c}", "analysis_population") for n, c in uses]
    counts = grain.agg(*(F.coalesce(F.sum(F.when(F.expr(c), 1)), F.lit(0)).cast("long").alias(n) for n, c, _ in stages))
    prior = lambda k: filters[max(k - 1, 0)][0] if k < len(filters) else "benchmark_excluded"
    rows = F.array(*(F.struct(F.lit(k + 1).alias("stage_order"), F.lit(n).alias("stage"), F.lit(t).alias("stage_type"), F.col(n).alias("n_events"), F.col(prior(k)).alias("prior_n_events"), ratio(n, prior(k)).alias("retention"), ratio(n, "raw").alias("cumulative_retention")) for k, (n, _, t) in enumerate(stages)))
    return counts.select(F.inline(rows))


def dimension_diagnostics(summary: DataFrame, label: str, dimension: str) -> DataFrame:
    """Shape of the means over ordered buckets: spread, monotonic steps and rank correlation with the order."""
    order = Window.partitionBy(F.lit(0)).orderBy(label)
    m = F.col("mean_capture_ret_abn") * 10000
    tied = Window.partitionBy("m")
    df = summary.select(label, m.alias("m"), (F.col("median_capture_ret_abn") * 10000).alias("md"), (F.col("positive_capture_ret_abn_rate") * 100).alias("pr"))
    df = df.withColumns({"x": F.row_number().over(order).cast("double"), "r": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("m")), "up": (F.lead("m").over(order) >= F.col("m")).cast("int")})
    df = df.withColumn("r", F.avg("r").over(tied))
    out = df.agg(
        F.count("*").cast("int").alias("actual_bucket_count"), F.min_by("m", "x").alias("low_bucket_mean_bps"), F.max_by("m", "x").alias("high_bucket_mean_bps"),
        (F.max("m") - F.min("m")).alias("mean_range_bps"), (F.max("md") - F.min("md")).alias("median_range_bps"), (F.max("pr") - F.min("pr")).alias("positive_rate_range_pp"),
        F.coalesce(F.sum("up"), F.lit(0)).cast("int").alias("monotonic_step_count"),
        F.coalesce(ratio(F.covar_pop("x", "r"), F.stddev_pop("x") * F.stddev_pop("r")), F.lit(0.0)).alias("spearman_bucket_mean"),
    )
    return out.withColumn("high_minus_low_bps", F.col("high_bucket_mean_bps") - F.col("low_bucket_mean_bps")).withColumn("dimension", F.lit(dimension))


def sector_diagnostics(summary: DataFrame, group: str, taxonomy: str) -> DataFrame:
    """Concentration over all categories, extremes over the eligible ones (ties by label)."""
    ranked = summary.withColumn("__n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_events"), group)))
    ok = F.col("report_eligible_flag")
    key = F.when(ok, F.struct(F.col("mean_capture_ret_abn").alias("v"), F.col(group).alias("g"), "n_events", "n_tickers"))
    out = ranked.agg(
        F.sum("n_events").alias("analysis_events"), F.count("*").cast("int").alias("category_count"), F.count(F.when(ok, 1)).cast("int").alias("eligible_category_count"),
        F.sum(F.when(F.col("__n") == 1, F.col("n_events"))).alias("top1"), F.sum(F.when(F.col("__n") <= 5, F.col("n_events"))).alias("top5"), F.max(key).alias("hi"), F.min(key).alias("lo"),
    )
    return out.select(
        F.lit(taxonomy).alias("taxonomy"), "analysis_events", "category_count", "eligible_category_count", ratio("top1", "analysis_events").alias("top_1_event_share"), ratio("top5", "analysis_events").alias("top_5_event_share"),
        F.col("hi.g").alias("highest_group"), (F.col("hi.v") * 10000).alias("highest_mean_bps"), F.col("lo.g").alias("lowest_group"), (F.col("lo.v") * 10000).alias("lowest_mean_bps"), ((F.col("hi.v") - F.col("lo.v")) * 10000).alias("eligible_mean_range_bps"),
    )


def pnl(df: DataFrame, value: str = "capture_ret_abn") -> DataFrame:
    return df.agg(F.count(value).alias("n"), (F.avg(value) * 10000).alias("mean_bps"), (exact_percentile(value, 0.5) * 10000).alias("median_bps"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    return a.select(key).subtract(b.select(key)).withColumn("side", F.lit("left")).union(b.select(key).subtract(a.select(key)).withColumn("side", F.lit("right")))
