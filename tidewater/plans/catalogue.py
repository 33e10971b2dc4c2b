"""The queries of the event study over the local tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.core import exact_percentile, ratio, sic_division, three_levels, yield_bucket
from tidewater.operators import event_study as es
from tidewater.operators import intraday as intra
from tidewater.operators import learning as ml
from tidewater.operators import reference as ref
from tidewater.operators import statistics as st
from tidewater.sources import fixtures as fx

MARKET = fx.MARKET
MARKET_USER = "1"
BUCKETS, MIN_N, MIN_TICKERS, LEVEL = 5, 30, 5, "hybrid"
TRAIN_END = "1998-12-31"
Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Registers a query; its dates are shown as text, so that every engine shows them alike."""

    def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t in ("date", "timestamp")})

    CATALOGUE[f.__name__] = shown
    return f


PRICES = {"open", "close", "high", "low", "mkt_open", "mkt_close", "prev_close", "ex_open", "ex_close", "post_close", "prev_bar_close", "prev_mkt_close", "close_m1", "open_0", "close_p3", "cash_amount"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits, as sums depend on order in the last ones; money volumes are large and take fewer, prices are exact and take more."""
    places = lambda c: 3 if "avg_dollar_volume" in c else 8 if c == "dollar_volume" else 10 if c in PRICES else digits
    return df.select(*((F.round(c, places(c)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def events(spark, d) -> DataFrame:
    return es.consolidate(fx.dividends(spark, d))


def panel(spark, d) -> DataFrame:
    return es.event_panel(events(spark, d), fx.day_bars(spark, d), MARKET)


def grain(spark, d) -> DataFrame:
    return es.derived_fields(es.event_grain(panel(spark, d)))


def base(spark, d) -> DataFrame:
    return es.base_population(grain(spark, d), MARKET)


def states(spark, d) -> DataFrame:
    enriched = ref.enrich_sic(grain(spark, d), fx.metadata(spark, d))
    return ref.sector_states(enriched, ref.pseudo_lookup(fx.pseudo_sectors(spark, d), LEVEL))


@query
def trading_calendar(spark, d):
    return es.trading_calendar(fx.day_bars(spark, d))


@query
def consolidated_events(spark, d):
    return rounded(events(spark, d).withColumn("distribution_types", F.array_join("distribution_types", ",")))


@query
def event_panel(spark, d):
    filled = panel(spark, d).fillna(-1, ["transactions", "span_days"])
    return rounded(filled.select("ticker", "ex_date", "offset", "bar_date", "open", "close", "high", "low", "volume", "transactions", "span_days", "mkt_open", "mkt_close", "dollar_volume", "ex_ym"))


GRAIN = ("ticker", "ex_date", "cash_amount", "n_distributions", "frequency", "prev_close", "ex_open", "ex_close", "post_close", "pre_avg_ret", "pre_avg_abn_ret", "pre_vol", "pre_avg_volume", "pre_avg_dollar_volume", "post_avg_ret", "post_avg_abn_ret", "n_bars", "n_bars_pre", "n_bars_post", "max_span_days", "drop_ratio", "drop_pct", "div_yield", "capture_ret", "mkt_overnight_ret", "capture_ret_abn", "hold_ret")


@query
def event_grain(spark, d):
    return rounded(grain(spark, d).select(*GRAIN))


@query
def panel_returns_lag(spark, d):
    return rounded(panel(spark, d).select("ticker", "ex_date", "offset", "prev_bar_close", "prev_mkt_close", "ret_cc", "mkt_ret_cc", "abn_ret_cc"))


@query
def value_at_offset(spark, d):
    p = panel(spark, d)
    return rounded(p.groupBy("ticker", "ex_date").agg(es.at_offset(-1, "close").alias("close_m1"), es.at_offset(0, "open").alias("open_0"), es.at_offset(3, "close").alias("close_p3")))


@query
def quality_flags(spark, d):
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c)
    return grain(spark, d).agg(F.count("*").alias("n_events"), *(n(c) for c in ("has_core", "window_complete", "window_contiguous", "drop_ratio_extreme", "low_yield")))


@query
def headline_cuts_union(spark, d):
    b = base(spark, d)
    cut = lambda name, df: st.pnl(df).withColumn("cut", F.lit(name))
    return rounded(cut("all", b).union(cut("not extreme", b.filter("NOT drop_ratio_extreme"))).union(cut("low yield out", b.filter("NOT low_yield"))))


@query
def yield_bucket_fixed(spark, d):
    g = base(spark, d).withColumn("bucket", yield_bucket("div_yield"))
    return rounded(g.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("capture_ret_abn").alias("mean_abn"), exact_percentile("capture_ret_abn", 0.5).alias("median_abn"), F.avg("drop_ratio").alias("mean_drop"), exact_percentile("drop_ratio", 0.5).alias("median_drop")))


@query
def by_year(spark, d):
    return rounded(base(spark, d).groupBy(F.year("ex_date").alias("year")).agg(F.count("*").alias("n"), F.avg("capture_ret_abn").alias("mean_abn"), exact_percentile("capture_ret_abn", 0.5).alias("median_abn")))


@query
def time_decay_curve(spark, d):
    return rounded(panel(spark, d).groupBy("offset").agg(F.count("abn_ret_cc").alias("n"), F.avg("abn_ret_cc").alias("mean_abn"), exact_percentile("abn_ret_cc", 0.5).alias("median_abn")))


@query
def offset_date_concentration(spark, d):
    return st.date_concentration(panel(spark, d).filter("abn_ret_cc IS NOT NULL"))


@query
def overall_summary(spark, d):
    return rounded(st.group_summary(base(spark, d), None, MIN_N, MIN_TICKERS))


def _bucketed(spark, d, value: str) -> DataFrame:
    return st.quantile_bucket(base(spark, d).filter(F.col(value).isNotNull()), value, "bucket", BUCKETS)


@query
def group_summary_yield_q5(spark, d):
    return rounded(st.group_summary(_bucketed(spark, d, "div_yield"), "bucket", MIN_N, MIN_TICKERS))


@query
def group_summary_vol_q5(spark, d):
    return rounded(st.group_summary(_bucketed(spark, d, "pre_vol"), "bucket", MIN_N, MIN_TICKERS))


@query
def group_summary_liquidity_q5(spark, d):
    return rounded(st.group_summary(_bucketed(spark, d, "pre_avg_dollar_volume"), "bucket", MIN_N, MIN_TICKERS))


@query
def bucket_boundaries(spark, d):
    return rounded(st.bucket_boundaries(_bucketed(spark, d, "div_yield"), "yield", "div_yield", "bucket"))


@query
def group_summary_sector(spark, d):
    return rounded(st.group_summary(es.base_population(states(spark, d), MARKET), "sic_description", MIN_N, MIN_TICKERS))


@query
def group_summary_pseudo_sector(spark, d):
    return rounded(st.group_summary(es.base_population(states(spark, d), MARKET).filter("pseudo_recovered"), "pseudo_sector", MIN_N, MIN_TICKERS))


@query
def sample_funnel(spark, d):
    return rounded(st.sample_funnel(states(spark, d), MARKET))


@query
def metric_identities(spark, d):
    return rounded(st.metric_identities(grain(spark, d)))


@query
def dimension_diagnostics(spark, d):
    return rounded(st.dimension_diagnostics(st.group_summary(_bucketed(spark, d, "div_yield"), "bucket"), "bucket", "yield"), 5)


@query
def sector_diagnostics(spark, d):
    known = es.base_population(states(spark, d), MARKET).filter("direct_sic_known")
    return rounded(st.sector_diagnostics(st.group_summary(known, "sic_description", MIN_N, 1), "sic_description", "direct"), 5)


@query
def event_time_daily(spark, d):
    p = panel(spark, d)
    return rounded(st.event_time_curve(base(spark, d).filter("n_bars = 9"), p))


@query
def event_time_overnight(spark, d):
    return rounded(st.overnight_summary(base(spark, d)))


@query
def asof_metadata(spark, d):
    df = ref.asof_metadata(grain(spark, d).select("ticker", "ex_date"), fx.metadata(spark, d))
    return df.select("ticker", "ex_date", "m_delisted", "sic_description", "active")


@query
def prefer_active_metadata(spark, d):
    return ref.prefer_active(fx.metadata(spark, d)).select("ticker", "active", "sic_description", "list_date")


@query
def sic_enrichment_guard(spark, d):
    return ref.enrich_sic(grain(spark, d).select("ticker", "ex_date"), fx.metadata(spark, d))


@query
def sector_states(spark, d):
    return es.base_population(states(spark, d), MARKET).select("event_id", "sic_description", "pseudo_sector", "sector_state", "sector_source")


@query
def sector_bridge(spark, d):
    return rounded(ref.sector_bridge(es.base_population(states(spark, d), MARKET)))


@query
def duplicate_keys(spark, d):
    return st.duplicate_keys(fx.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query
def label_conflicts(spark, d):
    return ref.label_conflicts(fx.metadata(spark, d), "ticker", "description")


def _has(df: DataFrame) -> DataFrame:
    return df.withColumns({"has_text": F.col("description").isNotNull(), "has_sic": F.col("sic_description").isNotNull()})


@query
def coverage_crosstab(spark, d):
    return _has(fx.metadata(spark, d)).groupBy("has_text", "has_sic").agg(F.count("*").alias("n"))


@query
def coverage_buckets_left_join(spark, d):
    meta = _has(ref.prefer_active(fx.metadata(spark, d)).filter("ticker <> 'Brand#55'")).select("ticker", ref.coverage_bucket("has_text", "has_sic").alias("bucket"))
    return events(spark, d).join(meta, "ticker", "left").groupBy(F.coalesce("bucket", F.lit("NO_METADATA")).alias("bucket")).agg(F.count("*").alias("n_events"), F.count_distinct("ticker").alias("n_tickers"))


@query
def sip_ticker_list(spark, d):
    return fx.day_bars(spark, d).select("ticker").distinct()


@query
def universe_set_audit(spark, d):
    bars, meta = fx.day_bars(spark, d).select("ticker").distinct(), fx.metadata(spark, d).select("ticker").distinct()
    tag = lambda df, name: df.withColumn("part", F.lit(name))
    return tag(bars.intersect(meta), "both").union(tag(bars.join(meta, "ticker", "left_anti"), "bars only")).union(tag(meta.join(bars, "ticker", "left_anti"), "metadata only"))


@query
def model_features(spark, d):
    return rounded(base(spark, d).select("event_id", "ticker", "ex_date", "cash_amount", "prev_close", "div_yield", "pre_avg_ret", "pre_avg_abn_ret", "pre_vol", "pre_avg_dollar_volume", "declaration_lead_days", "event_month"))


@query
def model_outcomes(spark, d):
    return rounded(base(spark, d).select("event_id", "capture_ret", "capture_ret_abn", "drop_ratio", "drop_pct", "hold_ret"))


@query
def handoff_key_parity(spark, d):
    b = base(spark, d)
    return st.key_difference(b.filter("pre_vol IS NOT NULL"), b.filter("div_yield >= 0.01"), "event_id")


@query
def intraday_bins(spark, d):
    return rounded(intra.bins(fx.minute_bars(spark, d)))


def _sessions(spark, d) -> DataFrame:
    return intra.session_features(intra.bins(fx.minute_bars(spark, d)))


@query
def session_features(spark, d):
    return rounded(_sessions(spark, d).select("ticker", "date_et", "sess_open", "sess_close", "sess_high", "sess_low", "sess_volume", "sess_n", "n_bins", "sess_ret", "sess_range", "sess_avg_trade_size", "sess_realized_vol"))


@query
def bin_pivot_wide(spark, d):
    return rounded(_sessions(spark, d).select("ticker", "date_et", *(f"{m}_{k:02d}" for m in ("ret", "volshare", "range") for k in range(13))))


@query
def market_context(spark, d):
    return rounded(intra.market_context(_sessions(spark, d), MARKET_USER).select("ticker", "date_et", "sess_ret", "mkt_sess_ret"))


@query
def gap_and_volume_ratio(spark, d):
    s = _sessions(spark, d)
    bars = s.select("ticker", "date_et", F.col("sess_close").alias("close"), F.col("sess_volume").alias("volume"))
    return rounded(intra.daily_context(s, bars).select("ticker", "date_et", "prev_close", "avg20_volume", "gap_ret", "sess_vol_ratio"))


@query
def training_rows(spark, d):
    return rounded(ml.training_rows(grain(spark, d), MARKET, min_yield=0.005).select("ticker", "ex_date", "div_yield", "days_decl_to_ex", "ex_month", "label", "capture_ret_abn"))


@query
def temporal_split_counts(spark, d):
    rows = ml.training_rows(grain(spark, d), MARKET)
    train, test = ml.temporal_split(rows, TRAIN_END)
    count = lambda df, n: df.agg(F.count("*").alias("n"), F.sum("label").alias("n_positive")).withColumn("part", F.lit(n))
    return count(train, "train").union(count(test, "test"))


@query
def pnl_selected_vs_all(spark, d):
    b = base(spark, d)
    return rounded(st.pnl(b).withColumn("part", F.lit("all")).union(st.pnl(b.filter("div_yield >= 0.02")).withColumn("part", F.lit("selected"))))


@query
def json_props_parse(spark, d):
    ev = fx.table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return ev.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("largest"))


@query
def top_liquid_events(spark, d):
    return rounded(base(spark, d).orderBy(F.desc("pre_avg_dollar_volume"), "event_id").limit(20).select("event_id", "pre_avg_dollar_volume"))


@query
def sic_division_rollup(spark, d):
    p = fx.table(spark, d, "part").withColumn("major", F.col("p_size").cast("int"))
    return p.groupBy(sic_division("major").alias("division")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands"))


@query
def hybrid_rollup(spark, d):
    """Large groups keep their name, others fall into their division's rest, tiny rests into OTHER."""
    p = fx.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("major")).withColumn("division", sic_division("major"))
    mean = F.avg("n").over(Window.partitionBy(F.lit(0)))
    sizes = p.groupBy("major", "division").agg(F.count("*").alias("n")).withColumn("mean", mean)
    named = sizes.select("n", F.when(F.col("n") >= F.col("mean"), F.col("major").cast("string")).otherwise(F.concat("division", F.lit(" (other)"))).alias("label"))
    per = named.groupBy("label").agg(F.sum("n").alias("n"))
    return per.groupBy(F.when(F.col("n") < 40, "OTHER").otherwise(F.col("label")).alias("label")).agg(F.sum("n").alias("n"))


@query
def dedupe_text(spark, d):
    return ref.dedupe_text(fx.table(spark, d, "documents").select("doc_id", "text", "source"), "text", "doc_id").select("doc_id", "source")


@query
def deterministic_sample(spark, d):
    return ref.deterministic_sample(fx.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], 3)


@query
def class_histogram(spark, d):
    h = fx.table(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    return rounded(h.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy(F.lit(0))))))


@query
def three_level_buckets(spark, d):
    g = grain(spark, d).select(three_levels("div_yield", 0.005, 0.01).alias("yield_level"), three_levels("pre_avg_dollar_volume", 1e6, 5e6).alias("size_level"), three_levels("pre_vol", 0.01, 0.02).alias("vol_level"))
    return g.groupBy("yield_level", "size_level", "vol_level").agg(F.count("*").alias("n"))


@query
def imputed_features(spark, d):
    df = grain(spark, d).select("event_id", "pre_vol", "pre_avg_dollar_volume", "declaration_lead_days").fillna({"pre_vol": 0.0, "pre_avg_dollar_volume": -1.0, "declaration_lead_days": 0})
    return rounded(df)


@query
def null_profile(spark, d):
    p = panel(spark, d)
    return p.agg(F.count("*").alias("n"), *(F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in ("close", "mkt_close", "ret_cc", "bar_date")))


@query
def checker_counts(spark, d):
    """Panel rows per event, duplicate keys, core events with bad prices."""
    p, g = panel(spark, d).agg(F.count("*").alias("n_panel")), grain(spark, d)
    bad = F.coalesce(F.sum(F.when(F.col("has_core") & ((F.col("prev_close") <= 0) | (F.col("ex_open") <= 0)), 1)), F.lit(0)).cast("long")
    return g.agg(F.count("*").alias("n_events"), F.count_distinct("ticker", "ex_date").alias("n_keys"), bad.alias("n_bad_prices")).join(F.broadcast(p))


# ------------------------------------------------------------------ streams


#: A replay's file, which is a micro-batch, holds so many rows; a long replay gets larger files instead of more than so many.
REPLAY_ROWS, REPLAY_FILES = 2000, 12
#: Rows a state partition, where the cores alone would make fewer partitions.
STATE_ROWS = 250_000


def _stream_files(spark, d, minutes: DataFrame, n: int) -> str:
    """Replay files in event-time order; written where the stream can find them."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-")
    path = f"{root.rstrip('/')}/replay-{uuid.uuid4().hex}"
    part = F.floor(F.dayofyear("ts_et") / 31).cast("int")
    rows = max(REPLAY_ROWS, -(-n // REPLAY_FILES))
    minutes.select("ticker", "ts_et", "price", "event_id", (F.year("ts_et") * 12 + part).alias("part")).repartition(1).sortWithinPartitions("ts_et").write.option("maxRecordsPerFile", rows).parquet(path)
    return path


def _start(spark, writer, n: int):
    """Starts a query whose state has about a partition a core; it takes a copy of the session's settings, so they change for the start only."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), max(spark.sparkContext.defaultParallelism, -(-n // STATE_ROWS)))))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def _run_stream(spark, d, candidates: bool) -> DataFrame:
    from tidewater.streaming import bars

    n = fx.minute_bars(spark, d).count()
    path = _stream_files(spark, d, fx.minute_bars(spark, d), n)
    source = spark.readStream.schema("ticker string, ts_et timestamp, price double, event_id long, part int").option("maxFilesPerTrigger", 1).parquet(path)
    keep = None
    if candidates:  # written once, as every micro-batch would find them anew
        fx.minute_bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n")).filter("n >= 10").select("ticker").write.parquet(f"{path}-candidates")
        keep = spark.read.parquet(f"{path}-candidates")
    out = f"{path}-bins"
    writer = bars.binned(source, keep, delay="400 days").writeStream.outputMode("update").foreachBatch(bars.upsert(out)).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    _start(spark, writer, n).awaitTermination()
    return bars.latest(spark.read.parquet(out))


@query
def stream_bins_equals_batch(spark, d):
    return rounded(_run_stream(spark, d, False))


@query
def stream_static_join(spark, d):
    return rounded(_run_stream(spark, d, True))


# ------------------------------------------------------------- rows-only ML

#: The reference's nine event features, and the month.  Without decision-day prices the yield is that of the close before.
NUMERIC = ("div_yield", "cash_amount", "frequency", "n_distributions", "pre_vol", "pre_avg_ret", "pre_avg_abn_ret", "pre_avg_dollar_volume", "days_decl_to_ex", "ex_month")
CATEGORICAL = ("sec_type", "sic_description")


def capture_rows(spark, d) -> DataFrame:
    """Training rows with the ticker's type and description, UNKNOWN where there is none; missing numbers are filled as the reference does."""
    meta = ref.prefer_active(fx.metadata(spark, d)).select(F.col("ticker").alias("__t"), F.col("type").alias("sec_type"), "sic_description")
    rows = ml.training_rows(grain(spark, d), MARKET)
    rows = rows.join(meta, F.col("ticker") == F.col("__t"), "left").fillna("UNKNOWN", list(CATEGORICAL))
    told = {"pre_vol": 0.0, "pre_avg_ret": 0.0, "pre_avg_abn_ret": 0.0, "days_decl_to_ex": -1, "n_distributions": 1, "frequency": 0}
    return rows.fillna(told).select("ticker", "ex_date", "capture_ret_abn", "label", *NUMERIC, *CATEGORICAL)


def _fit(spark, d, kind: str, **options):
    rows = capture_rows(spark, d).na.drop().cache()
    train, test = ml.temporal_split(rows, "1996-12-31")
    model = ml.capture_pipeline(kind, NUMERIC, CATEGORICAL, **options).fit(train)
    return model, model.transform(test)


@query
def capture_model_gbt(spark, d):
    return ml.evaluate(_fit(spark, d, "gbt")[1])


@query
def capture_model_logreg(spark, d):
    return ml.evaluate(_fit(spark, d, "lr")[1])


@query
def feature_importance(spark, d):
    model, scored = _fit(spark, d, "lr")
    return spark.createDataFrame(ml.named_importances(model, scored), "feature string, weight double")


def _text(spark, d) -> tuple[object, DataFrame]:
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("text").alias("description"), F.col("lang").alias("sector"))
    docs = ref.dedupe_text(docs, "description", "doc_id")
    train, test = docs.randomSplit([0.8, 0.2], seed=42)
    model = ml.text_pipeline().fit(train)
    return model, ml.with_predicted_label(model, model.transform(test))


@query
def text_sector_model(spark, d):
    return spark.createDataFrame([ml.text_metrics(_text(spark, d)[1])])


@query
def confusion_pairs(spark, d):
    return ml.confusion(_text(spark, d)[1], "sector", "pseudo_sector")
