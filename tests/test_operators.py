"""Small fixtures with known answers, and invariants."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions.core import bin_index, in_session, minute_of_day, ns_to_wall, three_levels, yield_bucket
from tidewater.operators import event_study as es
from tidewater.operators import intraday as intra
from tidewater.operators import learning as ml
from tidewater.operators import reference as ref
from tidewater.operators import statistics as st
from tidewater.plans import catalogue as cat
from tidewater.plans import cross_section as cs
from tidewater.sources import fixtures as fx
from tidewater.sources import readers, sinks

SF = "/root/testdata/sf0.01"


def test_wall_clock_time(spark):
    ns = int(dt.datetime(2024, 2, 8, 13, 50, tzinfo=dt.UTC).timestamp()) * 1_000_000_000
    row = spark.createDataFrame([(ns,)], "t long").select(ns_to_wall("t").alias("w")).select(minute_of_day("w").alias("m")).first()
    assert row.m == 8 * 60 + 50


def test_bins_and_session_edges(spark):
    df = spark.createDataFrame([(569,), (570,), (599,), (600,), (930,), (944,), (945,)], "m int")
    got = [(r.m, r.b) for r in df.filter(in_session("m")).select("m", bin_index("m").alias("b")).collect()]
    assert got == [(570, 0), (599, 0), (600, 1), (930, 12), (944, 12)]


def test_null_levels_fall_into_the_last_one(spark):
    r = spark.createDataFrame([(None,)], "y double").select(three_levels("y", 0.1, 0.2).alias("l"), yield_bucket("y").alias("b")).first()
    assert (r.l, r.b) == ("high", None)


ROWS = [("A", -0.01, 0.01, 0.5), ("A", 0.01, None, 1.5), ("B", None, 0.03, None)]
DDL = "ticker string, capture_ret_abn double, capture_ret double, drop_ratio double"


def test_group_summary(spark):
    r = st.group_summary(spark.createDataFrame(ROWS, DDL), None, 1, 1).first()
    assert (r.n_events, r.n_tickers, r.n_capture_ret_abn, r.n_capture_ret, r.n_drop_ratio) == (3, 2, 2, 2, 2)
    assert r.mean_capture_ret_abn == pytest.approx(0) and r.stddev_capture_ret_abn == pytest.approx(math.sqrt(0.0002))
    assert r.se_capture_ret_abn == pytest.approx(0.01) and r.ci95_high_capture_ret_abn == pytest.approx(0.0196)
    assert r.positive_capture_ret_abn_rate == 0.5 and r.drop_ratio_lt_1_rate == 0.5 and r.report_eligible_flag


def test_one_row_has_no_interval(spark):
    r = st.group_summary(spark.createDataFrame(ROWS[:1], DDL), None, 2, 1).first()
    assert r.stddev_capture_ret_abn is None and r.se_capture_ret_abn is None and r.ci95_low_capture_ret_abn is None and not r.report_eligible_flag


def test_cut_points():
    assert st.distinct_cuts([0.1, 0.1, 0.2, 0.3], 0.3) == [0.1, 0.2]
    assert st.distinct_cuts([0.0, 0.0, 1.0, 1.0], 1.0) == [0.0]


def test_quantile_buckets_cover_every_value(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(100)], "v double")
    got = st.quantile_bucket(df, "v", "b", 5)
    assert got.filter("b IS NULL").isEmpty() and got.count() == 100
    edges = got.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(edges, edges[1:]))


def test_quantile_buckets_of_values_that_differ_each_time_they_are_made(spark):
    import time

    later = F.udf(lambda i: i + time.monotonic() / 1e4, "double").asNondeterministic()
    df = spark.range(100).select("id", later(F.col("id").cast("double")).alias("v"))
    got = st.quantile_bucket(df, "v", "b", 5).groupBy("b").agg(F.count("*").alias("n"), F.max("id").alias("hi"))
    assert sorted(map(tuple, got.collect())) == [(f"Q{k + 1:02d}", 20, 20 * k + 19) for k in range(5)]


@pytest.mark.parametrize("name,bucket", [("bucket_boundaries", "bucket_label"), ("group_summary_yield_q5", "bucket")])
def test_bucket_queries_count_alike_when_values_differ_in_each_pass(spark, monkeypatch, name, bucket):
    import time

    later = F.udf(lambda i: i + time.monotonic() / 1e4, "double").asNondeterministic()
    value = lambda c: F.lit(0.5).alias(c)
    df = spark.range(100).select(F.lit("A").alias("ticker"), later(F.col("id").cast("double")).alias("div_yield"), *map(value, ("capture_ret_abn", "capture_ret", "drop_ratio")))
    monkeypatch.setattr(cat, "base", lambda spark, d: df)
    got = cat.CATALOGUE[name](spark, SF).select(bucket, "n_events").collect()
    assert sorted(map(tuple, got)) == [(f"Q{k + 1:02d}", 20) for k in range(5)]


@pytest.mark.parametrize("name,bucket", [("bucket_boundaries", "bucket_label"), ("group_summary_yield_q5", "bucket")])
def test_bucket_queries_keep_equal_yields_together_in_any_order_of_their_amounts(spark, monkeypatch, name, bucket):
    before, day = dt.date(2020, 1, 2), dt.date(2020, 1, 3)
    amounts = [[0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [0.3, 0.2, 0.1], [0.3, 0.2, 0.1], [1.0], [2.0], [3.0], [4.0], [5.0]]
    paid = [(f"T{k}", day, a, "CD", 4, before) for k, of in enumerate(amounts) for a in of]
    dividends = spark.createDataFrame(paid, "ticker string, ex_date date, cash_amount double, distribution_type string, frequency long, declaration_date date").coalesce(1)
    prices = [(t, d, *[1.0] * 5, 1) for t in (*(f"T{k}" for k in range(10)), cat.MARKET) for d in (before, day)]
    bars = spark.createDataFrame(prices, "ticker string, date_et date, open double, close double, high double, low double, volume double, transactions long")
    monkeypatch.setattr(fx, "dividends", lambda spark, d: dividends)
    monkeypatch.setattr(fx, "day_bars", lambda spark, d: bars)
    got = cat.CATALOGUE[name](spark, SF).select(bucket, "n_events").collect()
    assert sorted(map(tuple, got)) == [("Q01", 5), ("Q02", 1), ("Q03", 2), ("Q04", 2)]


def test_quantile_buckets_without_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert [r.b for r in st.quantile_bucket(df, "v", "b", 5).collect()] == [None]
    assert st.quantile_bucket(df.limit(0), "v", "b", 5).isEmpty()
    with pytest.raises(ValueError, match="no usable v"):
        st.quantile_bucket(df, "v", "b", 5, required=True)


@pytest.mark.parametrize("means,steps,sign", [([1, 2, 3], 2, 1), ([3, 2, 1], 0, -1), ([2, 2, 2], 2, 0), ([1, 3, 2], 1, 1)])
def test_shapes(spark, means, steps, sign):
    df = spark.createDataFrame([(f"Q{i:02d}", m / 1e4, m / 1e4, 0.5) for i, m in enumerate(means)], "bucket string, mean_capture_ret_abn double, median_capture_ret_abn double, positive_capture_ret_abn_rate double")
    r = st.dimension_diagnostics(df, "bucket", "x").first()
    assert r.monotonic_step_count == steps and math.copysign(1, r.high_minus_low_bps or 0.0) == (sign or 1)
    assert (r.spearman_bucket_mean > 0) == (sign > 0) or sign == 0 and r.spearman_bucket_mean == 0


def test_identities(spark):
    cols = "drop_pct double, drop_ratio double, div_yield double, capture_ret double, mkt_overnight_ret double, capture_ret_abn double, stock_overnight_ret double, abn_overnight_ret double"
    good = (0.008, 0.8, 0.01, 0.002, 0.0005, 0.0015, -0.008, -0.0085)
    bad = (0.009, *good[1:])
    assert all(r.n_violations == 0 and r.max_abs_error < 1e-15 for r in st.metric_identities(spark.createDataFrame([good], cols)).collect())
    assert st.metric_identities(spark.createDataFrame([bad], cols)).filter("n_violations > 0").count() >= 2
    assert st.metric_identities(spark.createDataFrame([tuple([None] * 8)], cols)).filter("n_eligible > 0").isEmpty()


def test_sector_states(spark):
    base = spark.createDataFrame([("AAA", "BANKS"), ("BBB", "UNKNOWN"), ("CCC", "UNKNOWN"), ("CpK", "UNKNOWN")], "ticker string, sic_description string")
    source = spark.createDataFrame([("AAA", "X", "hybrid"), (" BBB ", "Y", "hybrid"), ("CPK", "Z", "hybrid"), ("CCC", "Z", "major")], "ticker string, pseudo_sector string, label_level string")
    got = {r.ticker: r.sector_state for r in ref.sector_states(base, ref.pseudo_lookup(source, "hybrid")).collect()}
    assert got == {"AAA": "direct_sic_known", "BBB": "pseudo_recovered", "CCC": "still_unresolved", "CpK": "still_unresolved"}


def test_pseudo_source_contract(spark):
    ddl = "ticker string, pseudo_sector string, label_level string"
    with pytest.raises(ref.ContractError, match="conflicting"):
        ref.pseudo_lookup(spark.createDataFrame([("A", "X", "h"), ("A", "Y", "h")], ddl), "h")
    with pytest.raises(ref.ContractError, match="level"):
        ref.pseudo_lookup(spark.createDataFrame([("A", "X", "h")], ddl), "major")
    with pytest.raises(ref.ContractError, match="lacks"):
        ref.pseudo_lookup(spark.createDataFrame([("A",)], "ticker string"), "h")


def test_asof_keeps_events_without_candidates(spark):
    ev = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("B", dt.date(2020, 1, 1))], "ticker string, ex_date date")
    meta = spark.createDataFrame([("A", dt.date(2019, 1, 1), "old", False), ("B", None, "now", True), ("B", dt.date(2021, 1, 1), "then", False)], "ticker string, delisted_date date, sic_description string, active boolean")
    assert {r.ticker: r.sic_description for r in ref.asof_metadata(ev, meta).collect()} == {"A": None, "B": "then"}


def test_panel_has_nine_rows_per_event_and_unique_keys(spark):
    p = cat.panel(spark, SF)
    n = cat.events(spark, SF).count()
    assert p.count() == 9 * n and p.select("ticker", "ex_date", "offset").distinct().count() == 9 * n
    assert st.metric_identities(cat.grain(spark, SF)).filter("n_violations > 0").isEmpty()


def test_result_does_not_depend_on_partitioning(spark):
    bars, ev = fx.day_bars(spark, "/root/testdata/sf0.001"), cat.events(spark, "/root/testdata/sf0.001")
    a = es.event_grain(es.event_panel(ev, bars, fx.MARKET)).select("ticker", "ex_date", "prev_close", "n_bars")
    b = es.event_grain(es.event_panel(ev.repartition(7), bars.repartition(3), fx.MARKET)).select("ticker", "ex_date", "prev_close", "n_bars")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_preflight_writes_nothing_and_final_only_once(spark, tmp_path):
    g, p, meta, pseudo = (f(spark, SF) for f in (cat.grain, cat.panel, fx.metadata, fx.pseudo_sectors))
    g, p = g.cache(), p.cache()
    config = cs.RunConfig("run-1", str(tmp_path), fx.MARKET, min_cell_n=5, min_report_tickers=1)
    tables = cs.run(spark, "preflight", config, g, p, meta, pseudo)
    assert not list(tmp_path.iterdir()) and tables["handoff_parity"].isEmpty() and tables["duplicate_keys"].isEmpty()
    assert tables["overall_summary"].first().n_events == tables["sector_bridge"].agg(F.sum("n_events")).first()[0]
    few = {k: tables[k] for k in ("overall_summary", "yield_summary")}
    for name, df in few.items():
        sinks.write_once(df, f"{tmp_path}/{name}")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(few["overall_summary"], f"{tmp_path}/overall_summary")
    found = cs.insights(tables, config)
    assert {f["section"] for f in found} >= {"yield", "volatility", "liquidity"} and json.dumps(found, default=str)


def test_run_refuses_bad_input(spark):
    g, p = cat.grain(spark, "/root/testdata/sf0.001"), cat.panel(spark, "/root/testdata/sf0.001")
    config = cs.RunConfig("run-1", "/nowhere", fx.MARKET)
    assert cs.audit(g.drop("pre_vol"), p, config) == ["grain lacks pre_vol"]
    assert any("panel" in i for i in cs.audit(g, p.filter("offset < 3"), config))
    with pytest.raises(cs.RunError):
        cs.RunConfig("x y", "/nowhere", "M").check()


def test_leaks():
    assert ml.leaks(["div_yield", "capture_ret", "final_sector", "yield_bucket"]) == ["capture_ret", "final_sector", "yield_bucket"]
    with pytest.raises(ValueError):
        ml.feature_stages(["drop_pct"], [])


def test_readers_and_sinks(spark, tmp_path):
    bars = tmp_path / "day_2024-02"
    bars.mkdir()
    (bars / "a.csv").write_text("a,b,c,d,e,f,g,h\nAbC,1.5,10,11,12,9,1707400200000000000,7\n")
    row = readers.read_bars(spark, str(bars)).first()
    assert (row.ticker, row.volume, row.close, str(row.date_et)) == ("AbC", 1.5, 11.0, "2024-02-08")
    assert readers.discover_months(spark, str(tmp_path)) == ["2024-02"]
    assert readers.read_minute_bars(spark, str(bars)).first().min_of_day == 8 * 60 + 50
    (tmp_path / "d.jsonl").write_text('{"ticker":"A","ex_dividend_date":"2024-01-05","cash_amount":0.5}\n{"ticker":"A","ex_dividend_date":"bad","cash_amount":1.0}\n')
    assert [str(r.ex_date) for r in readers.read_dividends(spark, str(tmp_path / "d.jsonl")).collect()] == ["2024-01-05", "None"]
    with pytest.raises(readers.MissingSource, match="grain"):
        readers.read_required_parquet(spark, str(tmp_path / "none"), "grain")
    assert readers.is_csv_path("/a/b/events.csv") and not readers.is_csv_path("/csv/b")
    df = spark.createDataFrame([(2, [1]), (1, [2])], "k int, a array<int>")
    sinks.write_single_csv(df, str(tmp_path / "out"), ["k"])
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "k\n1\n2\n"


def test_intraday_shares_add_up(spark):
    s = intra.session_features(intra.bins(fx.minute_bars(spark, SF)))
    total = sum((F.coalesce(f"volshare_{k:02d}", F.lit(0.0)) for k in range(13)), F.lit(0.0))
    assert s.filter(F.abs(total - 1) > 1e-9).filter("sess_volume > 0").isEmpty()


def test_decisions_fire_once_per_day(spark, tmp_path):
    from tidewater.streaming.bars import decisions

    src = tmp_path / "in"
    src.mkdir()
    times = [dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=20 * k) for k in range(19)]
    first = [("A", t, 10.0 + k) for k, t in enumerate(times)]
    later = [("A", dt.datetime(2024, 1, 3, 9, 31), 1.0), ("B", dt.datetime(2024, 1, 4, 10, 0), 1.0)]
    for k, rows in enumerate((first, later[:1], later[1:])):
        spark.createDataFrame(rows, "ticker string, ts_et timestamp, price double").coalesce(1).write.parquet(f"{tmp_path}/stage{k}")
        (part,) = (tmp_path / f"stage{k}").glob("part-*")
        part.rename(src / f"{k}.parquet")
    stream = spark.readStream.schema("ticker string, ts_et timestamp, price double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = decisions(stream).writeStream.format("memory").queryName("signals").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("signals").filter("ticker = 'A' AND official").collect()
    assert [(str(r.day), r.n_bins, r.sess_open, r.sess_close) for r in got if str(r.day) == "2024-01-02"] == [("2024-01-02", 13, 10.0, 28.0)]


@pytest.mark.parametrize("name", ["stream_bins_equals_batch", "stream_static_join"])
def test_a_long_replay_takes_few_batches_and_loses_no_row(spark, tmp_path, monkeypatch, name):
    from tidewater.streaming import bars

    n, batches, upsert, before = 30_000, [], bars.upsert, spark.conf.get("spark.sql.shuffle.partitions")
    at = F.timestamp_seconds(F.lit(1_704_189_600) + F.col("id") % 1000 * 86_400 + F.col("id") % 7 * 900).cast("timestamp_ntz")
    events = spark.range(n).select(F.col("id").alias("event_id"), at.alias("ts"), F.pmod(F.hash("id"), F.lit(5000)).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 97).cast("double").alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(bars, "upsert", lambda path: lambda df, k: (batches.append(k), upsert(path)(df, k))[1])
    got = cat.CATALOGUE[name](spark, str(tmp_path)).agg(F.count("*").alias("bins"), F.sum("b_n").alias("rows"), F.sum("b_volume").alias("total")).first()
    rows = fx.minute_bars(spark, str(tmp_path))
    if name == "stream_static_join":
        rows = rows.join(rows.groupBy("ticker").count().filter("count >= 10"), "ticker", "left_semi")
    want = intra.bins(rows).agg(F.count("*").alias("bins"), F.sum("b_n").alias("rows"), F.sum("b_volume").alias("total")).first()
    assert got == want and len(set(batches)) <= 13  # twelve files, and the last batch without rows
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_registered_models_are_trained_in_full(spark, monkeypatch):
    seen = []

    def told(*args, **options):
        seen.append((args, options))
        raise InterruptedError

    monkeypatch.setattr(ml, "capture_pipeline", told)
    monkeypatch.setattr(ml, "text_pipeline", told)
    for name in ("capture_model_gbt", "text_sector_model", "confusion_pairs"):
        with pytest.raises(InterruptedError):
            cat.CATALOGUE[name](spark, SF)
    (kind, numeric, categorical), options = seen[0]
    assert kind == "gbt" and not options and seen[1:] == [((), {})] * 2
    event = {"div_yield", "cash_amount", "frequency", "n_distributions", "pre_vol", "pre_avg_ret", "pre_avg_abn_ret", "pre_avg_dollar_volume", "days_decl_to_ex"}
    assert event <= set(numeric) and set(categorical) == {"sec_type", "sic_description"}
    assert {*numeric, *categorical} <= set(cat.capture_rows(spark, SF).columns)
