"""The catalogue's queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

import re

ORDER = "row(l_orderkey, l_linenumber, l_partkey, l_suppkey, px)"
BAR = f"min({ORDER})[5] AS open, max({ORDER})[5] AS close, max(px) AS high, min(px) AS low, sum(l_quantity) AS volume, count(*) AS transactions"

#: Common table expressions by name, in order of use.
CTES = {
    "trades": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date_et, l_extendedprice / nullif(l_quantity, 0) AS px, l_quantity, l_discount,
        l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars": f"""SELECT ticker, date_et, {BAR} FROM trades GROUP BY ticker, date_et UNION ALL SELECT 'MKT', date_et, {BAR} FROM trades GROUP BY date_et""",
    "cal": "SELECT date_et, CAST(row_number() OVER (ORDER BY date_et) - 1 AS INTEGER) AS day_idx FROM (SELECT DISTINCT date_et FROM bars)",
    "ev": """SELECT ticker, ex_date, sum(cash) AS cash_amount, count(*) AS n_distributions, min(frequency) AS frequency, min(decl) AS declaration_date,
        array_to_string(list_sort(list_distinct(list(distribution_type))), ',') AS distribution_types
        FROM (SELECT ticker, date_et AS ex_date, px * l_discount AS cash, l_linestatus AS distribution_type, CAST(l_linenumber AS BIGINT) AS frequency, CAST(o_orderdate AS DATE) AS decl
              FROM trades LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 40) WHERE cash > 0 AND ex_date IS NOT NULL GROUP BY ticker, ex_date""",
    "fan": "SELECT ev.*, c.day_idx, o.o AS offset_ FROM ev JOIN cal c ON ev.ex_date = c.date_et CROSS JOIN (SELECT CAST(unnest(range(-5, 4)) AS INTEGER) AS o) o",
    "panel0": """SELECT f.ticker, f.ex_date, f.cash_amount, f.n_distributions, f.frequency, f.declaration_date, f.offset_, c.date_et AS bar_date, b.open, b.close, b.high, b.low, b.volume, b.transactions,
        m.open AS mkt_open, m.close AS mkt_close, CAST(abs(c.date_et - f.ex_date) AS INTEGER) AS span_days, b.close * b.volume AS dollar_volume, strftime(f.ex_date, '%Y-%m') AS ex_ym
        FROM fan f LEFT JOIN cal c ON c.day_idx = f.day_idx + f.offset_ LEFT JOIN bars b ON b.ticker = f.ticker AND b.date_et = c.date_et LEFT JOIN bars m ON m.ticker = 'MKT' AND m.date_et = c.date_et""",
    "panel1": "SELECT *, lag(close) OVER w AS prev_bar_close, lag(mkt_close) OVER w AS prev_mkt_close FROM panel0 WINDOW w AS (PARTITION BY ticker, ex_date ORDER BY offset_)",
    "panel": "SELECT *, close / nullif(prev_bar_close, 0) - 1 AS ret_cc, mkt_close / nullif(prev_mkt_close, 0) - 1 AS mkt_ret_cc, (close / nullif(prev_bar_close, 0) - 1) - (mkt_close / nullif(prev_mkt_close, 0) - 1) AS abn_ret_cc FROM panel1",
    "grain0": """SELECT ticker, ex_date, any_value(cash_amount) AS cash_amount, any_value(n_distributions) AS n_distributions, any_value(frequency) AS frequency, any_value(declaration_date) AS declaration_date,
        max(close) FILTER (offset_ = -1) AS prev_close, max(open) FILTER (offset_ = 0) AS ex_open, max(close) FILTER (offset_ = 0) AS ex_close, max(close) FILTER (offset_ = 3) AS post_close,
        avg(ret_cc) FILTER (offset_ BETWEEN -4 AND -1) AS pre_avg_ret, avg(abn_ret_cc) FILTER (offset_ BETWEEN -4 AND -1) AS pre_avg_abn_ret, stddev_samp(ret_cc) FILTER (offset_ BETWEEN -4 AND -1) AS pre_vol,
        avg(volume) FILTER (offset_ BETWEEN -5 AND -1) AS pre_avg_volume, avg(dollar_volume) FILTER (offset_ BETWEEN -5 AND -1) AS pre_avg_dollar_volume,
        avg(ret_cc) FILTER (offset_ BETWEEN 1 AND 3) AS post_avg_ret, avg(abn_ret_cc) FILTER (offset_ BETWEEN 1 AND 3) AS post_avg_abn_ret,
        max(mkt_close) FILTER (offset_ = -1) AS mkt_prev_close, max(mkt_open) FILTER (offset_ = 0) AS mkt_ex_open,
        count(close) AS n_bars, count(close) FILTER (offset_ < 0) AS n_bars_pre, count(close) FILTER (offset_ > 0) AS n_bars_post, max(span_days) AS max_span_days FROM panel GROUP BY ticker, ex_date""",
    "grain1": """SELECT *, (prev_close - ex_open) / nullif(cash_amount, 0) AS drop_ratio, (prev_close - ex_open) / nullif(prev_close, 0) AS drop_pct, cash_amount / nullif(prev_close, 0) AS div_yield,
        (ex_open - prev_close + cash_amount) / nullif(prev_close, 0) AS capture_ret, (mkt_ex_open - mkt_prev_close) / nullif(mkt_prev_close, 0) AS mkt_overnight_ret,
        (post_close - prev_close + cash_amount) / nullif(prev_close, 0) AS hold_ret, prev_close IS NOT NULL AND ex_open IS NOT NULL AS has_core,
        n_bars_pre = 5 AND n_bars_post = 3 AS window_complete, max_span_days <= 30 AS window_contiguous, ex_open / nullif(prev_close, 0) - 1 AS stock_overnight_ret FROM grain0""",
    "grain": """SELECT *, capture_ret - mkt_overnight_ret AS capture_ret_abn, abs(drop_ratio) > 20 AS drop_ratio_extreme, div_yield < 0.005 AS low_yield, stock_overnight_ret - mkt_overnight_ret AS abn_overnight_ret,
        ticker || '|' || strftime(ex_date, '%Y-%m-%d') AS event_id, CAST(month(ex_date) AS INTEGER) AS event_month, CAST(ex_date - declaration_date AS INTEGER) AS declaration_lead_days FROM grain1""",
    "base": "SELECT * FROM grain WHERE cash_amount > 0 AND has_core AND window_contiguous AND ticker <> 'MKT'",
    "brands": "SELECT p_brand AS ticker, max(p_type) AS top, min(p_type) AS low FROM part GROUP BY p_brand",
    "meta": """SELECT ticker, true AS active, DATE '1995-01-01' AS list_date, CAST(NULL AS DATE) AS delisted_date, CASE WHEN CAST(right(ticker, 1) AS INTEGER) % 2 = 1 THEN top END AS sic_description,
        CASE WHEN ticker <> 'Brand#15' THEN top END AS description FROM brands UNION ALL
        SELECT ticker, false, DATE '1990-01-01', DATE '1994-06-30', CASE WHEN ticker = 'Brand#13' THEN low END, low FROM brands WHERE ticker IN ('Brand#11', 'Brand#12', 'Brand#13')""",
    "preferred": "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active DESC, list_date DESC) AS n FROM meta) WHERE n = 1",
    "sic": "SELECT ticker AS st, max(sic_description) AS sic, min(list_date) AS ld FROM meta GROUP BY ticker HAVING count(DISTINCT sic_description) = 1",
    "enriched": "SELECT g.*, CASE WHEN sic IS NOT NULL AND NOT coalesce(ex_date < ld, false) THEN sic ELSE 'UNKNOWN' END AS sic_description FROM grain g LEFT JOIN sic ON g.ticker = st",
    "states": """SELECT e.*, pseudo_sector, CASE WHEN sic_description <> 'UNKNOWN' THEN 'direct_sic_known' WHEN pseudo_sector IS NOT NULL THEN 'pseudo_recovered' ELSE 'still_unresolved' END AS sector_state,
        CASE WHEN sic_description <> 'UNKNOWN' THEN 'direct_sic_current_reference' WHEN pseudo_sector IS NOT NULL THEN 'model_predicted_pseudo_sector' ELSE 'unresolved' END AS sector_source
        FROM enriched e LEFT JOIN (SELECT ticker AS pt, low AS pseudo_sector FROM brands WHERE right(ticker, 1) IN ('2', '4')) ON e.ticker = pt""",
    "sbase": "SELECT * FROM states WHERE cash_amount > 0 AND has_core AND window_contiguous AND ticker <> 'MKT'",
    "minutes": """SELECT CAST(user_id AS VARCHAR) AS ticker, ts, CAST(ts AS DATE) AS date_et, hour(ts) * 60 + minute(ts) AS m, value AS price, event_id FROM events WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 945""",
    "bins": """SELECT ticker, date_et, CAST(least((m - 570) // 30, 12) AS INTEGER) AS bin, min(row(ts, event_id, price))[3] AS b_open, max(row(ts, event_id, price))[3] AS b_close, max(price) AS b_high, min(price) AS b_low, sum(price) AS b_volume, count(*) AS b_n FROM minutes GROUP BY ALL""",
    "ret": "SELECT *, CASE WHEN b_open > 0 THEN b_close / nullif(b_open, 0) - 1 END AS r, CASE WHEN b_close > 0 THEN (b_high - b_low) / nullif(b_close, 0) ELSE 0.0 END AS g FROM bins",
    "sess": """SELECT ticker, date_et, min(row(bin, b_open))[2] AS sess_open, max(row(bin, b_close))[2] AS sess_close, max(b_high) AS sess_high, min(b_low) AS sess_low, sum(b_volume) AS sess_volume, CAST(sum(b_n) AS BIGINT) AS sess_n, count(*) AS n_bins, stddev_samp(r) AS sess_realized_vol FROM ret GROUP BY ticker, date_et""",
}


def _uses(sql: str, found: list[str], within: tuple[str, ...] = ()) -> None:
    """Adds the expressions that the SQL names, those that they need first."""
    for word in re.findall(r"\b\w+\b", sql):
        if word in CTES and word not in found and word not in within:
            _uses(CTES[word], found, (*within, word))
            found.append(word)


def q(sql: str) -> str:
    found: list[str] = []
    _uses(sql, found)
    heads = ", ".join(f"{n} AS ({CTES[n]})" for n in found)
    return f"WITH {heads} {sql}" if heads else sql


PRICES = {"open", "close", "high", "low", "mkt_open", "mkt_close", "prev_close", "ex_open", "ex_close", "post_close", "prev_bar_close", "prev_mkt_close", "close_m1", "open_0", "close_p3", "cash_amount"}


def r(names: str, digits: int = 6) -> str:
    """Rounded columns: 'name' or 'expression AS name', separated by semicolons."""
    out = []
    for part in names.split(";"):
        expr, _, name = part.strip().rpartition(" AS ")
        out.append(f"round({expr or name}, {3 if 'avg_dollar_volume' in name else 8 if name == 'dollar_volume' else 10 if name in PRICES else digits}) + 0.0 AS {name}")
    return ", ".join(out)


def summary(source: str, group: str | None, min_n: int = 30, min_t: int = 5) -> str:
    med = lambda c: f"quantile_disc({c}, 0.5) AS median_{c}"
    quart = lambda c: f"{med(c)}, quantile_disc({c}, 0.25) AS p25_{c}, quantile_disc({c}, 0.75) AS p75_{c}"
    a = "capture_ret_abn"
    inner = f"""SELECT {group + "," if group else ""} count(*) AS n_events, count(DISTINCT ticker) AS n_tickers, count({a}) AS n_{a}, count(capture_ret) AS n_capture_ret, count(drop_ratio) AS n_drop_ratio,
        avg({a}) AS mean_{a}, stddev_samp({a}) AS stddev_{a}, {quart(a)}, avg(CASE WHEN {a} > 0 THEN 1.0 WHEN {a} IS NOT NULL THEN 0.0 END) AS positive_{a}_rate,
        avg(capture_ret) AS mean_capture_ret, {med("capture_ret")}, avg(drop_ratio) AS mean_drop_ratio, {quart("drop_ratio")}, avg(CASE WHEN drop_ratio < 1 THEN 1.0 WHEN drop_ratio IS NOT NULL THEN 0.0 END) AS drop_ratio_lt_1_rate
        FROM {source} {"GROUP BY " + group if group else ""}"""
    return f"""SELECT s.*, n_events / nullif(te, 0) AS event_share, n_tickers / nullif(tt, 0) AS ticker_share, CASE WHEN n_{a} > 1 THEN stddev_{a} / sqrt(n_{a}) END AS se_{a},
        mean_{a} - 1.96 * CASE WHEN n_{a} > 1 THEN stddev_{a} / sqrt(n_{a}) END AS ci95_low_{a}, mean_{a} + 1.96 * CASE WHEN n_{a} > 1 THEN stddev_{a} / sqrt(n_{a}) END AS ci95_high_{a},
        n_events < {min_n} AS low_n_flag, n_tickers < {min_t} AS low_ticker_flag, NOT (n_events < {min_n} OR n_tickers < {min_t}) AS report_eligible_flag
        FROM ({inner}) s, (SELECT count(*) AS te, count(DISTINCT ticker) AS tt FROM {source})"""


SUMMARY_COUNTS = "n_events, n_tickers, n_capture_ret_abn, n_capture_ret, n_drop_ratio, low_n_flag, low_ticker_flag, report_eligible_flag"
SUMMARY_DOUBLES = r("mean_capture_ret_abn; stddev_capture_ret_abn; median_capture_ret_abn; p25_capture_ret_abn; p75_capture_ret_abn; positive_capture_ret_abn_rate; mean_capture_ret; median_capture_ret; mean_drop_ratio; median_drop_ratio; p25_drop_ratio; p75_drop_ratio; drop_ratio_lt_1_rate; event_share; ticker_share; se_capture_ret_abn; ci95_low_capture_ret_abn; ci95_high_capture_ret_abn")


def shown(source: str, group: str | None) -> str:
    return f"SELECT {group + ', ' if group else ''} {SUMMARY_COUNTS}, {SUMMARY_DOUBLES} FROM ({summary(source, group)})"


def bucketed(value: str) -> str:
    cuts = f"(SELECT list_sort(list_distinct(list_filter(quantile_disc({value}, [0.2, 0.4, 0.6, 0.8]), lambda x: x < mx))) AS cuts FROM (SELECT *, max({value}) OVER () AS mx FROM base WHERE {value} IS NOT NULL) GROUP BY mx)"
    return f"(SELECT b.*, 'Q' || lpad(CAST(1 + len(list_filter(cuts, lambda x: {value} > x)) AS VARCHAR), 2, '0') AS bucket FROM base b, {cuts} WHERE {value} IS NOT NULL)"


PNL = f"count(capture_ret_abn) AS n, {r('avg(capture_ret_abn) * 10000 AS mean_bps; quantile_disc(capture_ret_abn, 0.5) * 10000 AS median_bps; avg(CASE WHEN capture_ret_abn > 0 THEN 1.0 WHEN capture_ret_abn IS NOT NULL THEN 0.0 END) AS win_rate')}"
GRAIN_D = "cash_amount; prev_close; ex_open; ex_close; post_close; pre_avg_ret; pre_avg_abn_ret; pre_vol; pre_avg_volume; pre_avg_dollar_volume; post_avg_ret; post_avg_abn_ret; drop_ratio; drop_pct; div_yield; capture_ret; mkt_overnight_ret; capture_ret_abn; hold_ret"
DIVISION = """CASE WHEN p_size BETWEEN 1 AND 9 THEN 'Agriculture, Forestry & Fishing' WHEN p_size BETWEEN 10 AND 14 THEN 'Mining' WHEN p_size BETWEEN 15 AND 17 THEN 'Construction' WHEN p_size BETWEEN 20 AND 39 THEN 'Manufacturing'
    WHEN p_size BETWEEN 40 AND 49 THEN 'Transportation & Public Utilities' WHEN p_size BETWEEN 50 AND 51 THEN 'Wholesale Trade' WHEN p_size BETWEEN 52 AND 59 THEN 'Retail Trade' WHEN p_size BETWEEN 60 AND 67 THEN 'Finance, Insurance & Real Estate'
    WHEN p_size BETWEEN 70 AND 89 THEN 'Services' WHEN p_size BETWEEN 91 AND 99 THEN 'Public Administration' ELSE 'UNKNOWN' END"""  # fmt: skip
LEVELS = lambda c, a, b: f"CASE WHEN {c} < {a} THEN 'low' WHEN {c} < {b} THEN 'medium' ELSE 'high' END"
IDENT = {
    "drop_pct_is_ratio_times_yield": ("drop_pct", "drop_ratio * div_yield"),
    "capture_is_yield_less_drop": ("capture_ret", "(div_yield - drop_pct)"),
    "abnormal_is_capture_less_market": ("capture_ret_abn", "(capture_ret - mkt_overnight_ret)"),
    "overnight_is_minus_drop": ("stock_overnight_ret", "(-drop_pct)"),
    "abnormal_overnight_is_overnight_less_market": ("abn_overnight_ret", "(stock_overnight_ret - mkt_overnight_ret)"),
}
BASE_COND = "cash_amount > 0 AND has_core AND window_contiguous AND ticker <> 'MKT'"
STAGES = [
    ("raw", "true", "raw", "sequential_filter"), ("cash_positive", "cash_amount > 0", "raw", "sequential_filter"), ("has_core", "cash_amount > 0 AND has_core", "cash_positive", "sequential_filter"),
    ("window_contiguous", "cash_amount > 0 AND has_core AND window_contiguous", "has_core", "sequential_filter"), ("benchmark_excluded", BASE_COND, "window_contiguous", "sequential_filter"),
    *((n, f"{BASE_COND} AND {c}", "benchmark_excluded", "analysis_population") for n, c in (
        ("yield_usable", "div_yield IS NOT NULL"), ("volatility_usable", "pre_vol IS NOT NULL"), ("liquidity_usable", "pre_avg_dollar_volume IS NOT NULL"), ("sic_known", "sic_description <> 'UNKNOWN'"),
        ("sic_unknown", "sic_description = 'UNKNOWN'"), ("full_event_time_window", "n_bars = 9"), ("pseudo_recovered", "sector_state = 'pseudo_recovered'"), ("still_unresolved", "sector_state = 'still_unresolved'"))),
]
FUNNEL = " UNION ALL ".join(
    f"SELECT {k + 1} AS stage_order, '{n}' AS stage, '{t}' AS stage_type, count(*) FILTER ({c}) AS n_events, count(*) FILTER ({dict((x[0], x[1]) for x in STAGES)[p]}) AS prior_n_events, "
    f"round(count(*) FILTER ({c}) / nullif(count(*) FILTER ({dict((x[0], x[1]) for x in STAGES)[p]}), 0), 6) AS retention, round(count(*) FILTER ({c}) / nullif(count(*), 0), 6) AS cumulative_retention FROM states"
    for k, (n, c, p, t) in enumerate(STAGES)
)
PIVOT = ", ".join(
    f"round(max(r) FILTER (bin = {k}), 6) + 0.0 AS ret_{k:02d}, round(CASE WHEN max(b_volume) FILTER (bin = {k}) IS NOT NULL THEN coalesce(max(b_volume) FILTER (bin = {k}) / nullif(sum(b_volume), 0), 0.0) END, 6) + 0.0 AS volshare_{k:02d}, round(max(g) FILTER (bin = {k}), 6) + 0.0 AS range_{k:02d}"
    for k in range(13)
)
OVERNIGHT = ", ".join(f"count({c}) AS n_{c}, " + r(f"avg({c}) AS mean_{c}; stddev_samp({c}) AS stddev_{c}; quantile_disc({c}, 0.5) AS median_{c}; quantile_disc({c}, 0.25) AS p25_{c}; quantile_disc({c}, 0.75) AS p75_{c}") for c in ("stock_overnight_ret", "abn_overnight_ret", "capture_ret"))
YIELD = "CASE WHEN div_yield < 0.0025 THEN '1: <0.25%' WHEN div_yield < 0.005 THEN '2: <0.5%' WHEN div_yield < 0.01 THEN '3: <1%' WHEN div_yield < 0.02 THEN '4: <2%' WHEN div_yield IS NOT NULL THEN '5: >=2%' END"
TRAIN = "has_core AND window_contiguous AND ticker <> 'MKT' AND capture_ret_abn IS NOT NULL"
STREAM = "SELECT ticker, time_bucket(INTERVAL 30 MINUTE, ts) AS bin_start, min(row(ts, event_id, price))[3] AS o, max(row(ts, event_id, price))[3] AS c, max(price) AS h, min(price) AS l, sum(price) AS v, count(*) AS b_n FROM minutes {} GROUP BY ALL"
STREAM_OUT = "SELECT ticker, strftime(bin_start, '%Y-%m-%d %H:%M:%S') AS bin_start, " + r("o AS b_open; c AS b_close; h AS b_high; l AS b_low; v AS b_volume") + ", b_n FROM ({})"

#: Columns shown as text, by query.
DATES = {
    "trading_calendar": "date_et", "consolidated_events": "ex_date declaration_date", "event_panel": "ex_date bar_date", "event_grain": "ex_date", "panel_returns_lag": "ex_date", "value_at_offset": "ex_date", "asof_metadata": "ex_date m_delisted",
    "prefer_active_metadata": "list_date", "sic_enrichment_guard": "ex_date", "model_features": "ex_date", "intraday_bins": "date_et", "session_features": "date_et", "bin_pivot_wide": "date_et", "market_context": "date_et", "gap_and_volume_ratio": "date_et", "training_rows": "ex_date",
}


def dated(name: str, sql: str) -> str:
    if name not in DATES:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in DATES[name].split())}) FROM ({sql})"


ORACLE: dict[str, str] = {k: q(dated(k, v)) for k, v in {
    "trading_calendar": "SELECT * FROM cal",
    "consolidated_events": f"SELECT ticker, ex_date, {r('cash_amount')}, n_distributions, frequency, declaration_date, distribution_types FROM ev",
    "event_panel": f"SELECT ticker, ex_date, offset_ AS \"offset\", bar_date, {r('open; close; high; low; volume; mkt_open; mkt_close; dollar_volume')}, coalesce(transactions, -1) AS transactions, coalesce(span_days, -1) AS span_days, ex_ym FROM panel",
    "event_grain": f"SELECT ticker, ex_date, n_distributions, frequency, n_bars, n_bars_pre, n_bars_post, max_span_days, {r(GRAIN_D)} FROM grain",
    "panel_returns_lag": f"SELECT ticker, ex_date, offset_ AS \"offset\", {r('prev_bar_close; prev_mkt_close; ret_cc; mkt_ret_cc; abn_ret_cc')} FROM panel",
    "value_at_offset": f"SELECT ticker, ex_date, {r('max(close) FILTER (offset_ = -1) AS close_m1; max(open) FILTER (offset_ = 0) AS open_0; max(close) FILTER (offset_ = 3) AS close_p3')} FROM panel GROUP BY ticker, ex_date",
    "quality_flags": "SELECT count(*) AS n_events, count(*) FILTER (has_core) AS has_core, count(*) FILTER (window_complete) AS window_complete, count(*) FILTER (window_contiguous) AS window_contiguous, count(*) FILTER (drop_ratio_extreme) AS drop_ratio_extreme, count(*) FILTER (low_yield) AS low_yield FROM grain",
    "headline_cuts_union": f"SELECT {PNL}, 'all' AS cut FROM base UNION ALL SELECT {PNL}, 'not extreme' FROM base WHERE NOT drop_ratio_extreme UNION ALL SELECT {PNL}, 'low yield out' FROM base WHERE NOT low_yield",
    "yield_bucket_fixed": f"SELECT {YIELD} AS bucket, count(*) AS n, {r('avg(capture_ret_abn) AS mean_abn; quantile_disc(capture_ret_abn, 0.5) AS median_abn; avg(drop_ratio) AS mean_drop; quantile_disc(drop_ratio, 0.5) AS median_drop')} FROM base GROUP BY 1",
    "by_year": f"SELECT CAST(year(ex_date) AS INTEGER) AS year, count(*) AS n, {r('avg(capture_ret_abn) AS mean_abn; quantile_disc(capture_ret_abn, 0.5) AS median_abn')} FROM base GROUP BY 1",
    "time_decay_curve": f"SELECT offset_ AS \"offset\", count(abn_ret_cc) AS n, {r('avg(abn_ret_cc) AS mean_abn; quantile_disc(abn_ret_cc, 0.5) AS median_abn')} FROM panel GROUP BY 1",
    "offset_date_concentration": "SELECT offset_ AS \"offset\", count(*) AS n_calendar_dates, max(n) AS top_calendar_date_events FROM (SELECT offset_, bar_date, count(*) AS n FROM panel WHERE abn_ret_cc IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "overall_summary": shown("base", None),
    "group_summary_yield_q5": shown(bucketed("div_yield"), "bucket"),
    "group_summary_vol_q5": shown(bucketed("pre_vol"), "bucket"),
    "group_summary_liquidity_q5": shown(bucketed("pre_avg_dollar_volume"), "bucket"),
    "bucket_boundaries": f"SELECT bucket AS bucket_label, {r('max(div_yield) AS observed_max; min(div_yield) AS observed_min')}, count(*) AS n_events, 'yield' AS dimension FROM {bucketed('div_yield')} GROUP BY bucket",
    "group_summary_sector": shown("sbase", "sic_description"),
    "group_summary_pseudo_sector": shown("(SELECT * FROM sbase WHERE sector_state = 'pseudo_recovered')", "pseudo_sector"),
    "sample_funnel": FUNNEL,
    "metric_identities": " UNION ALL ".join(f"SELECT '{n}' AS identity, count(abs({a} - {b})) AS n_eligible, count(*) FILTER (abs({a} - {b}) > 1e-8) AS n_violations, round(max(abs({a} - {b})), 6) + 0.0 AS max_abs_error FROM grain" for n, (a, b) in IDENT.items()),
    "dimension_diagnostics": f"""SELECT CAST(count(*) AS INTEGER) AS actual_bucket_count, {r('arg_min(m, x) AS low_bucket_mean_bps; arg_max(m, x) AS high_bucket_mean_bps; max(m) - min(m) AS mean_range_bps; max(md) - min(md) AS median_range_bps; max(pr) - min(pr) AS positive_rate_range_pp', 5)},
        CAST(coalesce(sum(up), 0) AS INTEGER) AS monotonic_step_count, {r('coalesce(corr(x, rk), 0.0) AS spearman_bucket_mean; arg_max(m, x) - arg_min(m, x) AS high_minus_low_bps', 5)}, 'yield' AS dimension
        FROM (SELECT m, md, pr, CAST(row_number() OVER (ORDER BY bucket) AS DOUBLE) AS x, CAST(lead(m) OVER (ORDER BY bucket) >= m AS INTEGER) AS up, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS rk
              FROM (SELECT bucket, avg(capture_ret_abn) * 10000 AS m, quantile_disc(capture_ret_abn, 0.5) * 10000 AS md, avg(CASE WHEN capture_ret_abn > 0 THEN 1.0 WHEN capture_ret_abn IS NOT NULL THEN 0.0 END) * 100 AS pr FROM {bucketed('div_yield')} GROUP BY bucket))""",
    "sector_diagnostics": f"""SELECT 'direct' AS taxonomy, CAST(sum(n) AS BIGINT) AS analysis_events, CAST(count(*) AS INTEGER) AS category_count, CAST(count(*) FILTER (ok) AS INTEGER) AS eligible_category_count,
        {r('sum(n) FILTER (k = 1) / sum(n) AS top_1_event_share; sum(n) FILTER (k <= 5) / sum(n) AS top_5_event_share', 5)}, max(row(m, g)) FILTER (ok)[2] AS highest_group, {r('max(m) FILTER (ok) * 10000 AS highest_mean_bps', 5)}, min(row(m, g)) FILTER (ok)[2] AS lowest_group,
        {r('min(m) FILTER (ok) * 10000 AS lowest_mean_bps; (max(m) FILTER (ok) - min(m) FILTER (ok)) * 10000 AS eligible_mean_range_bps', 5)}
        FROM (SELECT g, m, n, n >= 30 AS ok, row_number() OVER (ORDER BY n DESC, g) AS k FROM (SELECT sic_description AS g, avg(capture_ret_abn) AS m, count(*) AS n FROM sbase WHERE sector_state = 'direct_sic_known' GROUP BY 1))""".replace("max(row(m, g)) FILTER (ok)[2]", "(max(row(m, g)) FILTER (ok))[2]").replace("min(row(m, g)) FILTER (ok)[2]", "(min(row(m, g)) FILTER (ok))[2]"),
    "event_time_daily": f"""SELECT a.offset_ AS "offset", n_events, n_tickers, {r('mean_abn_ret_cc; stddev_abn_ret_cc; median_abn_ret_cc; p25_abn_ret_cc; p75_abn_ret_cc; se AS se_abn_ret_cc; mean_abn_ret_cc - 1.96 * se AS ci95_low_abn_ret_cc; mean_abn_ret_cc + 1.96 * se AS ci95_high_abn_ret_cc')},
        n_calendar_dates, top_calendar_date_events, {r('top_calendar_date_events / n_events AS top_calendar_date_share')}
        FROM (SELECT offset_, count(*) AS n_events, count(DISTINCT ticker) AS n_tickers, avg(abn_ret_cc) AS mean_abn_ret_cc, stddev_samp(abn_ret_cc) AS stddev_abn_ret_cc, quantile_disc(abn_ret_cc, 0.5) AS median_abn_ret_cc, quantile_disc(abn_ret_cc, 0.25) AS p25_abn_ret_cc, quantile_disc(abn_ret_cc, 0.75) AS p75_abn_ret_cc,
                     CASE WHEN count(*) > 1 THEN stddev_samp(abn_ret_cc) / sqrt(count(*)) END AS se FROM panel WHERE abn_ret_cc IS NOT NULL AND (ticker, ex_date) IN (SELECT (ticker, ex_date) FROM base WHERE n_bars = 9) GROUP BY 1) a
        JOIN (SELECT offset_, count(*) AS n_calendar_dates, max(n) AS top_calendar_date_events FROM (SELECT offset_, bar_date, count(*) AS n FROM panel WHERE abn_ret_cc IS NOT NULL AND (ticker, ex_date) IN (SELECT (ticker, ex_date) FROM base WHERE n_bars = 9) GROUP BY 1, 2) GROUP BY 1) b ON a.offset_ = b.offset_""",
    "event_time_overnight": f"SELECT count(*) AS n_events, count(DISTINCT ticker) AS n_tickers, {OVERNIGHT} FROM base",
    "asof_metadata": "SELECT ticker, ex_date, m_delisted, sic_description, active FROM (SELECT g.ticker, g.ex_date, m.delisted_date AS m_delisted, m.sic_description, m.active, row_number() OVER (PARTITION BY g.ticker, g.ex_date ORDER BY m.delisted_date ASC NULLS LAST, m.active DESC NULLS LAST) AS n FROM grain g LEFT JOIN meta m ON g.ticker = m.ticker AND (m.delisted_date IS NULL OR m.delisted_date >= g.ex_date)) WHERE n = 1",
    "prefer_active_metadata": "SELECT ticker, active, sic_description, list_date FROM preferred",
    "sic_enrichment_guard": "SELECT ticker, ex_date, sic_description FROM enriched",
    "sector_states": "SELECT event_id, sic_description, pseudo_sector, sector_state, sector_source FROM sbase",
    "sector_bridge": "SELECT sector_state, count(*) AS n_events, count(DISTINCT ticker) AS n_tickers, round(count(*) / sum(count(*)) OVER (), 6) AS event_share FROM sbase GROUP BY sector_state",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "label_conflicts": "SELECT ticker, count(DISTINCT description) AS n_labels, array_to_string(list_sort(list_distinct(list(description))), '; ') AS labels FROM meta GROUP BY ticker HAVING count(DISTINCT description) > 1",
    "coverage_crosstab": "SELECT description IS NOT NULL AS has_text, sic_description IS NOT NULL AS has_sic, count(*) AS n FROM meta GROUP BY 1, 2",
    "coverage_buckets_left_join": """SELECT coalesce(bucket, 'NO_METADATA') AS bucket, count(*) AS n_events, count(DISTINCT ev.ticker) AS n_tickers FROM ev LEFT JOIN (SELECT ticker AS t, CASE WHEN description IS NOT NULL AND sic_description IS NOT NULL THEN 'TRAIN' WHEN description IS NOT NULL THEN 'FILLABLE'
        WHEN sic_description IS NOT NULL THEN 'SIC_ONLY' ELSE 'UNREACHABLE' END AS bucket FROM preferred WHERE ticker <> 'Brand#55') ON ev.ticker = t GROUP BY 1""",
    "sip_ticker_list": "SELECT DISTINCT ticker FROM bars",
    "universe_set_audit": "SELECT ticker, 'both' AS part FROM (SELECT ticker FROM bars INTERSECT SELECT ticker FROM meta) UNION ALL SELECT ticker, 'bars only' FROM (SELECT ticker FROM bars EXCEPT SELECT ticker FROM meta) UNION ALL SELECT ticker, 'metadata only' FROM (SELECT ticker FROM meta EXCEPT SELECT ticker FROM bars)",
    "model_features": f"SELECT event_id, ticker, ex_date, {r('cash_amount; prev_close; div_yield; pre_avg_ret; pre_avg_abn_ret; pre_vol; pre_avg_dollar_volume')}, declaration_lead_days, event_month FROM base",
    "model_outcomes": f"SELECT event_id, {r('capture_ret; capture_ret_abn; drop_ratio; drop_pct; hold_ret')} FROM base",
    "handoff_key_parity": "SELECT event_id, 'left' AS side FROM (SELECT event_id FROM base WHERE pre_vol IS NOT NULL EXCEPT SELECT event_id FROM base WHERE div_yield >= 0.01) UNION ALL SELECT event_id, 'right' FROM (SELECT event_id FROM base WHERE div_yield >= 0.01 EXCEPT SELECT event_id FROM base WHERE pre_vol IS NOT NULL)",
    "intraday_bins": f"SELECT ticker, date_et, bin, {r('b_open; b_close; b_high; b_low; b_volume')}, b_n FROM bins",
    "session_features": f"SELECT ticker, date_et, {r('sess_open; sess_close; sess_high; sess_low; sess_volume')}, sess_n, n_bins, {r('sess_close / nullif(sess_open, 0) - 1 AS sess_ret; (sess_high - sess_low) / nullif(sess_close, 0) AS sess_range; sess_volume / nullif(sess_n, 0) AS sess_avg_trade_size; sess_realized_vol')} FROM sess",
    "bin_pivot_wide": f"SELECT ticker, date_et, {PIVOT} FROM ret GROUP BY ticker, date_et",
    "market_context": f"SELECT s.ticker, s.date_et, {r('s.sess_close / nullif(s.sess_open, 0) - 1 AS sess_ret; m.sess_close / nullif(m.sess_open, 0) - 1 AS mkt_sess_ret')} FROM sess s LEFT JOIN sess m ON m.ticker = '1' AND m.date_et = s.date_et",
    "gap_and_volume_ratio": f"SELECT ticker, date_et, {r('pc AS prev_close; av AS avg20_volume; sess_open / nullif(pc, 0) - 1 AS gap_ret; sess_volume / nullif(av, 0) AS sess_vol_ratio')} FROM (SELECT *, lag(sess_close) OVER w AS pc, avg(sess_volume) OVER (PARTITION BY ticker ORDER BY date_et ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS av FROM sess WINDOW w AS (PARTITION BY ticker ORDER BY date_et))",
    "training_rows": f"SELECT ticker, ex_date, {r('div_yield; CAST(capture_ret_abn > 0.0010 AS DOUBLE) AS label; capture_ret_abn')}, declaration_lead_days AS days_decl_to_ex, event_month AS ex_month FROM grain WHERE {TRAIN} AND div_yield >= 0.005",
    "temporal_split_counts": f"SELECT count(*) AS n, sum(CAST(capture_ret_abn > 0.0010 AS DOUBLE)) AS n_positive, 'train' AS part FROM grain WHERE {TRAIN} AND div_yield >= 0 AND ex_date <= DATE '1998-12-31' UNION ALL SELECT count(*), sum(CAST(capture_ret_abn > 0.0010 AS DOUBLE)), 'test' FROM grain WHERE {TRAIN} AND div_yield >= 0 AND ex_date > DATE '1998-12-31'",
    "pnl_selected_vs_all": f"SELECT {PNL}, 'all' AS part FROM base UNION ALL SELECT {PNL}, 'selected' FROM base WHERE div_yield >= 0.02",
    "json_props_parse": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type",
    "top_liquid_events": f"SELECT event_id, {r('pre_avg_dollar_volume')} FROM (SELECT * FROM base ORDER BY pre_avg_dollar_volume DESC NULLS LAST, event_id LIMIT 20)",
    "sic_division_rollup": f"SELECT {DIVISION} AS division, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1",
    "hybrid_rollup": f"""SELECT CASE WHEN n < 40 THEN 'OTHER' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT label, sum(n) AS n FROM (SELECT n, CASE WHEN n >= avg(n) OVER () THEN CAST(major AS VARCHAR) ELSE division || ' (other)' END AS label
        FROM (SELECT p_size AS major, {DIVISION} AS division, count(*) AS n FROM part GROUP BY 1, 2)) GROUP BY label) GROUP BY 1""",
    "dedupe_text": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "deterministic_sample": "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n <= 3",
    "class_histogram": "SELECT quality, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality",
    "three_level_buckets": f"SELECT {LEVELS('div_yield', 0.005, 0.01)} AS yield_level, {LEVELS('pre_avg_dollar_volume', 1000000, 5000000)} AS size_level, {LEVELS('pre_vol', 0.01, 0.02)} AS vol_level, count(*) AS n FROM grain GROUP BY 1, 2, 3",
    "imputed_features": f"SELECT event_id, {r('coalesce(pre_vol, 0.0) AS pre_vol; coalesce(pre_avg_dollar_volume, -1.0) AS pre_avg_dollar_volume')}, coalesce(declaration_lead_days, 0) AS declaration_lead_days FROM grain",
    "null_profile": "SELECT count(*) AS n, count(*) - count(close) AS null_close, count(*) - count(mkt_close) AS null_mkt_close, count(*) - count(ret_cc) AS null_ret_cc, count(*) - count(bar_date) AS null_bar_date FROM panel",
    "checker_counts": "SELECT count(*) AS n_events, count(DISTINCT (ticker, ex_date)) AS n_keys, count(*) FILTER (has_core AND (prev_close <= 0 OR ex_open <= 0)) AS n_bad_prices, (SELECT count(*) FROM panel) AS n_panel FROM grain",
    "stream_bins_equals_batch": STREAM_OUT.format(STREAM.format("")),
    "stream_static_join": STREAM_OUT.format(STREAM.format("WHERE ticker IN (SELECT ticker FROM minutes GROUP BY ticker HAVING count(*) >= 10)")),
}.items()}
