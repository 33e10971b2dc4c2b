"""The cross-sectional run: audits first, then all tables under an immutable root."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import event_study as es
from tidewater.operators import reference as ref
from tidewater.operators import statistics as st
from tidewater.operators.learning import leaks
from tidewater.sources.sinks import write_once, write_text

FEATURES = ("event_id", "ticker", "ex_date", "cash_amount", "prev_close", "div_yield", "pre_avg_ret", "pre_avg_abn_ret", "pre_vol", "pre_avg_dollar_volume", "declaration_lead_days", "event_month")
OUTCOMES = ("event_id", "capture_ret", "capture_ret_abn", "drop_ratio", "drop_pct", "hold_ret")
REQUIRED = {"ticker", "ex_date", "cash_amount", "prev_close", "ex_open", "div_yield", "drop_ratio", "drop_pct", "capture_ret", "mkt_overnight_ret", "capture_ret_abn", "pre_avg_ret", "pre_avg_abn_ret", "pre_vol", "pre_avg_dollar_volume", "n_bars", "has_core", "window_contiguous"}


class RunError(ValueError):
    pass


@dataclass(frozen=True)
class RunConfig:
    run_id: str
    output_root: str
    market: str
    label_level: str = "hybrid"
    buckets: int = 5
    min_cell_n: int = 30
    min_report_tickers: int = 5
    tolerance: float = 1e-8
    min_history_days: int = 365
    insight_min_abs_bps: float = 1.0

    def check(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{2,63}", self.run_id):
            raise RunError(f"run id {self.run_id!r}: letters, digits, dot, dash and underscore, 3 to 64 of them")
        if not 2 <= self.buckets <= 99 or self.min_cell_n < 1 or self.min_report_tickers < 1 or self.tolerance <= 0:
            raise RunError("buckets must be 2 to 99, minimums positive, tolerance above 0")


def audit(grain: DataFrame, panel: DataFrame, config: RunConfig) -> list[str]:
    """What forbids a run: missing columns, bad keys, a short history, missing offsets, broken identities.  Each table is read once."""
    issues = [f"grain lacks {c}" for c in sorted(REQUIRED - set(grain.columns))]
    if issues:
        return issues
    g = grain.agg(F.count("*").alias("n"), F.count_distinct("ticker", "ex_date").alias("k"), F.sum((F.col("ticker").isNull() | F.col("ex_date").isNull()).cast("int")).alias("nulls"), F.datediff(F.max("ex_date"), F.min("ex_date")).alias("days")).head()
    p = panel.agg(F.count("*").alias("n"), F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count_distinct("offset").alias("k")).head()
    if not g["n"]:
        return ["grain is empty"]
    if g["nulls"] or g["k"] != g["n"]:
        issues.append(f"grain keys: {g['n']} rows, {g['k']} keys, {g['nulls']} null")
    if g["days"] < config.min_history_days:
        issues.append(f"history of {g['days']} days, {config.min_history_days} needed")
    if (p["lo"], p["hi"], p["k"]) != (-es.PRE, es.POST, es.PRE + es.POST + 1) or p["n"] != 9 * g["n"]:
        issues.append(f"panel: {p['n']} rows, offsets {p['lo']}..{p['hi']}")
    bad = st.metric_identities(grain, config.tolerance).filter("n_violations > 0").collect()
    return issues + [f"identity {r['identity']}: {r['n_violations']} violations" for r in bad]


def build(grain: DataFrame, panel: DataFrame, meta: DataFrame, pseudo: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    """The result tables by name."""
    enriched = ref.enrich_sic(grain, meta)
    lookup = ref.pseudo_lookup(pseudo, config.label_level)
    states = ref.sector_states(enriched, lookup)
    base = es.base_population(states, config.market)
    stable = base.filter("n_bars = 9")
    summary = lambda df, by: st.group_summary(df, by, config.min_cell_n, config.min_report_tickers)
    out = {"sample_funnel": st.sample_funnel(states, config.market), "metric_identities": st.metric_identities(grain, config.tolerance), "overall_summary": summary(base, None)}
    boundaries, diagnostics = None, None
    for name, value in (("yield", "div_yield"), ("volatility", "pre_vol"), ("liquidity", "pre_avg_dollar_volume")):
        cut = st.quantile_bucket(base.filter(F.col(value).isNotNull()), value, f"{name}_bucket", config.buckets, required=True)
        made = out[f"{name}_summary"] = summary(cut, f"{name}_bucket")
        b, d = st.bucket_boundaries(cut, name, value, f"{name}_bucket"), st.dimension_diagnostics(made, f"{name}_bucket", name)
        boundaries = b if boundaries is None else boundaries.unionByName(b)
        diagnostics = d if diagnostics is None else diagnostics.unionByName(d)
    sic, pseudo_sum = summary(base.filter("direct_sic_known"), "sic_description"), summary(base.filter("pseudo_recovered"), "pseudo_sector")
    features, outcomes = base.select(*FEATURES), base.select(*OUTCOMES)
    if bad := leaks([c for c in features.columns if c != "event_id"]):
        raise RunError(f"features hold outcomes: {bad}")
    return out | {
        "bucket_boundaries": boundaries, "dimension_diagnostics": diagnostics, "sic_summary": summary(base, "sic_description"), "sic_known_summary": sic, "pseudo_summary": pseudo_sum,
        "sector_diagnostics": st.sector_diagnostics(sic, "sic_description", "direct_sic_current_reference").unionByName(st.sector_diagnostics(pseudo_sum, "pseudo_sector", "model_predicted_pseudo_sector")),
        "sector_bridge": ref.sector_bridge(base), "event_time_daily": st.event_time_curve(stable, panel), "event_time_overnight": st.overnight_summary(base),
        "model_features": features, "model_outcomes": outcomes, "handoff_parity": st.key_difference(features, outcomes, "event_id"),
        "label_conflicts": ref.label_conflicts(meta, "ticker", "sic_description"), "duplicate_keys": st.duplicate_keys(grain, "ticker", "ex_date"), "analysis_base": base.select("event_id", "ticker", "ex_date", "sector_state", "sector_source"),
    }


def insights(tables: dict[str, DataFrame], config: RunConfig) -> list[dict]:
    """One entry per ordered dimension and one per taxonomy, each with the numbers that it rests on."""
    found = []
    for r in tables["dimension_diagnostics"].orderBy("dimension").collect():
        flat = abs(r["high_minus_low_bps"]) < config.insight_min_abs_bps
        status = "flat" if flat else "informative" if r["monotonic_step_count"] in (0, r["actual_bucket_count"] - 1) else "mixed"
        found.append({"section": r["dimension"], "status": status, "evidence": r.asDict()})
    found += [{"section": r["taxonomy"], "status": "informative" if r["eligible_category_count"] > 1 else "insufficient", "evidence": r.asDict()} for r in tables["sector_diagnostics"].orderBy("taxonomy").collect()]
    clean = lambda v: None if isinstance(v, float) and v - v != 0 else v
    return [f | {"evidence": {k: clean(v) for k, v in f["evidence"].items()}} for f in found]


def run(spark: SparkSession, mode: str, config: RunConfig, grain: DataFrame, panel: DataFrame, meta: DataFrame, pseudo: DataFrame) -> dict[str, DataFrame]:
    """mode preflight audits and writes nothing; mode final also writes every table, once, and a manifest."""
    config.check()
    if issues := audit(grain, panel, config):
        raise RunError("; ".join(issues))
    tables = build(grain, panel, meta, pseudo, config)
    if mode == "final":
        root = f"{config.output_root.rstrip('/')}/{config.run_id}"
        for name, df in tables.items():
            write_once(df, f"{root}/{name}")
        write_text(spark, json.dumps(insights(tables, config), default=str), f"{root}/section_insights")
        write_text(spark, json.dumps(asdict(config) | {"tables": sorted(tables)}), f"{root}/manifest")
    return tables
