"""Queries over scored clients: tiers, portfolio comparison, explanations,
delinquency stages."""

from __future__ import annotations

from ..operators import scoring as sc
from ..schema import (COVERAGE_HIGH, COVERAGE_MODERATE, DELAY_HIGH, DELAY_MODERATE, DELINQUENCY_STAGES,
                      FACTOR_NAMES, LIMIT_LOW, LIMIT_MODERATE, TIER_ELSE, TIERS, UTIL_HIGH,
                      UTIL_MODERATE)
from . import oracle_sql as S
from .catalog import featured, register
from .evaluation_queries import FT, score_sql
from .oracle_sql import with_clients

_SC = f'sc AS (SELECT *, {score_sql()} AS score FROM ft)'


def _scored_full(spark, d):
    return sc.scorecard_score(featured(spark, d, "train"))


@register("risk_tier", with_clients(
    f"SELECT ID, round(score * 100, 4) AS pct, {S.risk_tier('score * 100')} AS tier, "
    f"{S.tier_verdict(S.risk_tier('score * 100'))} AS verdict FROM sc", FT, _SC))
def q_risk_tier(spark, d):
    """Probability in percent and risk tier (<15 / <35 / <60 / else) with verdict."""
    return sc.with_tier(_scored_full(spark, d)).select("ID", "pct", "tier", "verdict")


_tier_labels = [lab for _, lab in TIERS] + [TIER_ELSE]


@register("tier_distribution", with_clients(
    "SELECT tier, COUNT(*) AS clients, round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS default_rate_pct, "
    f"round(avg(pct), 4) AS avg_pct, {S.case_map('tier', {lab: i for i, lab in enumerate(_tier_labels, 1)})} AS tier_ord "
    f"FROM (SELECT *, round(score * 100, 4) AS pct, {S.risk_tier('score * 100')} AS tier FROM sc) GROUP BY tier ORDER BY tier_ord",
    FT, _SC))
def q_tier_distribution(spark, d):
    """Clients, observed default rate and mean probability per risk tier."""
    return sc.tier_distribution(_scored_full(spark, d))


@register("score_vs_average", with_clients(
    "SELECT ID, round(score * 100, 4) AS pct, round(rate * 100, 4) AS portfolio_rate_pct, "
    "round(round(score * 100, 4) - rate * 100, 4) AS delta_pct, "
    "CASE WHEN round(score * 100, 4) > rate * 100 THEN 'above average' ELSE 'at or below average' END AS relative "
    "FROM sc, (SELECT avg(CAST(\"DEFAULT\" AS DOUBLE)) AS rate FROM sc)", FT, _SC))
def q_score_vs_average(spark, d):
    """Each client's probability against the portfolio's observed default rate."""
    return sc.score_vs_average(_scored_full(spark, d))


def _factor_sql() -> str:
    def lvl(high, mod):
        return f"CASE WHEN {high} THEN 'HIGH' WHEN {mod} THEN 'MODERATE' ELSE 'LOW' END"
    vals = [
        ("UTIL_RATE * 100", lvl(f"UTIL_RATE > {UTIL_HIGH}", f"UTIL_RATE > {UTIL_MODERATE}"),
         "format('{:.1f}%', UTIL_RATE * 100)"),
        ("greatest(0, PAY_0) / CAST(8.0 AS DOUBLE) * 100", lvl(f"PAY_0 > {DELAY_HIGH}", f"PAY_0 > {DELAY_MODERATE}"),
         "CASE WHEN PAY_0 > 0 THEN CAST(PAY_0 AS VARCHAR) || ' months delay' ELSE 'On time ✓' END"),
        ("greatest(CAST(0.0 AS DOUBLE), AVG_PAY_STATUS) / CAST(8.0 AS DOUBLE) * 100",
         lvl(f"AVG_PAY_STATUS > {DELAY_HIGH}", f"AVG_PAY_STATUS > {DELAY_MODERATE}"), "format('{:.1f} avg months late', AVG_PAY_STATUS)"),
        ("greatest(CAST(0.0 AS DOUBLE), 1 - PAY_RATIO) * 100", lvl(f"PAY_RATIO < {COVERAGE_HIGH}", f"PAY_RATIO < {COVERAGE_MODERATE}"),
         "format('{:.1f}% of bills paid', PAY_RATIO * 100)"),
        ("greatest(CAST(0.0 AS DOUBLE), 1 - LIMIT_BAL / CAST(1000000.0 AS DOUBLE)) * 100",
         f"CASE WHEN LIMIT_BAL > {LIMIT_LOW} THEN 'LOW' WHEN LIMIT_BAL > {LIMIT_MODERATE} THEN 'MODERATE' ELSE 'HIGH' END",
         "'NT$' || format('{:,}', LIMIT_BAL)"),
    ]
    rows = [[("ID", "ID"), ("factor_ord", str(i + 1)), ("factor", S.lit(name)),
             ("risk_value", f"CAST({v} AS DOUBLE)"),
             ("bar_pct", f"least(CAST(100.0 AS DOUBLE), CAST({v} AS DOUBLE))"),
             ("level", lev), ("display", f"CAST({disp} AS VARCHAR)")]
            for i, (name, (v, lev, disp)) in enumerate(zip(FACTOR_NAMES, vals))]
    return S.stack(rows, "ft")


@register("factor_analysis", with_clients(_factor_sql(), FT))
def q_factor_analysis(spark, d):
    """Five explanation factors per client with risk value, bar and level."""
    return sc.factor_analysis(featured(spark, d, "train"))


def _stage_sql() -> str:
    idx = ("CASE WHEN PAY_0 IS NULL THEN NULL WHEN PAY_0 < 0 THEN 0 WHEN PAY_0 = 0 THEN 1 WHEN PAY_0 * 30 <= 30 THEN 2 "
           "WHEN PAY_0 * 30 <= 60 THEN 3 WHEN PAY_0 * 30 <= 90 THEN 4 ELSE 5 END")
    stage = S.case_map("stage_ord", {i: s for i, (s, _) in enumerate(DELINQUENCY_STAGES)})
    dpd = S.case_map("stage_ord", {i: x for i, (_, x) in enumerate(DELINQUENCY_STAGES)})
    return (f"SELECT stage_ord, {stage} AS stage, {dpd} AS days_past_due, COUNT(*) AS clients, "
            "round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS default_rate_pct, round(avg(UTIL_RATE), 6) AS avg_util_rate "
            f"FROM (SELECT *, {idx} AS stage_ord FROM fd) WHERE stage_ord IS NOT NULL GROUP BY stage_ord ORDER BY stage_ord")


@register("delinquency_stage", with_clients(_stage_sql(), S.features_cte("fd", "dash")))
def q_delinquency_stage(spark, d):
    """Clients, default rate and utilization by delinquency stage of the latest status."""
    return sc.delinquency_profile(featured(spark, d, "dash"))

