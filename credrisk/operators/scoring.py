"""Scores, risk tiers, portfolio comparison and factor explanations
(F13, X1–X11, J3, J4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid
from ..functions.recode import delinquency_stage, risk_tier, tier_ord, tier_verdict
from ..schema import (COVERAGE_HIGH, COVERAGE_MODERATE, DELAY_HIGH, DELAY_MODERATE,
                      FACTOR_NAMES, FACTOR_SCALE_MONTHS, LIMIT_LOW, LIMIT_MODERATE, LIMIT_SCALE,
                      SCORECARD, TARGET, UTIL_HIGH, UTIL_MODERATE)


def scorecard_score(df: DataFrame, coef: dict = SCORECARD, out: str = "score") -> DataFrame:
    """Fixed-coefficient logistic scorecard over train-variant features:
    z = b0 + b1·max(PAY_0,0) + b2·max(PAY_2,0) + b3·UTIL_RATE + b4·PAY_RATIO
    (features rounded to 6 dp), score = round(sigmoid(z), 4)."""
    z = (F.lit(coef["intercept"])
         + F.lit(coef["pay0"]) * F.greatest(F.col("PAY_0"), F.lit(0))
         + F.lit(coef["pay2"]) * F.greatest(F.col("PAY_2"), F.lit(0))
         + F.lit(coef["util"]) * F.round("UTIL_RATE", 6)
         + F.lit(coef["ratio"]) * F.round("PAY_RATIO", 6))
    return df.withColumn(out, F.round(sigmoid(z), 4))


def with_tier(df: DataFrame, prob: str = "score") -> DataFrame:
    """Probability in percent, tier by the 15 / 35 / 60 bands, verdict text."""
    pct = F.col(prob) * 100
    return df.withColumns({"pct": F.round(pct, 4), "tier": risk_tier(pct)}).withColumn(
        "verdict", tier_verdict("tier"))


def tier_distribution(scored: DataFrame, label: str = TARGET) -> DataFrame:
    """Clients, observed default rate and mean probability per tier, in tier order."""
    t = with_tier(scored)
    return (t.groupBy("tier").agg(F.count(F.lit(1)).alias("clients"),
                                  F.round(F.avg(F.col(label).cast("double")) * 100, 4).alias("default_rate_pct"),
                                  F.round(F.avg("pct"), 4).alias("avg_pct"))
            .withColumn("tier_ord", tier_ord("tier")).orderBy("tier_ord"))


def score_vs_average(scored: DataFrame, label: str = TARGET, key: str = "ID") -> DataFrame:
    """Each client's probability against the portfolio's observed default rate.

    The rate is one number: a global aggregate collected as a scalar and
    attached as a literal (no join)."""
    rate_row = scored.agg(F.avg(F.col(label).cast("double")).alias("_rate")).first()
    rate = F.lit(rate_row["_rate"]).cast("double") * 100
    t = with_tier(scored)
    return t.select(key, "pct", F.round(rate, 4).alias("portfolio_rate_pct"),
                    F.round(F.col("pct") - rate, 4).alias("delta_pct"),
                    F.when(F.col("pct") > rate, "above average").otherwise("at or below average").alias("relative"))


def factor_analysis(df: DataFrame, key: str = "ID") -> DataFrame:
    """Five (factor, risk value, bar, level) rows per client from utilization,
    latest status, average delay, payment coverage and credit limit."""
    util, pay0 = F.col("UTIL_RATE"), F.col("PAY_0")
    avg, ratio, lim = F.col("AVG_PAY_STATUS"), F.col("PAY_RATIO"), F.col("LIMIT_BAL")

    def level(high, moderate):
        return F.when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW")

    def one_place(x):  # half-even on the exact value, as the reference formats it
        return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))

    months = float(FACTOR_SCALE_MONTHS)
    factors = [
        (util * 100, level(util > UTIL_HIGH, util > UTIL_MODERATE), F.concat(one_place(util * 100), F.lit("%"))),
        (F.greatest(F.lit(0), pay0) / months * 100, level(pay0 > DELAY_HIGH, pay0 > DELAY_MODERATE),
         F.when(pay0 > 0, F.concat(pay0.cast("string"), F.lit(" months delay"))).otherwise(F.lit("On time ✓"))),
        (F.greatest(F.lit(0.0), avg) / months * 100, level(avg > DELAY_HIGH, avg > DELAY_MODERATE),
         F.concat(one_place(avg), F.lit(" avg months late"))),
        (F.greatest(F.lit(0.0), 1 - ratio) * 100, level(ratio < COVERAGE_HIGH, ratio < COVERAGE_MODERATE),
         F.concat(one_place(ratio * 100), F.lit("% of bills paid"))),
        (F.greatest(F.lit(0.0), 1 - lim / float(LIMIT_SCALE)) * 100,
         F.when(lim > LIMIT_LOW, "LOW").when(lim > LIMIT_MODERATE, "MODERATE").otherwise("HIGH"),
         F.concat(F.lit("NT$"), F.format_number(lim, 0))),
    ]
    rows = [F.struct(F.lit(i + 1).alias("factor_ord"), F.lit(name).alias("factor"),
                     val.cast("double").alias("risk_value"),
                     F.least(F.lit(100.0), val).cast("double").alias("bar_pct"),
                     lev.alias("level"), disp.alias("display"))
            for i, (name, (val, lev, disp)) in enumerate(zip(FACTOR_NAMES, factors))]
    return df.select(key, F.inline(F.array(*rows)))


def delinquency_profile(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Clients, default rate and mean utilization per delinquency stage of the
    latest status, in stage order."""
    stage, dpd, idx = delinquency_stage("PAY_0")
    return (df.withColumns({"stage": stage, "days_past_due": dpd, "stage_ord": idx})
            .filter(F.col("stage").isNotNull())
            .groupBy("stage_ord", "stage", "days_past_due")
            .agg(F.count(F.lit(1)).alias("clients"),
                 F.round(F.avg(F.col(label).cast("double")) * 100, 4).alias("default_rate_pct"),
                 F.round(F.avg("UTIL_RATE"), 6).alias("avg_util_rate"))
            .orderBy("stage_ord"))
