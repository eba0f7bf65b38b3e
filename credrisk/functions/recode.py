"""Label recodes, bins and bands (literal lookups evaluated in codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (AGE_EDGES, AGE_LABELS, DEFAULT_LABELS, DELINQUENCY_STAGES, EDU_FALLBACK,
                      EDU_LABELS, MAR_FALLBACK, MAR_LABELS, PAY_STATUS_LABELS, RATE_BAND_ELSE,
                      RATE_BANDS, SEX_LABELS, TIER_ELSE, TIER_VERDICTS, TIERS)
from .columns import col, lookup


def sex_label(c="GENDER") -> Column:
    return lookup(c, SEX_LABELS)


def edu_label(c="EDUCATION") -> Column:
    return lookup(c, EDU_LABELS, EDU_FALLBACK)


def mar_label(c="MARRIAGE") -> Column:
    return lookup(c, MAR_LABELS, MAR_FALLBACK)


def default_label(c="DEFAULT") -> Column:
    return lookup(c, DEFAULT_LABELS)


def pay_status_label(c="PAY_0") -> Column:
    """Status text; unmatched values fall back to their own string form."""
    return lookup(c, PAY_STATUS_LABELS, col(c).cast("string"))


def age_group(c="AGE") -> Column:
    """Right-closed bins (lo, hi]; outside every bin gives NULL."""
    x = col(c)
    expr = None
    for lo, hi, label in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_group_ord(c="AGE") -> Column:
    """1-based bin position of ``age_group`` (sort key); NULL outside the bins."""
    x = col(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(AGE_EDGES[:-1], AGE_EDGES[1:]), start=1):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def rate_band(rate_pct) -> Column:
    x = col(rate_pct)
    expr = None
    for bound, label in RATE_BANDS:
        expr = F.when(x > bound, F.lit(label)) if expr is None else expr.when(x > bound, F.lit(label))
    return expr.otherwise(F.lit(RATE_BAND_ELSE))


def risk_tier(pct) -> Column:
    x = col(pct)
    expr = None
    for bound, label in TIERS:
        expr = F.when(x < bound, F.lit(label)) if expr is None else expr.when(x < bound, F.lit(label))
    return expr.otherwise(F.lit(TIER_ELSE))


def tier_verdict(tier) -> Column:
    return lookup(tier, TIER_VERDICTS)


def tier_ord(tier) -> Column:
    labels = [lab for _, lab in TIERS] + [TIER_ELSE]
    return lookup(tier, {lab: i for i, lab in enumerate(labels, start=1)})


def delinquency_stage(months_late="PAY_0") -> tuple[Column, Column, Column]:
    """(stage, days-past-due text, ordinal) from months late on the latest status.

    Paid / no use (< 0) is current; revolving (0) is 0 DPD; n months late is
    30·n days, placed in right-closed bands (0,30], (30,60], (60,90], > 90.
    """
    m = col(months_late)
    days = m * 30
    idx = (F.when(m.isNull(), F.lit(None))
           .when(m < 0, 0).when(m == 0, 1).when(days <= 30, 2)
           .when(days <= 60, 3).when(days <= 90, 4).otherwise(5))
    stage = lookup(idx, {i: s for i, (s, _) in enumerate(DELINQUENCY_STAGES)})
    dpd = lookup(idx, {i: d for i, (_, d) in enumerate(DELINQUENCY_STAGES)})
    return stage, dpd, idx


def with_labels(df: DataFrame) -> DataFrame:
    """Dashboard labels: SEX/EDU/MAR/DEFAULT labels and the ordered AGE_GROUP."""
    return df.withColumns({
        "SEX_LABEL": sex_label(),
        "EDU_LABEL": edu_label(),
        "MAR_LABEL": mar_label(),
        "DEFAULT_LABEL": default_label(),
        "AGE_GROUP": age_group(),
        "AGE_GROUP_ORD": age_group_ord(),
    })
