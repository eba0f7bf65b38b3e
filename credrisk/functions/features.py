"""Row-wise engineered features (three variants kept separate).

* ``train``  — the training job's definitions (clip floors −1 / −2).
* ``dash``   — the dashboard's definitions (clip floors 0, five features).
* ``score``  — the one-customer scoring form: divisors must be > 0, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (BILL_COLS, PAY_AMT_COLS, PAY_COLS, RATIO_CLIP_DASH, RATIO_CLIP_TRAIN,
                      UTIL_CLIP_DASH, UTIL_CLIP_TRAIN)
from .columns import clip, count_positive, ratio_or_zero, row_max, row_mean, row_sum

VARIANTS = ("train", "dash", "score")


def util_rate(variant: str = "train") -> Column:
    if variant == "score":
        lim = F.col("LIMIT_BAL")
        raw = F.when(lim > 0, F.col("BILL_AMT1").cast("double") / F.nullif(lim, F.lit(0)).cast("double"))
        return F.coalesce(clip(raw, *UTIL_CLIP_TRAIN), F.lit(0.0))
    lo, hi = UTIL_CLIP_DASH if variant == "dash" else UTIL_CLIP_TRAIN
    return ratio_or_zero("BILL_AMT1", "LIMIT_BAL", lo, hi)


def pay_ratio(total_pay: Column, total_bill: Column, variant: str = "train") -> Column:
    if variant == "score":
        raw = F.when(total_bill > 0, total_pay.cast("double") / F.nullif(total_bill, F.lit(0)).cast("double"))
        return F.coalesce(clip(raw, *RATIO_CLIP_TRAIN), F.lit(0.0))
    lo, hi = RATIO_CLIP_DASH if variant == "dash" else RATIO_CLIP_TRAIN
    return ratio_or_zero(total_pay, total_bill, lo, hi)


def with_features(df: DataFrame, variant: str = "train") -> DataFrame:
    """Append the engineered features of ``variant`` (one Project, no shuffle)."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    total_bill = row_sum(BILL_COLS).cast("long")
    total_pay = row_sum(PAY_AMT_COLS).cast("long")
    out = {
        "UTIL_RATE": util_rate(variant),
        "AVG_PAY_STATUS": row_mean(PAY_COLS),
        "TOTAL_BILL": total_bill,
        "TOTAL_PAY": total_pay,
        "PAY_RATIO": pay_ratio(total_pay, total_bill, variant),
    }
    if variant != "dash":
        out.update({
            "BILL_TREND": F.col("BILL_AMT1") - F.col("BILL_AMT6"),
            "PAY_TREND": F.col("PAY_AMT1") - F.col("PAY_AMT6"),
            "MAX_PAY_DELAY": row_max(PAY_COLS),
            "CONSEC_LATE": count_positive(PAY_COLS).cast("int"),
        })
    if variant == "score":
        out["CREDIT_USAGE_RATIO"] = util_rate(variant)
    return df.withColumns(out)


def log1p_cols(df: DataFrame, cols) -> DataFrame:
    """``log(1 + x)`` per column (x <= -1 gives NULL)."""
    return df.withColumns({c: F.log1p(F.col(c)) for c in cols})
