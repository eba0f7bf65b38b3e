"""Ingest, schema alignment, reshaping and domain checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio_or_zero
from ..schema import (BILL_COLS, DOMAINS, FEATURES, PAY_AMT_COLS, PAY_COLS, RAW_TARGET, TARGET)


def ingest(raw: DataFrame, drop_id: bool = False) -> DataFrame:
    """Rename the raw target and SEX; ``ID`` is kept as the row key unless asked."""
    df = raw.withColumnsRenamed({RAW_TARGET: TARGET, "SEX": "GENDER"})
    return df.drop("ID") if drop_id else df


def feature_matrix(df: DataFrame, features=FEATURES) -> DataFrame:
    """ID + the 32 training features with missing values as 0, DEFAULT as int
    and ``label`` as double (what MLlib estimators read)."""
    out = df.select("ID", *features, F.col(TARGET).cast("int").alias(TARGET))
    out = out.fillna(0, subset=list(features))
    return out.withColumn("label", F.col(TARGET).cast("double"))


def align_features(df: DataFrame, features=None) -> DataFrame:
    """Project a model's stored feature list; an absent column becomes 0.

    ``features=None`` falls back to the 32-name default list.
    """
    cols = list(features) if features else list(FEATURES)
    present = set(df.columns)
    keys = [c for c in ("ID",) if c in present and c not in cols]
    return df.select(*keys, *[F.col(c) if c in present else F.lit(0).alias(c) for c in cols])


def cast_numeric(df: DataFrame) -> DataFrame:
    """Every numeric column as double, every other column as string."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`").cast("string").alias(f.name))
    return df.select(*out)


def monthly_long(df: DataFrame) -> DataFrame:
    """Wide months → one row per (ID, month): month 1 is the most recent.

    A generator over the row (no shuffle); the three month groups stay aligned.
    """
    months = [F.struct(F.lit(i).alias("month"), F.col(p).alias("pay_status"),
                       F.col(b).alias("bill_amt"), F.col(a).alias("pay_amt"))
              for i, (p, b, a) in enumerate(zip(PAY_COLS, BILL_COLS, PAY_AMT_COLS), start=1)]
    return df.select("ID", F.inline(F.array(*months)))


def monthly_pay_ratio(df: DataFrame) -> DataFrame:
    """Per client and month: PAY_AMTk ÷ BILL_AMTk, 0 when the bill is 0 or missing."""
    return monthly_long(df).select(
        "ID", "month", F.round(ratio_or_zero("pay_amt", "bill_amt"), 6).alias("monthly_pay_ratio"))


def domain_check(raw: DataFrame, domains=DOMAINS) -> DataFrame:
    """One pass over the raw records: per column, rows, NULLs and values outside
    the data dictionary's domain; stacked to one row per column."""
    aggs, names = [], []
    for c, dom in domains.items():
        x = F.col(f"`{c}`")
        if isinstance(dom, list):
            bad = x.isNotNull() & ~x.isin(dom)
        else:
            lo, hi = dom
            cond = F.lit(False)
            if lo is not None:
                cond = cond | (x < lo)
            if hi is not None:
                cond = cond | (x > hi)
            bad = x.isNotNull() & cond
        i = len(names)
        names.append(c)
        aggs += [F.count_if(x.isNull()).alias(f"null{i}"), F.count_if(bad).alias(f"bad{i}")]
    one = raw.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"),
                     F.col(f"null{i}").alias("n_null"), F.col(f"bad{i}").alias("n_out_of_domain"))
            for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))
