"""Dataset profile: counts, missing values, duplicates, numeric summaries and
value counts (A1–A8, A18, P22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import default_label, pay_status_label
from ..schema import BILL_COLS, TARGET
from .ordered import wide_summary


def kpi_summary(df: DataFrame, n_features: int) -> DataFrame:
    """Banner numbers: clients, columns, default rate, average limit, features."""
    return df.agg(
        F.count(F.lit(1)).alias("total_clients"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.round(F.avg(F.col(TARGET).cast("double")) * 100, 4).alias("default_rate_pct"),
        F.round(F.avg(F.col("LIMIT_BAL").cast("double")), 4).alias("avg_limit_bal"),
        F.lit(n_features).alias("n_features"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count per column, one row per column (single aggregation pass)."""
    cols = df.columns
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_missing"))
            for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


def duplicate_ids(df: DataFrame, key: str = "ID") -> DataFrame:
    """Rows, distinct keys and surplus rows (rows − distinct keys)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct_ids"),
        F.sum(F.col("_n") - 1).cast("long").alias("n_duplicate_rows"),
    )


def numeric_summary(df: DataFrame, cols, places: int | None = 4) -> DataFrame:
    """count, mean, sample std, min, exact 25/50/75 % (linear), max per column,
    one row per column, rounded to ``places`` (not at all with None); two scans
    (:func:`ordered.wide_summary`, no single-task percentile buffer)."""
    out = wide_summary(df, cols, {0.25: "p25", 0.5: "median", 0.75: "p75"})
    if places is None:
        return out
    return out.select(
        "variable", "count",
        *[F.round(c, places).alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])


def value_counts(df: DataFrame, key: str, by_count: bool = True) -> DataFrame:
    """Count per level, NULL level dropped; by count desc (or by key)."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), key) if by_count else out.orderBy(key)


def target_distribution(df: DataFrame) -> DataFrame:
    return value_counts(df.withColumn("DEFAULT_LABEL", default_label()), "DEFAULT_LABEL")


def pay_status_distribution(df: DataFrame, c: str = "PAY_0") -> DataFrame:
    """Status counts in status order, with the status text."""
    counts = value_counts(df, c, by_count=False)
    return counts.select(F.col(c).alias("pay_status"), F.col("count"),
                         pay_status_label(c).alias("label")).orderBy("pay_status")


def zero_bill_profile(df: DataFrame) -> DataFrame:
    """Clients by number of months with a zero bill, and their default rate."""
    zeros = sum(F.coalesce((F.col(b) == 0).cast("int"), F.lit(0)) for b in BILL_COLS)
    return (df.withColumn("zero_bill_months", zeros)
            .groupBy("zero_bill_months")
            .agg(F.count(F.lit(1)).alias("clients"),
                 F.sum(F.col(TARGET)).cast("long").alias("defaults"),
                 F.round(F.avg(F.col(TARGET).cast("double")) * 100, 4).alias("default_rate_pct"))
            .orderBy("zero_bill_months"))
