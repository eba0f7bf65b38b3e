"""Histograms and box statistics by class (A13, A14), aggregated on Spark so
only bins and five-number summaries leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import default_label
from ..schema import TARGET
from ..session import cut_lineage
from .ordered import wide_summary


def _stack(df: DataFrame, cols, keep) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])))


def histogram_by_class(df: DataFrame, cols, n_bins: int, label: str = TARGET) -> DataFrame:
    """Exactly ``n_bins`` equal-width bins per variable over [min, max]; counts
    per (variable, bin, class).  Two passes: a min/max aggregate (one row per
    variable, broadcast) and a partially-aggregated count."""
    lab = df.withColumn("DEFAULT_LABEL", default_label(label))
    long = _stack(lab, cols, ["DEFAULT_LABEL"]).filter(F.col("value").isNotNull())
    rng = long.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    width = hi - lo
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(n_bins - 1), F.floor((x - lo) * n_bins / F.nullif(width, F.lit(0.0))).cast("int")))
    binned = long.join(F.broadcast(rng), "variable").withColumn("bin", b.cast("int"))
    counts = binned.groupBy("variable", "bin", "DEFAULT_LABEL", "lo", "hi").agg(
        F.count(F.lit(1)).alias("count"))
    return counts.select(
        "variable", "bin",
        F.round(lo + F.col("bin") * width / n_bins, 6).alias("bin_lo"),
        F.round(lo + (F.col("bin") + 1) * width / n_bins, 6).alias("bin_hi"),
        "DEFAULT_LABEL", "count").orderBy("variable", "bin", "DEFAULT_LABEL")


def box_by_class(df: DataFrame, cols, label: str = TARGET) -> DataFrame:
    """Five-number summary per (variable, class) with 1.5·IQR fences, whiskers
    at the most extreme points inside the fences, and the outlier count: two scans for the
    quartiles, one for what the fences cut off, none of them over stacked columns."""
    cols = list(cols)
    lab = df.select(default_label(label).alias("DEFAULT_LABEL"), *[F.col(c).cast("double").alias(c) for c in cols]).filter("DEFAULT_LABEL is not null")
    g = ["variable", "DEFAULT_LABEL"]
    iqr = F.col("q3") - F.col("q1")
    boxes = cut_lineage(wide_summary(lab, cols, {0.25: "q1", 0.5: "median", 0.75: "q3"}, ["DEFAULT_LABEL"]).filter("count > 0").select(
        *g, F.col("count").alias("n"), "min", "q1", "median", "q3", "max",
        (F.col("q1") - 1.5 * iqr).alias("lower_fence"), (F.col("q3") + 1.5 * iqr).alias("upper_fence")))
    # (variables x classes) rows, bounded; one row per class is broadcast to the value rows
    fences = boxes.groupBy("DEFAULT_LABEL").agg(F.map_from_entries(F.collect_list(F.struct("variable", F.struct("lower_fence", "upper_fence")))).alias("_f"))
    sides = []
    for i, c in enumerate(cols):
        x, fence = F.col(c), F.col("_f")[F.lit(c)]
        inside = (x >= fence["lower_fence"]) & (x <= fence["upper_fence"])
        sides += [F.min(F.when(inside, x)).alias(f"lo{i}"), F.max(F.when(inside, x)).alias(f"hi{i}"), F.count_if(~inside).alias(f"out{i}")]
    cut = lab.join(F.broadcast(fences), "DEFAULT_LABEL").groupBy("DEFAULT_LABEL").agg(*sides).select("DEFAULT_LABEL", F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"lo{i}").alias("whisker_lo"), F.col(f"hi{i}").alias("whisker_hi"), F.col(f"out{i}").alias("n_outliers"))
        for i, c in enumerate(cols)])))
    r = lambda c: F.round(c, 4).alias(c)
    return boxes.join(cut, g).select(*g, "n", r("min"), r("q1"), r("median"), r("q3"), r("max"),
                                     r("lower_fence"), r("upper_fence"), r("whisker_lo"), r("whisker_hi"),
                                     "n_outliers").orderBy(*g)
