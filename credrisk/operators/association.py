"""Pearson correlations, correlation with the target and significance
(A15–A17, P15, P21, T2, T3)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi_square_p, t_test_p
from ..schema import TARGET


def pair_stats(df: DataFrame, cols, target: str | None = None) -> DataFrame:
    """Pairwise-complete Pearson r for column pairs, as (x, y, r, n).

    The row's values go into one array; ``posexplode`` + ``sequence`` emit one
    (i, j, x, y) row per pair, and a grouped aggregate (partial, map-side; the
    shuffle carries one row per pair and task) computes ``covar_pop`` and
    ``stddev_pop``.  The plan stays small however many pairs there are.  With
    ``target`` only the pairs (column, target) are formed.  A constant side
    gives NULL, not an error.
    """
    cols = list(cols)
    names = F.array(*[F.lit(c) for c in cols])
    vals = F.array(*[F.col(c).cast("double") for c in cols])
    if target is None:
        base = df.select(vals.alias("_v")).select(F.posexplode("_v").alias("i", "x"), "_v")
        pairs = base.select("i", "x", "_v", F.explode(F.sequence(F.col("i"), F.lit(len(cols) - 1))).alias("j"))
        pairs = pairs.select("i", "j", "x", F.element_at("_v", F.col("j") + 1).alias("y"))
    else:
        base = df.select(vals.alias("_v"), F.col(target).cast("double").alias("y"))
        pairs = base.select(F.posexplode("_v").alias("i", "x"), "y").withColumn("j", F.lit(-1))
    # masks live inside the aggregates (no Filter above the generator): a
    # filter there makes constraint inference walk every inlined feature alias
    x, y = F.col("x"), F.col("y")
    both = x.isNotNull() & y.isNotNull()
    stats = (pairs.groupBy("i", "j")
             .agg(F.covar_pop(x, y).alias("_cov"),
                  (F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))).alias("_den"),
                  F.count(F.when(both, 1)).alias("n")))
    r = F.col("_cov") / F.nullif(F.col("_den"), F.lit(0.0))
    x = F.element_at(names, F.col("i") + 1)
    y = F.lit(target) if target is not None else F.element_at(names, F.col("j") + 1)
    return stats.select(x.alias("x"), y.alias("y"), r.alias("r"), "n")


def gramian(df: DataFrame, cols, shift: list[float]) -> np.ndarray:
    """AᵀA of A = [x·m, x²·m, m] with x the shifted values and m the not-NULL mask: one matrix
    product per batch in the workers, one row per task, summed entry by entry."""
    d, base = len(cols), np.array(shift)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3 * d, 3 * d))
        for batch in batches:
            raw = batch.to_numpy(dtype=float)
            mask = ~np.isnan(raw)
            x = np.where(mask, raw - base, 0.0)
            a = np.hstack([x, x * x, mask.astype(float)])
            total += a.T @ a
        yield pd.DataFrame({"g": [total.ravel()]})

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(partial, "g array<double>")
    entries = parts.select(F.posexplode("g").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(9 * d * d)
    for k, v in entries:
        out[k] = v
    return out.reshape(3 * d, 3 * d)


def corr_matrix(df: DataFrame, cols, places: int = 6) -> DataFrame:
    """Full pairwise-complete matrix as (x, y, r, n); a constant side gives NULL.

    One path whether or not values are NULL (NaN counts as NULL): the Gramian of
    values, squares and masks holds every pair's n, Σx, Σx² and Σxy over the rows where both
    sides are present.  Its size depends on the column count only.  Values are shifted by the
    column mean (a constant column by its value), which keeps the sums well conditioned.
    """
    cols = list(cols)
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(cols)
                   for k, f in (("a", F.avg), ("l", F.min), ("h", F.max))]).first()
    shift = [float(row[f"l{i}"] if row[f"l{i}"] == row[f"h{i}"] else row[f"a{i}"]) if row[f"a{i}"] is not None else 0.0
             for i in range(len(cols))]
    g, d = gramian(df, cols, shift), len(cols)
    n, sx, sxx, sxy = g[2 * d:, 2 * d:], g[:d, 2 * d:], g[d:2 * d, 2 * d:], g[:d, :d]
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            m = n[i, j]
            vx, vy = (sxx[i, j] - sx[i, j] ** 2 / m, sxx[j, i] - sx[j, i] ** 2 / m) if m else (0.0, 0.0)
            r = (sxy[i, j] - sx[i, j] * sx[j, i] / m) / math.sqrt(vx * vy) if vx > 0 and vy > 0 else None
            rows.append((a, b, None if r is None else round(float(r), places) + 0.0, int(m)))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, n long")


def corr_with_target(df: DataFrame, cols, target: str = TARGET, descending: bool = False) -> DataFrame:
    """r of each column with the target (self-row dropped), ordered by |r|,
    with the direction of the association."""
    feats = [c for c in cols if c != target]
    out = pair_stats(df, feats, target).select(
        F.col("x").alias("feature"), F.round("r", 6).alias("r"), "n")
    out = out.withColumn("direction", F.when(F.col("r") > 0, "raises risk").otherwise("lowers risk"))
    key = F.abs("r")
    return out.orderBy(key.desc() if descending else key.asc(), "feature")


def corr_significance(corr: DataFrame, level: float = 0.05) -> DataFrame:
    """t = r·sqrt((n−2)/(1−r²)) per correlation, its two-sided p-value with n − 2 degrees of
    freedom, and whether that is below ``level``.  A perfect correlation has no t and p = 0; a
    constant column and fewer than three rows have neither."""
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    p = F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(t_test_p(t, n - 2)))
    return corr.select("feature", "r", "n", F.round(t, 4).alias("t_stat"), p.alias("p")).select(
        "feature", "r", "n", "t_stat", F.round("p", 6).alias("p_value"), (F.col("p") < level).alias("significant"))


def top_associations(corr: DataFrame, k: int) -> DataFrame:
    """The k features with the largest |r| with the target (a top-k report)."""
    return corr.orderBy(F.abs("r").desc(), "feature").limit(k).select(
        "feature", "r", F.round(F.abs("r"), 6).alias("abs_r"))


def chi_square(df: DataFrame, cols, target: str = TARGET, places: int = 6) -> DataFrame:
    """Pearson χ² of independence between each categorical column and the
    target: Σ (O − E)² / E over the observed contingency cells (rows with a
    missing side dropped), with dof = (levels − 1)·(classes − 1) and its p-value.

    One partially aggregated count per (column, level, class); the marginals
    come from that small table, never from the raw rows again.
    """
    long = df.select(F.col(target).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols])))
    cells = (long.filter(F.col("level").isNotNull() & F.col("_y").isNotNull())
             .groupBy("feature", "level", "_y").agg(F.count(F.lit(1)).alias("o")))
    rows = cells.groupBy("feature", "level").agg(F.sum("o").alias("r"))
    classes = cells.groupBy("feature", "_y").agg(F.sum("o").alias("c"))
    total = cells.groupBy("feature").agg(F.sum("o").alias("n"), F.countDistinct("level").alias("k"),
                                         F.countDistinct("_y").alias("m"))
    # every (level, class) pair, observed or not, contributes (O − E)² / E
    grid = rows.join(classes, "feature").join(total, "feature").join(cells, ["feature", "level", "_y"], "left")
    e = F.col("r") * F.col("c") / F.col("n").cast("double")
    o = F.coalesce(F.col("o"), F.lit(0)).cast("double")
    return (grid.groupBy("feature").agg(F.sum((o - e) * (o - e) / e).alias("_chi"),
                                        F.first("k").alias("k"), F.first("m").alias("m"))
            .select("feature", "_chi", ((F.col("k") - 1) * (F.col("m") - 1)).cast("int").alias("dof"))
            .select("feature", F.round("_chi", places).alias("statistic"), "dof", F.round(chi_square_p(F.col("_chi"), F.col("dof")), places).alias("p_value")))
