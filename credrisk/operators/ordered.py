"""Exact running sums and order statistics without a single-partition window.

A plain ``Window.orderBy(key)`` moves every row into one task.  The plan here
keeps the work spread out and exact:

1. the caller pre-aggregates to one row per distinct key (map-side combine, so
   a key that holds a third of all rows becomes one row);
2. rows are cut into ordered *range buckets* — from ``percentile_approx``
   split points (a bounded sketch) or a caller-supplied monotone bucket column;
3. per-bucket totals (at most groups × buckets rows) get exclusive prefix sums
   in a window over that tiny table and are broadcast back (size bounded by
   construction);
4. a window partitioned by (group, bucket) adds the running sum inside each
   bucket to the bucket's offset.

Every group must be low-cardinality (a label, a variable name); rows within a
group are spread over the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET = "_bucket"


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, 2 * n)


def with_range_bucket(df: DataFrame, key: str, groups: list[str], n_buckets: int) -> DataFrame:
    """Add ``_bucket`` = number of split points strictly below ``key`` (per group).

    Equal keys share a bucket and bucket order follows key order.  Split points
    come from ``percentile_approx``; they only balance the buckets, exactness
    does not depend on them.
    """
    qs = [i / n_buckets for i in range(1, n_buckets)]
    k = F.col(key).cast("double")
    if not groups:
        # at most n_buckets − 1 numbers: collected and inlined as a literal
        row = df.agg(F.array_distinct(F.percentile_approx(k, qs, 10000)).alias("s")).first()
        lits = F.array(*[F.lit(float(v)) for v in (row["s"] or [])]) if row and row["s"] else F.array().cast("array<double>")
        return df.withColumn(BUCKET, F.size(F.filter(lits, lambda s: s < k)))
    # groups x buckets split points: bounded by construction, safe to broadcast
    splits = df.groupBy(*groups).agg(
        F.array_distinct(F.percentile_approx(k, qs, 10000)).alias("_splits"))
    joined = df.join(F.broadcast(splits), groups, "left")
    bucket = F.size(F.filter(F.col("_splits"), lambda s: s < k))
    return joined.withColumn(BUCKET, F.coalesce(bucket, F.lit(0))).drop("_splits")


def running_sums(df: DataFrame, order: list[tuple[str, bool]], values: list[str],
                 groups: list[str] | None = None, bucket: Column | None = None,
                 n_buckets: int | None = None, following: bool = False) -> DataFrame:
    """Append ``cum_<v>`` (inclusive running sum in ``order``) and ``before_<v>``
    (exclusive) for each value column, within each group.  With ``following``
    also ``next_<v>``, the value of the next row in ``order`` (NULL at the end).

    ``order`` is a list of (column, ascending); rows must be unique on
    groups + order columns.  Without ``bucket``, the first order column must be
    numeric and is range-bucketed.
    """
    groups = list(groups or [])
    first, first_asc = order[0]
    if bucket is None:
        df = with_range_bucket(df, first, groups, n_buckets or default_buckets(df))
        if not first_asc:
            df = df.withColumn(BUCKET, -F.col(BUCKET))
    else:
        df = df.withColumn(BUCKET, bucket)

    totals = df.groupBy(*groups, BUCKET).agg(*[F.sum(v).alias(f"_tot_{v}") for v in values])
    # prefix sums over the bucket totals: at most groups x buckets rows
    w_tot = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, BUCKET,
        *[F.coalesce(F.sum(f"_tot_{v}").over(w_tot), F.lit(0)).alias(f"_off_{v}") for v in values])

    out = df.join(F.broadcast(offsets), [*groups, BUCKET], "left")
    sort = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]
    w = (Window.partitionBy(*groups, BUCKET).orderBy(*sort)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep = [c for c in df.columns if c != BUCKET]
    ahead = []
    if following:
        # the first row of every bucket (groups x buckets rows) continues the bucket before it
        by = Window.partitionBy(*groups, BUCKET).orderBy(*sort)
        heads = (df.withColumn("_r", F.row_number().over(by)).filter("_r = 1")
                 .select(*groups, BUCKET, F.struct(*values).alias("_head")))
        after = heads.select(*groups, BUCKET, F.lead("_head").over(Window.partitionBy(*groups).orderBy(BUCKET)).alias("_after"))
        out = out.join(F.broadcast(after), [*groups, BUCKET], "left")
        ahead = [F.coalesce(F.lead(v).over(by), F.col(f"_after.{v}")).alias(f"next_{v}") for v in values]
    return out.select(
        *keep,
        *[(F.col(f"_off_{v}") + F.sum(v).over(w)).alias(f"cum_{v}") for v in values],
        *[(F.col(f"_off_{v}") + F.sum(v).over(w) - F.col(v)).alias(f"before_{v}") for v in values],
        *ahead,
    )


def exact_quantiles(long_df: DataFrame, groups: list[str], value: str, qs: list[float],
                    accuracy: int = 10_000) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / ``quantile_cont``), by selection.

    ``long_df`` holds (groups..., value) rows.  A sketch brackets every quantile between
    two values a few ten-thousandths of the rows apart; one aggregate counts the rows
    below each bracket and takes the nearest value on either side of it; only the
    values inside the brackets are counted per distinct value and ranked with
    :func:`running_sums`.  The sketch only places the brackets: a position outside
    bracket and neighbours would raise.  Output: groups..., q, quantile.
    """
    groups = list(groups)
    rows = long_df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    slack, marks = 2.0 / accuracy, []
    for q in qs:
        marks += [max(0.0, q - slack), min(1.0, q + slack)]
    sketch = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", marks, accuracy).alias("_m"))
    # groups x quantiles brackets: bounded, safe to broadcast
    brackets = cut_lineage(sketch.select(*groups, F.array(*[
        F.struct(F.lit(float(q)).alias("q"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("pos"),
                 F.col("_m")[2 * i].alias("lo"), F.col("_m")[2 * i + 1].alias("hi")) for i, q in enumerate(qs)]).alias("_b")))
    placed = rows.select(*groups, "_v").join(F.broadcast(brackets), groups)
    v, sides = F.col("_v"), []
    for i in range(len(qs)):
        b = F.col("_b")[i]
        sides += [F.first(b).alias(f"b{i}"), F.count_if(v < b["lo"]).alias(f"n{i}"), F.max(F.when(v < b["lo"], v)).alias(f"p{i}"),
                  F.min(F.when(v > b["hi"], v)).alias(f"x{i}")]
    around = placed.groupBy(*groups).agg(*sides).select(*groups, F.inline(F.array(*[
        F.struct(F.col(f"b{i}")["q"].alias("q"), F.col(f"b{i}")["pos"].alias("_pos"), F.col(f"n{i}").alias("_below"),
                 F.col(f"p{i}").alias("_prev"), F.col(f"x{i}").alias("_next")) for i in range(len(qs))])))
    inside = placed.select(*groups, "_v", F.explode(F.filter("_b", lambda b: (v >= b["lo"]) & (v <= b["hi"]))).alias("_in"))
    counted = cut_lineage(inside.groupBy(*groups, F.col("_in.q").alias("q"), "_v").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_sums(counted, [("_v", True)], ["_n"], groups=[*groups, "q"])
    lo = F.floor("_pos").cast("long")

    def held(at):  # order statistic i (0-based) is the value with before <= i < cum
        return F.max(F.when((F.col("_below") + F.col("before__n") <= at) & (at < F.col("_below") + F.col("cum__n")), v))

    found = (ranked.join(F.broadcast(cut_lineage(around)), [*groups, "q"])
             .groupBy(*groups, "q", "_pos", "_below", "_prev", "_next")
             .agg(F.sum("_n").alias("_inside"), held(lo).alias("_xlo"), held(lo + 1).alias("_xhi")))

    def taken(x, at):
        return (F.when(x.isNotNull(), x).when(at == F.col("_below") - 1, F.col("_prev"))
                .when(at == F.col("_below") + F.col("_inside"), F.col("_next"))
                .otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double")))

    frac = F.col("_pos") - lo
    low = taken(F.col("_xlo"), lo)
    high = F.when(frac > 0, taken(F.col("_xhi"), lo + 1)).otherwise(low)
    return found.select(*groups, "q", (low + frac * (high - low)).alias("quantile"))


def quantile_columns(qdf: DataFrame, groups: list[str], names: dict[float, str]) -> DataFrame:
    """Pivot the (groups, q, quantile) output to one column per quantile."""
    return qdf.groupBy(*groups).agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in names.items()])


STATS = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def wide_summary(df: DataFrame, cols: list[str], qs: dict[float, str], groups: list[str] | None = None,
                 accuracy: int = 10_000, most: int = 200_000) -> DataFrame:
    """count, mean, sample std, min, max and exact quantiles (linear interpolation) of many columns:
    one row per group and column, in two scans of ``df`` that never stack its columns.

    The first scan takes all moments and a sketch of every column.  A sketch has a proven rank error,
    so the values strictly between its two marks around a quantile are a few ten-thousandths of the
    rows; the second scan counts what lies below and on the marks and gathers what lies between them.
    That is at most ``most`` values in all, known after the first scan; beyond it the quantiles
    come from :func:`exact_quantiles`, which ranks them on many tasks.
    """
    cols, groups = list(cols), list(groups or [])
    slack, number = 2.0 / accuracy, {i: F.col(c).cast("double") for i, c in enumerate(cols)}
    marks = [min(1.0, max(0.0, q + side)) for q in qs for side in (-slack, slack)]
    first = df.groupBy(*groups).agg(*[f(x).alias(f"{k}{i}") for i, x in number.items() for k, f in STATS.items()],
                                    *[F.percentile_approx(x, marks, accuracy).alias(f"m{i}") for i, x in number.items()])
    first = cut_lineage(first)  # one row per group
    basic = first.select(*groups, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{k}{i}").alias(k) for k in STATS])
                                                     for i, c in enumerate(cols)])))
    between = first.agg(F.sum(sum(F.col(f"count{i}") for i in number))).first()[0] or 0
    if between * 6 * slack * len(qs) > most:
        stacked = df.select(*groups, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), number[i].alias("value")) for i, c in enumerate(cols)])))
        q = quantile_columns(exact_quantiles(stacked, [*groups, "variable"], "value", list(qs)), [*groups, "variable"], qs)
        return basic.join(q, [*groups, "variable"], "left")
    rows = first.select(*groups, *[c for i in number for c in (f"count{i}", f"m{i}")]).collect()     # one row per group
    placed = {tuple(r[g] for g in groups): [(r[f"count{i}"], r[f"m{i}"] or []) for i in number] for r in rows}
    schema = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups] + ["variable string"] + [f"`{name}` double" for name in qs.values()])
    sides = _around_marks(df, groups, cols, {key: [m for _, m in columns] for key, columns in placed.items()}, len(qs))
    found = [(*key, c, *[_interpolated(n, q, marks[2 * j:2 * j + 2], sides.get((key, i, j))) if n else None for j, q in enumerate(qs)])
             for key, columns in placed.items() for i, (c, (n, marks)) in enumerate(zip(cols, columns))]
    return basic.join(F.broadcast(df.sparkSession.createDataFrame(found, schema)), [*groups, "variable"], "left")


def _around_marks(df: DataFrame, groups: list[str], cols: list[str], marks: dict[tuple, list[list[float]]], n: int) -> dict[tuple, tuple]:
    """(group, column, quantile) → values below the lower mark, the largest of them, values on it, the sorted values
    between the marks, values on the upper mark, the smallest above it.  One row per task and entry, added up by Spark."""
    keys = list(marks)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for k, key in enumerate(keys):
                part = batch[np.logical_and.reduce([batch[g] == v for g, v in zip(groups, key)])] if groups else batch
                for i, column in enumerate(marks[key]):
                    x = part[f"c{i}"].to_numpy(dtype=float)
                    x = x[~np.isnan(x)]
                    for j in range(n if column else 0):
                        lo, hi = column[2 * j], column[2 * j + 1]
                        low, high = x < lo, x > hi
                        t = total.setdefault((k, i, j), [0, -np.inf, 0, [], 0, np.inf])
                        t[0] += int(low.sum())
                        t[1] = max(t[1], x[low].max(initial=-np.inf))
                        t[2] += int((x == lo).sum())
                        t[3] += x[(x > lo) & (x < hi)].tolist()
                        t[4] += int((x == hi).sum()) if hi > lo else 0
                        t[5] = min(t[5], x[high].min(initial=np.inf))
        yield pd.DataFrame([(*at, *t) for at, t in total.items()], columns=["k", "i", "j", "below", "prev", "low", "inside", "high", "next"])

    taken = df.select(*groups, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(
        partial, "k int, i int, j int, below long, prev double, low long, inside array<double>, high long, next double")
    added = taken.groupBy("k", "i", "j").agg(F.sum("below"), F.max("prev"), F.sum("low"), F.array_sort(F.flatten(F.collect_list("inside"))),
                                             F.sum("high"), F.min("next"))
    return {(keys[r[0]], r[1], r[2]): tuple(r[3:]) for r in added.collect()}


def _interpolated(n: int, q: float, marks: list[float], around: tuple) -> float:
    """The quantile of n values from what lies around the marks; raises if the marks do not hold it."""
    below, before, low, inside, high, after = around
    lo, hi = marks

    def at(k: int) -> float:
        if k == below - 1:
            return before
        for size, values in ((low, lo), (len(inside), inside), (high, hi), (1, after)):
            if below <= k < below + size:
                return values[k - below] if values is inside else values
            k -= size
        raise ValueError("quantile outside its bracket")
    position = q * (n - 1)
    k = int(position)
    first = at(k)
    return first if position == k else first + (position - k) * (at(k + 1) - first)
