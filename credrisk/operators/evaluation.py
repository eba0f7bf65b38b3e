"""Evaluation of (label, score) DataFrames: confusion matrices, metrics, exact
ROC-AUC and ROC / precision-recall curves (E1–E8, E11–E13, T7).

Curves and AUC need running sums in score order.  Scores are first counted
per distinct value (map-side combine), then ranked with
:func:`credrisk.operators.ordered.running_sums`, so no step moves all rows or
all distinct scores into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums

EPS = 1e-15


def _div0(n: Column, d: Column) -> Column:
    """n / d, 0 when d is 0 (the zero-division rule of the metrics)."""
    return F.coalesce(n.cast("double") / F.nullif(d, F.lit(0)).cast("double"), F.lit(0.0))


def confusion_counts(pred: DataFrame, thresholds, label: str = "label", score: str = "score",
                     by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp per threshold (and per ``by`` group) in one aggregation."""
    by = list(by or [])
    y = F.col(label)
    aggs = []
    for i, t in enumerate(thresholds):
        p = F.col(score) >= t
        aggs += [F.count_if((y == 0) & ~p).alias(f"tn{i}"), F.count_if((y == 0) & p).alias(f"fp{i}"),
                 F.count_if((y == 1) & ~p).alias(f"fn{i}"), F.count_if((y == 1) & p).alias(f"tp{i}")]
    one = pred.groupBy(*by).agg(*aggs)
    rows = [F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{k}{i}").alias(k) for k in ("tn", "fp", "fn", "tp")])
            for i, t in enumerate(thresholds)]
    return one.select(*by, F.inline(F.array(*rows)))


def metrics_from_counts(cm: DataFrame, places: int = 4) -> DataFrame:
    """accuracy, precision, recall, F1 from tn/fp/fn/tp (zero denominators → 0)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    return cm.withColumns({
        "accuracy": F.round(_div0(tp + tn, tn + fp + fn + tp), places),
        "precision": F.round(prec, places),
        "recall": F.round(rec, places),
        "f1": F.round(f1, places),
    })


def score_counts(pred: DataFrame, label: str = "label", score: str = "score",
                 by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score (per group)."""
    by = list(by or [])
    y = F.col(label)
    return (pred.filter(F.col(score).isNotNull() & y.isNotNull())
            .groupBy(*by, score)
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def _attach_totals(r: DataFrame, tot: DataFrame, keys: list[str], out: list[str]) -> DataFrame:
    """Per-group totals beside each ranked row: a broadcast hash join on the
    group keys (one row per group), or two literals when there is no group."""
    if out:
        return r.join(F.broadcast(tot), keys, "inner")
    row = tot.first()
    return r.withColumns({c: F.lit(int(row[c]) if row and row[c] is not None else 0).cast("long")
                          for c in tot.columns if c not in keys})


def _ranked_desc(pred: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    sc = score_counts(pred, label, score, keys)
    return running_sums(sc.withColumnRenamed(score, "score"), [("score", False)], ["pos", "neg"],
                        groups=keys)


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score",
            by: list[str] | None = None, places: int = 6) -> DataFrame:
    """Area under the ROC curve with ties counted ½; NULL for one class only.

    Σ over distinct scores of neg·(positives above + ½ positives tied) / (P·N).
    """
    keys = out = list(by or [])
    r = _ranked_desc(pred, label, score, keys)
    agg = r.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2.0)).alias("_u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.col("_u") / F.nullif(F.col("P") * F.col("N"), F.lit(0)).cast("double")
    return agg.select(*out, F.round(auc, places).alias("auc"), F.col("P").alias("n_pos"),
                      F.col("N").alias("n_neg"))


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score",
              by: list[str] | None = None, places: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, descending, plus the starting
    point (NULL threshold, 0, 0).  A point is left out if the curve goes straight
    on through it: the next score adds as many positives and negatives."""
    keys = out = list(by or [])
    r = running_sums(score_counts(pred, label, score, keys).withColumnRenamed(score, "score"), [("score", False)],
                     ["pos", "neg"], groups=keys, following=True)
    first = (F.col("before_pos") + F.col("before_neg")) == 0
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    # one total row per group: bounded by the (low-cardinality) groups
    tot = r.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = _attach_totals(r, tot, keys, out).filter(first | F.col("next_pos").isNull() | bend)
    body = pts.select(*out, F.col("score").alias("threshold"),
                      F.round(_div0(F.col("cum_neg"), F.col("N")), places).alias("fpr"),
                      F.round(_div0(F.col("cum_pos"), F.col("P")), places).alias("tpr"))
    start = tot.select(*out, F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return body.unionByName(start)


def pr_curve(pred: DataFrame, label: str = "label", score: str = "score",
             by: list[str] | None = None, places: int = 6) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the closing point
    (NULL, 1, 0)."""
    keys = out = list(by or [])
    r = _ranked_desc(pred, label, score, keys)
    tot = r.groupBy(*keys).agg(F.sum("pos").alias("P"))
    pts = _attach_totals(r, tot, keys, out)
    body = pts.select(*out, F.col("score").alias("threshold"),
                      F.round(_div0(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), places).alias("precision"),
                      F.round(_div0(F.col("cum_pos"), F.col("P")), places).alias("recall"))
    close = tot.select(*out, F.lit(None).cast("double").alias("threshold"),
                       F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(close)


def thinned(curve: DataFrame, order: str, along: str, across: str, slices: int, by: list[str] | None = None) -> DataFrame:
    """At most ``4 * slices`` + 4 points of a curve per group, in the same columns.

    ``along`` runs from 0 to 1 without turning back in the sense of ``order`` (of ties any).  In each of
    ``slices`` equal parts of it the first and the last point stay, and those of the smallest and largest
    ``across``.  So every point that goes lies within 1 / ``slices`` of a kept one along the curve, and
    across it between two kept ones.  One partial aggregate; no group of points is gathered.
    """
    by = list(by or [])
    part = F.least(F.floor(F.col(along) * slices), F.lit(slices)).cast("int")
    point = F.struct(*curve.columns)
    kept = curve.groupBy(*by, part.alias("_part")).agg(
        F.min_by(point, F.struct(order, across)).alias("a"), F.max_by(point, F.struct(order, across)).alias("b"),
        F.min_by(point, F.struct(across, order)).alias("c"), F.max_by(point, F.struct(across, order)).alias("d"))
    return kept.select(F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("p")).select("p.*")


def log_loss(pred: DataFrame, label: str = "label", score: str = "score", places: int = 6) -> DataFrame:
    """Mean binary cross-entropy with p clipped to [1e-15, 1 − 1e-15]."""
    p = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), F.col(score)))
    y = F.col(label).cast("double")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return pred.agg(F.round(F.avg(ll), places).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def majority_baseline(pred: DataFrame, label: str = "label") -> DataFrame:
    """Always predicting class 0: accuracy = share of class 0, recall 0."""
    cm = pred.agg(F.count_if(F.col(label) == 0).alias("tn"), F.lit(0).cast("long").alias("fp"),
                  F.count_if(F.col(label) == 1).alias("fn"), F.lit(0).cast("long").alias("tp"))
    return metrics_from_counts(cm)
