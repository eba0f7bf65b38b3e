"""Model preparation (M3–M8): population-std scaling, Yeo-Johnson power
transform, log1p, one-hot encoding and the linear / tree preparation stages.

The scaler and the power transform are MLlib ``Estimator`` / ``Model`` pairs
(usable inside ``pyspark.ml.Pipeline`` and persistable); their fit is one or
a few aggregations over the training rows, the fitted values are a handful of
scalars, and transform is plain column arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BILL_COLS, CAT_COLS, FEATURES, NUM_BASE_COLS, PAY_AMT_COLS, PAY_COLS


# --- standard scaling (population std, zero std → scale 1) -------------------------
class _ScalerParams(HasInputCols, HasOutputCols):
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", TypeConverters.toListFloat)


class PopulationStandardScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x − mean) / std with the population std; std 0 leaves the scale at 1."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationStandardScalerModel":
        cols = self.getInputCols()
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        m = PopulationStandardScalerModel()
        m._set(inputCols=cols, outputCols=self.getOutputCols(), means=means, stds=stds)
        return m


class PopulationStandardScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, o, m, s in zip(self.getInputCols(), self.getOutputCols(),
                              self.getOrDefault(self.means), self.getOrDefault(self.stds)):
            exprs[o] = (F.col(c).cast("double") - F.lit(m)) / F.lit(s if s != 0.0 else 1.0)
        return df.withColumns(exprs)


# --- Yeo-Johnson ----------------------------------------------------------------------
# Fixed values of the λ search: first points, largest step, last step, digits of the result.
YJ_CENTRE, YJ_STEP, YJ_SIDE = 1.0, 1.0, 4
YJ_WIDEST, YJ_FINEST, YJ_PLACES = 1024.0, 1e-5, 4
YJ_RESOLVED = 1e-26     # variance over squared mean below which doubles no longer tell values apart


def yeo_johnson(x: Column, lam: Column) -> Column:
    """ψ(x, λ): ((x+1)^λ−1)/λ for x ≥ 0 (log1p at λ=0); −((1−x)^(2−λ)−1)/(2−λ)
    for x < 0 (−log1p(−x) at λ=2)."""
    x = x.cast("double")
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_values(x: np.ndarray, lam: float) -> np.ndarray:
    """ψ(x, λ) of an array."""
    with np.errstate(all="ignore"):
        pos = np.log1p(x) if abs(lam) < 1e-12 else np.expm1(lam * np.log1p(x)) / lam
        neg = -np.log1p(-x) if abs(lam - 2) < 1e-12 else -np.expm1((2 - lam) * np.log1p(-x)) / (2 - lam)
    return np.where(x >= 0, pos, neg)


def yeo_johnson_moments(df: DataFrame, points: dict[str, list[float]], centres: dict[str, float]) -> dict[tuple[str, float], tuple[float, float]]:
    """(mean, variance) of ψ for every (column, λ): each task sums ψ and its square, shifted by ψ of
    the column's mean, for all λ of a batch at once; one row per task and pair, added up by Spark."""
    pairs = [(c, lam) for c, lams in points.items() for lam in lams]
    shifts = [float(yeo_johnson_values(np.array([centres[c]]), lam)[0]) for c, lam in pairs]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(pairs), 3))
        for batch in batches:
            held = {c: x[~np.isnan(x)] for c in points for x in [batch[c].to_numpy(dtype=float)]}
            with np.errstate(all="ignore"):
                for k, (c, lam) in enumerate(pairs):
                    z = yeo_johnson_values(held[c], lam) - shifts[k]
                    sums[k] += len(z), z.sum(), (z * z).sum()
        yield pd.DataFrame({"k": np.arange(len(pairs)), "n": sums[:, 0], "s": sums[:, 1], "q": sums[:, 2]})

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in points]).mapInPandas(partial, "k int, n double, s double, q double")
    out = {}
    for k, n, total, square in parts.groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect():
        if n:
            out[pairs[k]] = (shifts[k] + total / n, square / n - (total / n) ** 2)
    return out


def yeo_johnson_lambdas(df: DataFrame, cols) -> DataFrame:
    """Maximum-likelihood λ per column, to four places.  Output: (variable, lambda).

    llf(λ) = −n/2·ln var ψ + (λ−1)·Σ sign(x)·log1p|x|, so a pass only needs the variance of ψ at
    some λ; no row is repeated per λ.  A pass evaluates nine equidistant λ of every column that is
    still open.  While the best lies at the edge the points move there and widen; else the
    vertex of the parabola through the best three becomes the centre of points that are sixteen times
    closer (and that widen again if the vertex misled).

    λ has no bound.  The likelihood of nearly constant values can rise until doubles no longer tell
    their ψ apart; the last λ before that is the result.  A column without values or with a
    single one has no λ.
    """
    cols = list(cols)
    first = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (
        ("n", F.count), ("a", F.avg), ("l", F.min), ("h", F.max), ("s", lambda x: F.sum(F.signum(x) * F.log1p(F.abs(x)))))]).first()
    stat = {c: {k: first[f"{k}{i}"] for k in "nalhs"} for i, c in enumerate(cols)}
    search = {c: (YJ_CENTRE, YJ_STEP) for c in cols if stat[c]["n"] and stat[c]["l"] < stat[c]["h"]}
    fitted: dict[str, float] = {}
    while search:
        points = {c: [centre + k * step for k in range(-YJ_SIDE, YJ_SIDE + 1)] for c, (centre, step) in search.items()}
        moments = yeo_johnson_moments(df, points, {c: stat[c]["a"] for c in points})
        following = {}
        for c, (_, step) in search.items():
            llf = []
            for lam in points[c]:
                mean, var = moments[c, lam]
                known = math.isfinite(mean) and math.isfinite(var) and var > YJ_RESOLVED * mean * mean
                llf.append(-stat[c]["n"] / 2 * math.log(var) + (lam - 1) * stat[c]["s"] if known else -math.inf)
            k = max(range(len(llf)), key=lambda j: llf[j])
            best = points[c][k]
            fitted[c] = best
            sides = [llf[j] if 0 <= j < len(llf) else None for j in (k - 1, k + 1)]
            if llf[k] == -math.inf or None in sides and step >= YJ_WIDEST:
                continue                                              # nothing is resolved, or it rises for ever
            if None in sides:
                following[c] = (best, 2 * step)
            elif -math.inf in sides:                                  # the edge of what doubles resolve
                if step / YJ_SIDE >= YJ_FINEST:
                    following[c] = (best, step / YJ_SIDE)
            else:
                bend = sides[0] - 2 * llf[k] + sides[1]
                fitted[c] = best + (step * (sides[0] - sides[1]) / (2 * bend) if bend < 0 else 0.0)
                if step > YJ_FINEST * 4 * YJ_SIDE:
                    following[c] = (fitted[c], step / (4 * YJ_SIDE))
        search = following
    return df.sparkSession.createDataFrame([(c, round(fitted[c], YJ_PLACES) + 0.0) for c in cols if c in fitted], "variable string, lambda double")


class _YJParams(HasInputCols, HasOutputCols):
    lambdas = Param(Params._dummy(), "lambdas", "fitted λ per column", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "mean of ψ", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population std of ψ", TypeConverters.toListFloat)


class YeoJohnsonTransformer(Estimator, _YJParams, DefaultParamsReadable, DefaultParamsWritable):
    """Yeo-Johnson with λ by maximum likelihood, then standardized (the power
    transform's default).  A column without a λ keeps its values (λ = 1)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "YeoJohnsonModel":
        cols = self.getInputCols()
        lam_rows = {r["variable"]: float(r["lambda"]) for r in yeo_johnson_lambdas(df, cols).collect()}
        lams = [lam_rows.get(c, 1.0) for c in cols]
        row = df.agg(*[F.avg(yeo_johnson(F.col(c), F.lit(lam))).alias(f"m{i}") for i, (c, lam) in enumerate(zip(cols, lams))],
                     *[F.stddev_pop(yeo_johnson(F.col(c), F.lit(lam))).alias(f"s{i}")
                       for i, (c, lam) in enumerate(zip(cols, lams))]).first()
        m = YeoJohnsonModel()
        m._set(inputCols=cols, outputCols=self.getOutputCols(), lambdas=lams,
               means=[float(row[f"m{i}"] or 0.0) for i in range(len(cols))],
               stds=[float(row[f"s{i}"] or 0.0) for i in range(len(cols))])
        return m


class YeoJohnsonModel(Model, _YJParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c, o, lam, m, s in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.lambdas),
                                   self.getOrDefault(self.means), self.getOrDefault(self.stds)):
            exprs[o] = (yeo_johnson(F.col(c), F.lit(lam)) - F.lit(m)) / F.lit(s if s != 0.0 else 1.0)
        return df.withColumns(exprs)


# --- log1p as a stage -------------------------------------------------------------------
class Log1pTransformer(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """log(1 + x) per column (the function-as-transformer step)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: F.log1p(F.col(c).cast("double"))
                               for c, o in zip(self.getInputCols(), self.getOutputCols())})


# --- one-hot ---------------------------------------------------------------------------------
def one_hot_stages(cols=CAT_COLS) -> list:
    """StringIndexer (alphabetical, unseen kept as index k) + OneHotEncoder
    (dropLast): k slots for k training levels; the unseen bucket is the dropped
    last slot, so an unseen value gives the zero vector."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}__idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"cat__{c}" for c in cols],
                        dropLast=True)
    return [idx, ohe]


def one_hot_long(fitted_indexer, encoded: DataFrame, cols=CAT_COLS, key: str = "ID") -> DataFrame:
    """(ID, feature, level, value) rows from the encoded vectors, named by the
    indexer's learned levels (bounded: one entry per category level)."""
    from pyspark.ml.functions import vector_to_array
    parts = []
    for c, labels in zip(cols, fitted_indexer.labelsArray):
        lv = F.array(*[F.lit(x) for x in labels])
        parts.append(encoded.select(key, F.lit(c).alias("feature"),
                                    F.posexplode(vector_to_array(f"cat__{c}")).alias("pos", "value"))
                     .select(key, "feature", F.element_at(lv, F.col("pos") + 1).alias("level"),
                             F.col("value").cast("int").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- the two preparations ---------------------------------------------------------------------
LINEAR_OUT = ([f"yj__{c}" for c in BILL_COLS] + [f"log__{c}" for c in PAY_AMT_COLS]
              + [f"num__{c}" for c in NUM_BASE_COLS] + PAY_COLS + [f"cat__{c}" for c in CAT_COLS])
TREE_OUT = [f"cat__{c}" for c in CAT_COLS] + [c for c in FEATURES if c not in CAT_COLS]


def linear_preparation() -> list:
    """Yeo-Johnson on bills, log1p on payments, population scaling on 11
    numerics, statuses passed through, one-hot categories → ``features``."""
    return [YeoJohnsonTransformer(inputCols=BILL_COLS, outputCols=[f"yj__{c}" for c in BILL_COLS]),
            Log1pTransformer(inputCols=PAY_AMT_COLS, outputCols=[f"log__{c}" for c in PAY_AMT_COLS]),
            PopulationStandardScaler(inputCols=NUM_BASE_COLS, outputCols=[f"num__{c}" for c in NUM_BASE_COLS]),
            *one_hot_stages(),
            VectorAssembler(inputCols=LINEAR_OUT, outputCol="features", handleInvalid="error")]


def tree_preparation() -> list:
    """One-hot categories, every other feature passed through → ``features``."""
    return [*one_hot_stages(), VectorAssembler(inputCols=TREE_OUT, outputCol="features", handleInvalid="error")]


def preparation(kind: str) -> Pipeline:
    return Pipeline(stages=linear_preparation() if kind == "linear" else tree_preparation())
