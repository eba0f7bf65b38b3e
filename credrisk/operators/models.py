"""Model training, tuning, scoring and importances on MLlib (C1–C13, L1–L9,
E10, M10–M12).

Fits are MLlib jobs (tree aggregation on the executors) or the histogram boosting of
:mod:`credrisk.operators.boosting`, which grows all fits of a search together; independent
fits run from a thread pool, so that their jobs share the executors.
"""

from __future__ import annotations

import itertools
import random
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import (CAT_COLS, GROUP_BASELINE, GROUP_IMBALANCE, GROUP_TUNED, N_FOLDS, SEED, SMOTE_RATIO,
                      THRESHOLD_BASELINE, THRESHOLD_REBALANCED)
from ..session import cut_lineage
from .boosting import TASK_ROWS, BoostedTreesModel, Fit, boost
from .forest import fit_forest
from .prep import linear_preparation, preparation, tree_preparation
from .smote import InfeasibleRatio, class_sizes, knn_lists, smote, synthetic_rows

# Estimator settings of the thirteen configurations.
FOREST_TREES = 200
FOREST_MAX_DEPTH = 30          # MLlib allows no more; the reference leaves it unlimited
MLLIB_FOREST_ROWS = 1 << 14    # MLlib holds all nodes in the driver; a forest of more rows grows in tasks, as do boosted trees,
MLLIB_BINS = 32                # which take MLlib several short jobs each that wait for the other models' tasks
GBT_DEFAULT = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
XGB_BASELINE = {"trees": 300, "rate": 0.05, "depth": 5, "rows": 0.8, "columns": 0.8}
# the boosting library's own defaults (100 rounds, depth 6, rate 0.3)
XGB_DEFAULT = {"trees": 100, "depth": 6, "rate": 0.3}
TREE_DEPTH = 6
LR_MAX_ITER = 1000
# Random-search spaces, in the reference's list order.  Settings are named as in
# :class:`credrisk.operators.boosting.Fit`; smote_ratio is the minority / majority ratio.
SMOTE_SEARCH = {"smote_ratio": [0.3, 0.4, 0.5, 0.6, 0.8, 0.9],
                "trees": [50, 100, 200, 300, 500, 800],
                "depth": [2, 3, 4, 6],
                "rate": [0.01, 0.05, 0.02, 0.03, 0.1],
                "rows": [0.5, 0.6, 0.7, 0.8],
                "columns": [0.7, 0.8, 0.5, 0.6, 0.9, 1.0]}
WEIGHT_SEARCH = {"trees": [100, 200, 300],
                 "depth": [3, 5, 7],
                 "rate": [0.01, 0.05, 0.1],
                 "rows": [0.7, 0.8, 1.0],
                 "columns": [0.7, 0.8, 1.0],
                 "gamma": [0.0, 1.0, 5.0]}
SEARCH_DRAWS = 20


@dataclass
class Config:
    name: str
    group: str
    prep: str                     # 'linear' | 'tree'
    algo: str                     # 'lr' | 'dt' | 'rf' | 'gbt' | 'boost'
    rebalance: str = "none"       # 'none' | 'smote' | 'balanced' | 'spw'
    threshold: float = THRESHOLD_BASELINE
    params: dict = field(default_factory=dict)
    search: dict | None = None


CONFIGS = [
    Config("Logistic Regression", GROUP_BASELINE, "linear", "lr"),
    Config("Decision Tree", GROUP_BASELINE, "tree", "dt"),
    Config("Random Forest", GROUP_BASELINE, "tree", "rf"),
    Config("Gradient Boosting", GROUP_BASELINE, "tree", "gbt", params=GBT_DEFAULT),
    Config("XGBoost", GROUP_BASELINE, "tree", "boost", params=XGB_BASELINE),
    Config("SMOTE Logistic Regression", GROUP_IMBALANCE, "linear", "lr", "smote", THRESHOLD_REBALANCED),
    Config("SMOTE Random Forest", GROUP_IMBALANCE, "tree", "rf", "smote", THRESHOLD_REBALANCED),
    Config("SMOTE XGBoost", GROUP_IMBALANCE, "tree", "boost", "smote", THRESHOLD_REBALANCED, XGB_DEFAULT),
    Config("Weight Logistic Regression", GROUP_IMBALANCE, "linear", "lr", "balanced", THRESHOLD_REBALANCED),
    Config("Weight Random Forest", GROUP_IMBALANCE, "tree", "rf", "balanced", THRESHOLD_REBALANCED),
    Config("Weight XGBoost", GROUP_IMBALANCE, "tree", "boost", "spw", THRESHOLD_REBALANCED, XGB_DEFAULT),
    Config("Tuned SMOTE XGBoost", GROUP_TUNED, "tree", "boost", "smote", THRESHOLD_REBALANCED, XGB_DEFAULT,
           SMOTE_SEARCH),
    Config("Tuned Weight XGBoost", GROUP_TUNED, "tree", "boost", "spw", THRESHOLD_REBALANCED, XGB_DEFAULT,
           WEIGHT_SEARCH),
]


def classifier(algo: str, params: dict | None = None, weighted: bool = False, total: float | None = None):
    """An unfitted classifier for rows of summed weight ``total``.

    L2 with C = 1 on the summed loss equals regParam = 1 / Σw on the mean loss.
    """
    params = dict(params or {})
    w = {"weightCol": "weight"} if weighted else {}
    if algo == "lr":
        return LogisticRegression(maxIter=LR_MAX_ITER, regParam=1.0 / total if total else 0.0, elasticNetParam=0.0,
                                  standardization=False, **w)
    if algo == "dt":
        return DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, **w)
    if algo == "rf":
        return RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=FOREST_MAX_DEPTH, seed=SEED, **w)
    if algo == "gbt":
        return GBTClassifier(seed=SEED, **params, **w)
    raise ValueError(algo)


def is_weighted(config: Config) -> bool:
    return config.rebalance in ("balanced", "spw")


def add_weights(train: DataFrame, mode: str) -> DataFrame:
    """'balanced': n / (2·n_class); 'spw': n0/n1 on the positive class, else 1.
    Class counts are a two-row aggregate (collected scalars)."""
    counts = {int(r["label"]): int(r["n"]) for r in
              train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if mode == "balanced":
        n = n0 + n1
        w0, w1 = (n / (2.0 * n0) if n0 else 0.0), (n / (2.0 * n1) if n1 else 0.0)
    else:
        w0, w1 = 1.0, (n0 / n1 if n1 else 1.0)
    return train.withColumn("weight", F.when(F.col("label") == 1, F.lit(w1)).otherwise(F.lit(w0)))


def resampled(rows: DataFrame, ratio: float, lists: DataFrame | None = None) -> DataFrame:
    """SMOTE output as a written table: MLlib passes over its input several times."""
    return cut_lineage(smote(rows.select("ID", "features", "label"), ratio, lists=lists))


def fit_rows(config: Config, rows: DataFrame, params: dict | None = None):
    """Fit the configuration's classifier on prepared rows as they will be seen: already
    resampled, or (ID, features, label) that get their weights here."""
    rows = add_weights(rows, config.rebalance) if is_weighted(config) else rows
    if config.algo == "boost":
        weight = F.col("weight") if is_weighted(config) else F.lit(1.0)
        (trees, _), cuts = boost(sampled_rows(rows, [weight]), [Fit(0, **{**config.params, **(params or {})})])
        return BoostedTreesModel.of(trees[0], cuts)
    if config.algo == "gbt" and MLLIB_FOREST_ROWS < rows.count() <= TASK_ROWS:
        weight, settings = F.col("weight") if is_weighted(config) else F.lit(1.0), {**config.params, **(params or {})}
        fit = Fit(0, trees=settings["maxIter"], depth=settings["maxDepth"], rate=settings["stepSize"], squares=True)
        (trees, _), cuts = boost(sampled_rows(rows, [weight]), [fit], max_bins=MLLIB_BINS)
        return BoostedTreesModel.of(trees[0], cuts, squares=True)
    if config.algo == "rf" and rows.count() > MLLIB_FOREST_ROWS:
        weight = F.col("weight") if is_weighted(config) else F.lit(1.0)
        return fit_forest(sampled_rows(rows, [weight]), FOREST_TREES, FOREST_MAX_DEPTH)
    total = rows.agg(F.sum("weight") if is_weighted(config) else F.count(F.lit(1)).cast("double")).first()[0]
    return classifier(config.algo, {**config.params, **(params or {})}, is_weighted(config), total).fit(rows)


class RebalancedClassifier(Estimator):
    """A configuration's classifier as a pipeline stage: resampling and weights apply to the
    rows given to ``fit`` only; the returned model never resamples."""

    ratio = Param(Params._dummy(), "ratio", "minority / majority after resampling", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, config=None, ratio=SMOTE_RATIO):
        super().__init__()
        self._config = config
        self._setDefault(ratio=SMOTE_RATIO)
        self._set(ratio=ratio)

    def _fit(self, df: DataFrame):
        rows = df.select("ID", "features", "label")
        return fit_rows(self._config, resampled(rows, self.getOrDefault(self.ratio)) if self._config.rebalance == "smote" else rows)


def build(config: Config) -> Pipeline:
    """Preparation, train-only rebalancing and classifier of one configuration."""
    stages = linear_preparation() if config.prep == "linear" else tree_preparation()
    return Pipeline(stages=[*stages, RebalancedClassifier(config=config)])


def with_probability(pred: DataFrame, out: str = "score") -> DataFrame:
    """Probability of class 1 from MLlib's probability vector."""
    return pred.withColumn(out, vector_to_array("probability")[1])


def fit(config: Config, train: DataFrame) -> PipelineModel:
    """Fit one configuration on the training rows (ID, 32 features, label)."""
    return build(config).fit(train)


def predictions(model: PipelineModel, df: DataFrame, config: Config) -> DataFrame:
    """(ID, label, score, prediction at the configuration's threshold)."""
    p = with_probability(model.transform(df))
    return p.select("ID", "label", "score", (F.col("score") >= config.threshold).cast("int").alias("prediction"))


# --- randomized search ----------------------------------------------------------------
def sample_param_maps(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """n distinct draws from the cartesian product, seeded (without replacement)."""
    keys = sorted(space)
    combos = list(itertools.product(*[space[k] for k in keys]))
    rng = random.Random(seed)
    picks = rng.sample(range(len(combos)), min(n, len(combos)))
    return [dict(zip(keys, combos[i])) for i in picks]


def in_parallel(job: Callable, items: list, threads: int) -> list:
    """Run ``job`` for every item from a thread pool, in this session.

    If the caller is interrupted or a job fails, running Spark jobs of the pool are
    cancelled and no further item is begun.
    """
    context, group, stopped = SparkContext.getOrCreate(), uuid.uuid4().hex, threading.Event()

    def one(item):
        if stopped.is_set():
            return None
        context.setJobGroup(group, "parallel fits", interruptOnCancel=True)
        return job(item)

    pool = ThreadPool(max(1, min(threads, len(items))))
    try:
        return pool.map(inheritable_thread_target(one), items, chunksize=1)
    except BaseException:
        stopped.set()
        context.cancelJobGroup(group)
        raise
    finally:
        pool.close()


def sampled_rows(rows: DataFrame, weights: list) -> DataFrame:
    """Prepared rows (ID, features, label) as the boosting takes them, with a weight per sample.  The
    id follows from the row itself, so what is drawn does not depend on the layout."""
    x = vector_to_array("features")
    return rows.select(F.xxhash64("ID", x).alias("id"), x.alias("x"), "label", F.array(*[w.cast("float") for w in weights]).alias("weights"))


def search_rows(config: Config, rows: DataFrame, n_folds: int, ratios: list[float], threads: int):
    """Rows (ID, features, label, fold) with their weight in every sample of a search, and the samples as
    {(fold, ratio): number}; fold None is all rows, a ratio that is not above its fold's current one has
    no sample.  Neighbours and synthetic rows are made once per fold, for its largest ratio."""
    folds = [None, *range(n_folds)]
    part = {f: rows if f is None else rows.filter(F.col("fold") != f) for f in folds}
    if config.rebalance != "smote":
        n_pos, n_neg = class_sizes(rows)
        weight = F.when(F.col("label") == 1, n_neg / max(1, n_pos)).otherwise(1.0)
        return sampled_rows(rows, [weight if f is None else F.when(F.col("fold") == f, -1.0).otherwise(weight) for f in folds]), {
            (f, None): k for k, f in enumerate(folds)}
    sizes = dict(zip(folds, in_parallel(lambda f: class_sizes(part[f]), folds, threads)))
    wanted = {(f, r): int(r * sizes[f][1]) - sizes[f][0] for f in folds for r in ratios}
    samples = {fr: k for k, fr in enumerate(fr for fr, n in wanted.items() if n > 0 and sizes[fr[0]][0])}
    original = sampled_rows(rows, [F.lit(1.0) if f is None else F.when(F.col("fold") == f, -1.0).otherwise(1.0) for f, _ in samples])

    def oversampled(f):
        minority = part[f].filter("label = 1").select("ID", "features")
        most = max(wanted[f, r] for r in ratios)
        new = synthetic_rows(minority, sizes[f][0], most, knn_lists(minority))
        return cut_lineage(sampled_rows(new.withColumn("label", F.lit(1.0)), [
            F.when(F.col("number") <= wanted[g, r], 1.0).otherwise(0.0) if g == f else F.lit(0.0) for g, r in samples]))

    every = original
    for new in in_parallel(oversampled, [f for f in folds if any((f, r) in samples for r in ratios)], threads):
        every = every.unionByName(new)
    return every, samples


def random_search(config: Config, train: DataFrame, n_draws: int = SEARCH_DRAWS, n_folds: int = N_FOLDS,
                  threads: int = 8, draws: list | None = None, block_rows: int | None = None):
    """Randomized search over stratified folds (``fold`` column), scored by positive-class F1
    at 0.5.  SMOTE draws resample inside each training fold only; a draw whose ratio is not
    above the fold's current one scores 0 there.

    All draws grow together on all folds, and on all training rows, so that the best draw's final
    model is at hand.  Returns (model of all training rows, best parameters, [(parameters, mean F1)]).
    """
    draws = sample_param_maps(config.search, n_draws) if draws is None else draws
    fitted = preparation(config.prep).fit(train)  # learns the category levels only, no label
    rows = cut_lineage(fitted.transform(train).select("ID", "features", "label", "fold"))
    every, samples = search_rows(config, rows, n_folds, sorted({float(d["smote_ratio"]) for d in draws if "smote_ratio" in d}), threads)
    jobs = {}
    for d, draw in enumerate(draws):
        settings = {**config.params, **{k: v for k, v in draw.items() if k != "smote_ratio"}}
        for f in (None, *range(n_folds)):
            sample = samples.get((f, float(draw["smote_ratio"]) if "smote_ratio" in draw else None))
            if sample is not None:
                jobs[d, f] = Fit(sample, **settings)
    if not any(f is None for _, f in jobs):
        raise InfeasibleRatio("no draw has a ratio above the current minority ratio")
    (forests, judged), cuts = boost(cut_lineage(every), list(jobs.values()), block_rows=block_rows)
    forest, counts = dict(zip(jobs, forests)), dict(zip(jobs, judged.tolist()))

    def f1(d: int, f: int) -> float:
        tp, fp, fn = counts.get((d, f), (0, 0, 0))
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    mean = [sum(f1(d, f) for f in range(n_folds)) / n_folds for d in range(len(draws))]
    best = max((d for d in range(len(draws)) if (d, None) in jobs), key=lambda d: mean[d])
    return PipelineModel(stages=[*fitted.stages, BoostedTreesModel.of(forest[best, None], cuts)]), draws[best], list(zip(draws, mean))


# --- importances -------------------------------------------------------------------------
def slot_names(prepared: DataFrame, col: str = "features") -> list[str]:
    """Vector slot names from the ``ml_attr`` metadata written by VectorAssembler."""
    attrs = prepared.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    slots = []
    for kind in attrs.values():
        for a in kind:
            slots.append((a["idx"], a["name"]))
    return [n for _, n in sorted(slots)]


def source_feature(slot: str) -> str:
    """Strip the preparation prefix and the one-hot level: cat__GENDER_1 → GENDER."""
    for prefix in ("yj__", "log__", "num__"):
        if slot.startswith(prefix):
            return slot[len(prefix):]
    if slot.startswith("cat__"):
        rest = slot[len("cat__"):]
        for c in CAT_COLS:
            if rest == c or rest.startswith(c + "_"):
                return c
    return slot


def feature_importances(model: PipelineModel, prepared: DataFrame, spark) -> DataFrame:
    """(feature, importance) with one-hot slots summed back to their column,
    6 dp, descending: tree importances, or |coefficient| for linear models.
    Positional names when the slot count differs from the model's."""
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        values = clf.featureImportances.toArray().tolist()
    else:
        values = [abs(v) for v in clf.coefficients.toArray().tolist()]
    names = slot_names(prepared)
    if len(names) != len(values):
        names = [f"feature_{i}" for i in range(len(values))]
    rows = [(source_feature(n), float(v)) for n, v in zip(names, values)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return (df.groupBy("feature").agg(F.round(F.sum("importance"), 6).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


def config_table(spark) -> DataFrame:
    """The configuration table as a DataFrame: the rebalanced configurations
    are two dictionaries (oversampled, weighted) united by name, as the
    reference merges them; baseline and tuned rows are appended."""
    cols = "model string, group string, prep string, algo string, rebalance string, threshold double"

    def rows(pred):
        return [(c.name, c.group, c.prep, c.algo, c.rebalance, float(c.threshold)) for c in CONFIGS if pred(c)]
    smote_t = spark.createDataFrame(rows(lambda c: c.group == GROUP_IMBALANCE and c.rebalance == "smote"), cols)
    weight_t = spark.createDataFrame(rows(lambda c: c.group == GROUP_IMBALANCE and c.rebalance != "smote"), cols)
    rest = spark.createDataFrame(rows(lambda c: c.group != GROUP_IMBALANCE), cols)
    return rest.unionByName(smote_t.unionByName(weight_t))
