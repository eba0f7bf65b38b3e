"""Model queries: preparation, the thirteen training configurations, importances,
oversampling, model persistence and registry, batch and stream scoring, results document."""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import models as mdl
from ..operators import sampling as smp
from ..operators.ingest import feature_matrix
from ..operators.leaderboard import comparison_rows, confusion_by_model, leaderboard, union_boards
from ..operators.ordered import running_sums
from ..operators.prep import preparation
from ..operators.scoring import scorecard_score, with_tier
from ..operators.smote import knn_lists, smote
from ..schema import BILL_COLS, CAT_COLS, FEATURES, NUM_BASE_COLS, PAY_AMT_COLS, PAY_COLS, SMOTE_RATIO
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.clients import client_view
from ..sources.io import failed_models, publish_models, read_registry, write_leaderboard, write_results
from ..sources.tables import table
from ..streaming.scoring_stream import run_file_stream
from . import oracle_sql as S
from .catalog import featured, register, source_files
from .evaluation_queries import CARDS, FT, SPLIT_CTE, _card_preds, _card_preds_sql, _div0, _split, score_sql
from .oracle_sql import with_clients
from .prep_queries import FT_SPLIT, TRAIN, YJ_APPLY, yj_ctes

BY_NAME = {c.name: c for c in mdl.CONFIGS}
_MADE: dict = {}
_LOCKS: dict = {}
_GUARD = threading.Lock()


def _once(key, make):
    """Make something once per application, whichever thread asks first."""
    with _GUARD:
        lock = _LOCKS.setdefault(key, threading.Lock())
    with lock:
        if key not in _MADE:
            _MADE[key] = make()
        return _MADE[key]


def _source(spark, d) -> tuple:
    return (spark.sparkContext.applicationId, *source_files(spark, d))


def _matrix_split(spark, d):
    """(ID, 32 features, DEFAULT, label, split, fold), written once per application and source."""
    def make():
        m = feature_matrix(featured(spark, d, "train"))
        return cut_lineage(m.join(_split(spark, d).select("ID", "split", "fold"), "ID"))
    return _once(("matrix", *_source(spark, d)), make)


# --- preparation ------------------------------------------------------------------------
def _prepared(spark, d, kind: str):
    data = _matrix_split(spark, d)
    fitted = preparation(kind).fit(smp.train_part(data))
    return fitted.transform(data).select("ID", "split", vector_to_array("features").alias("features"))


def _slots(prepared):
    """(ID, split, slot, value): the prepared vectors as rows, to six places."""
    return prepared.select("ID", "split", F.posexplode("features").alias("slot", "value")).select(
        "ID", "split", "slot", F.round("value", 6).alias("value"))


def _matrix_sql(cat: str) -> str:
    """One-hot slots of a category: its training levels in text order."""
    return (f"list_transform((SELECT list(level ORDER BY level) FROM (SELECT DISTINCT CAST({cat} AS VARCHAR) AS level FROM trf)), "
            f"lambda l: CAST(CAST(f.{cat} AS VARCHAR) = l AS DOUBLE))")


def _linear_sql() -> tuple[str, list[str]]:
    """The linear preparation from the twins of its parts, as one list per client."""
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in NUM_BASE_COLS)
    parts = [f"y.yj__{c}" for c in BILL_COLS] + [f"round(ln(1 + CAST(f.{c} AS DOUBLE)), 6)" for c in PAY_AMT_COLS]
    parts += [f"round((CAST(f.{c} AS DOUBLE) - m.m_{c}) / (CASE WHEN m.s_{c} = 0 THEN 1.0 ELSE m.s_{c} END), 6)" for c in NUM_BASE_COLS]
    parts += [f"CAST(f.{c} AS DOUBLE)" for c in PAY_COLS]
    hot = " || ".join(_matrix_sql(c) for c in CAT_COLS)
    return (f"SELECT f.ID, f.split, [{', '.join(parts)}] || {hot} AS features FROM fts f JOIN yjv y USING (ID), numeric_stats m",
            [FT, SPLIT_CTE, FT_SPLIT, TRAIN, *yj_ctes(), YJ_APPLY[1], f"yjv AS ({YJ_APPLY[0]})", f"numeric_stats AS (SELECT {stats} FROM trf)"])


_lin = _linear_sql()
_SLOTS_SQL = ("SELECT ID, split, CAST(i - 1 AS INTEGER) AS slot, features[i] AS value FROM "
              "(SELECT *, unnest(range(1, len(features) + 1)) AS i FROM ({}))")


@register("prep_linear")
def q_prep_linear(spark, d):
    """Linear preparation (Yeo-Johnson, log1p, scaling, one-hot) fitted on train, all rows."""
    return _prepared(spark, d, "linear")


@register("prep_linear_slots", with_clients(_SLOTS_SQL.format(_lin[0]), *_lin[1]))
def q_prep_linear_slots(spark, d):
    """The same, one row per client and slot of the vector."""
    return _slots(_prepared(spark, d, "linear"))


@register("prep_tree")
def q_prep_tree(spark, d):
    """Tree preparation (one-hot + pass-through) fitted on train, all rows."""
    return _prepared(spark, d, "tree")


@register("prep_tree_slots", with_clients(_SLOTS_SQL.format(
    f"SELECT f.ID, f.split, {' || '.join(_matrix_sql(c) for c in CAT_COLS)} || "
    f"[{', '.join(f'round(CAST(f.{c} AS DOUBLE), 6)' for c in FEATURES if c not in CAT_COLS)}] AS features FROM fts f"),
    FT, SPLIT_CTE, FT_SPLIT, TRAIN))
def q_prep_tree_slots(spark, d):
    """The same, one row per client and slot of the vector."""
    return _slots(_prepared(spark, d, "tree"))


# --- training: one artifact per configuration ------------------------------------------------
def trained(spark, d, name: str) -> dict:
    """Fit one configuration and write its bundle into a fresh place in the shared folder: the
    pipeline, the predictions of both splits, and its importances; the returned card names them.  Bundles
    belong to the application, the source files (with sizes and times) and the settings."""
    cfg = BY_NAME[name]
    key = hashlib.md5(repr((cfg, *source_files(spark, d))).encode()).hexdigest()

    def make() -> dict:
        data = _matrix_split(spark, d)
        train, best = smp.train_part(data), {}
        if cfg.search:
            model, best, _ = mdl.random_search(cfg, train)
        else:
            model = mdl.fit(cfg, train)
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bundles/{key}-{uuid.uuid4().hex}"
        model.write().overwrite().save(f"{base}/model")
        scored = mdl.with_probability(model.transform(data)).select(
            F.lit(cfg.name).alias("model"), F.lit(cfg.group).alias("group"), F.lit(cfg.threshold).alias("threshold"),
            "ID", "split", F.col("label").cast("int").alias("label"), "score")
        scored.write.mode("overwrite").parquet(f"{base}/predictions")
        prepared = PipelineModel(stages=model.stages[:-1]).transform(train)
        mdl.feature_importances(model, prepared, spark).write.mode("overwrite").parquet(f"{base}/importances")
        return {"model": name, "path": f"{base}/model", "features": list(FEATURES), "threshold": cfg.threshold,
                "predictions": f"{base}/predictions", "importances": f"{base}/importances",
                "best_params": {k: str(v) for k, v in best.items()} or None}
    return _once((spark.sparkContext.applicationId, key), make)


UNTUNED = [c for c in mdl.CONFIGS if c.search is None]


def trained_all(spark, d, configs=mdl.CONFIGS) -> list[dict]:
    """Bundles of the given configurations; missing ones are fitted side by side."""
    _matrix_split(spark, d)
    return mdl.in_parallel(lambda c: trained(spark, d, c.name), list(configs), threads=8)


def _all_predictions(spark, cards: list[dict]):
    return spark.read.parquet(*[c["predictions"] for c in cards])


def _all_importances(spark, cards: list[dict]):
    return union_boards(*[spark.read.parquet(c["importances"]).withColumn("model", F.lit(c["model"])) for c in cards])


def _register_model(key: str, name: str, what: str) -> None:
    def query(spark, d):
        return (spark.read.parquet(trained(spark, d, name)["predictions"]).filter(F.col("split") == "test")
                .select("ID", "label", "score", (F.col("score") >= F.col("threshold")).cast("int").alias("prediction")))
    query.__doc__ = f"{what}: test-split probability and class at the configuration's threshold."
    register(key)(query)


for _key, _name, _what in [
        ("model_logistic", "Logistic Regression", "Baseline logistic regression"),
        ("model_tree", "Decision Tree", "Baseline decision tree (depth 6)"),
        ("model_forest", "Random Forest", "Baseline random forest (200 trees)"),
        ("model_gbt", "Gradient Boosting", "Baseline gradient-boosted trees (100 x depth 3, rate 0.1)"),
        ("model_boosted", "XGBoost", "Baseline boosting (300 x depth 5, rate 0.05)"),
        ("model_smote_logistic", "SMOTE Logistic Regression", "Logistic regression on oversampled rows"),
        ("model_smote_forest", "SMOTE Random Forest", "Random forest on oversampled rows"),
        ("model_smote_boosted", "SMOTE XGBoost", "Boosting on oversampled rows"),
        ("model_weight_logistic", "Weight Logistic Regression", "Class-weighted logistic regression"),
        ("model_weight_forest", "Weight Random Forest", "Class-weighted random forest"),
        ("model_weight_boosted", "Weight XGBoost", "Boosting with a positive-class weight"),
        ("model_tuned_smote", "Tuned SMOTE XGBoost", "Boosting on oversampled rows, 20 draws x 5 folds searched"),
        ("model_tuned_weight", "Tuned Weight XGBoost", "Boosting with a positive-class weight, 20 draws x 5 folds searched")]:
    _register_model(_key, _name, _what)


@register("feature_importances")
def q_feature_importances(spark, d):
    """Decision-tree importances with one-hot slots summed back to their column."""
    return spark.read.parquet(trained(spark, d, "Decision Tree")["importances"])


@register("train_all")
def q_train_all(spark, d):
    """All thirteen configurations, both searches included, fitted on train and ranked on test."""
    return _board(spark, trained_all(spark, d))


@register("train_untuned")
def q_train_untuned(spark, d):
    """The eleven configurations without a search, fitted on train and ranked on test."""
    return _board(spark, trained_all(spark, d, UNTUNED))


def _board(spark, cards):
    """The comparison board joined with confusion counts; board and results document are written."""
    preds = _all_predictions(spark, cards)
    board = cut_lineage(comparison_rows(preds))
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results/{uuid.uuid4().hex}"
    write_leaderboard(board, f"{out}/leaderboard")
    write_results(results_of(spark, cards), f"{out}/results")
    return leaderboard(board, confusion_by_model(preds))


def results_of(spark, cards: list[dict]):
    """Results document of trained configurations: metrics, confusion matrix, whole curves,
    importances, best parameters."""
    preds = _all_predictions(spark, cards)
    doc = results_document(preds, curve_points=True)
    fi = _all_importances(spark, cards).groupBy("model").agg(  # at most 32 features per model
        F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("feature_importances"))
    best = spark.createDataFrame([(c["model"], c["best_params"]) for c in cards], "model string, best_params map<string,string>")
    return doc.join(fi, "model", "left").join(best, "model", "left")


@register("results_untuned")
def q_results_untuned(spark, d):
    """Results document of the eleven configurations without a search, importances as rows."""
    return _result_rows(spark, trained_all(spark, d, UNTUNED))


@register("results_all")
def q_results_all(spark, d):
    """Results document of all thirteen configurations, importances and best parameters as rows."""
    return _result_rows(spark, trained_all(spark, d))


def _result_rows(spark, cards):
    doc = results_of(spark, cards)
    entries = F.concat(F.transform(F.map_entries(F.coalesce("feature_importances", F.create_map().cast("map<string,double>"))),
                                   lambda e: F.struct(F.lit("importance").alias("kind"), e["key"].alias("name"), e["value"].cast("string").alias("value"))),
                       F.transform(F.map_entries(F.coalesce("best_params", F.create_map().cast("map<string,string>"))),
                                   lambda e: F.struct(F.lit("best_param").alias("kind"), e["key"].alias("name"), e["value"].alias("value"))))
    return doc.select("model", "auc", "f1", F.inline_outer(entries))


@register("result_curves_untuned")
def q_result_curves_untuned(spark, d):
    """ROC and PR curves in the results document of the eleven configurations without a search, as rows."""
    return _curve_rows(spark, trained_all(spark, d, UNTUNED))


@register("result_curves_all")
def q_result_curves_all(spark, d):
    """ROC and PR curves in the results document of all thirteen configurations, as rows."""
    return _curve_rows(spark, trained_all(spark, d))


def _curve_rows(spark, cards):
    return curve_rows(_all_predictions(spark, cards).filter(F.col("split") == "test"))


def curve_rows(test):
    """(model, curve, point, x, y): the curves of the results document as rows, numbered as its arrays are.
    A point's number is a running sum, so no curve is gathered in one place."""
    roc, pr = _ordered_curves(test)
    points = cut_lineage(roc.select("model", F.lit("roc").alias("curve"), "_o", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
                         .unionByName(pr.select("model", F.lit("pr").alias("curve"), "_o", F.col("recall").alias("x"), F.col("precision").alias("y"))))
    numbered = running_sums(points.withColumn("_one", F.lit(1).cast("long")), [("_o", True)], ["_one"], groups=["model", "curve"])
    return numbered.select("model", "curve", F.col("before__one").cast("int").alias("point"), "x", "y")


@register("top_importances_by_model")
def q_top_importances_by_model(spark, d):
    """The 15 most important features of every model without a search."""
    return _top_importances(spark, trained_all(spark, d, UNTUNED))


@register("top_importances_all")
def q_top_importances_all(spark, d):
    """The 15 most important features of all thirteen models."""
    return _top_importances(spark, trained_all(spark, d))


def _top_importances(spark, cards):
    from pyspark.sql import Window
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return (_all_importances(spark, cards).withColumn("rank", F.row_number().over(order))
            .filter("rank <= 15").select("model", "rank", "feature", "importance"))


# --- oversampling --------------------------------------------------------------------------
def _prepared_train(spark, d):
    train = smp.train_part(_matrix_split(spark, d))
    return cut_lineage(preparation("tree").fit(train).transform(train).select("ID", "features", "label"))


@register("smote")
def q_smote(spark, d):
    """SMOTE at ratio 0.5 on the tree-prepared training rows (5 neighbours)."""
    out = smote(_prepared_train(spark, d), SMOTE_RATIO)
    return out.select("ID", "label", "synthetic", vector_to_array("features").alias("features"))


@register("smote_counts", with_clients(
    "SELECT CAST(\"DEFAULT\" AS INTEGER) AS label, false AS synthetic, COUNT(*) AS n FROM tr GROUP BY \"DEFAULT\" UNION ALL "
    "SELECT 1, true, CAST(floor(0.5 * count_if(\"DEFAULT\" = 0)) - count_if(\"DEFAULT\" = 1) AS BIGINT) FROM tr",
    SPLIT_CTE, "tr AS (SELECT c.* FROM clients c JOIN spl USING (ID) WHERE spl.split = 'train')"))
def q_smote_counts(spark, d):
    """Rows per label and origin after SMOTE at ratio 0.5."""
    out = smote(_prepared_train(spark, d), SMOTE_RATIO)
    return out.groupBy(F.col("label").cast("int").alias("label"), "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("smote_neighbours")
def q_smote_neighbours(spark, d):
    """Nearest neighbours of the credit minority (distinct training vectors) found by the forest."""
    return _with_distances(knn_lists(_prepared_train(spark, d).filter("label = 1")))


@register("embedding_neighbours")
def q_embedding_neighbours(spark, d):
    """Nearest neighbours of all embeddings (distinct vectors of the commonest length) found by the same forest."""
    whole = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v")).filter(
        F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))  # also no NaN, which is above infinity
    length = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    same = whole.filter(F.size("v") == (length["n"] if length else 0))
    return _with_distances(knn_lists(same.select(array_to_vector("v").alias("features"))))


def _with_distances(lists):
    far = F.array_max(F.transform("nn", lambda v: F.sqrt(F.aggregate(
        F.zip_with(v, F.col("x"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, z: acc + z))))
    return lists.select("x", F.size("nn").alias("n_neighbours"), far.alias("kth_distance"))


# --- persistence, registry, batch and stream scoring ---------------------------------------------
def load_status(cards) -> list[tuple]:
    """Registry rows; a model whose directory cannot be loaded is kept with its error text."""
    out = []
    for c in cards:
        try:
            PipelineModel.load(c["path"])
            out.append((c["model"], c["path"], c["features"], c["threshold"], "loaded", None))
        except Exception as e:  # noqa: BLE001 — the failure is the row's content
            out.append((c["model"], c["path"], c["features"], c["threshold"], "failed", f"{type(e).__name__}: {str(e)[:500]}"))
    return out


@register("model_registry")
def q_model_registry(spark, d):
    """The eleven untuned bundles and their load status (one missing path included), written and reread."""
    return _reread_registry(spark, trained_all(spark, d, UNTUNED))


@register("model_registry_all")
def q_model_registry_all(spark, d):
    """All thirteen bundles and their load status (one missing path included), written and reread."""
    return _reread_registry(spark, trained_all(spark, d))


def _reread_registry(spark, cards):
    cards = [*cards, {**cards[0], "model": "Missing Model", "path": cards[0]["path"] + "-absent", "threshold": 0.5}]
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry/{uuid.uuid4().hex}"
    publish_models(spark, root, [(c["model"], c["path"], c["features"], c["threshold"], "published", None) for c in cards])
    publish_models(spark, root, load_status(cards))     # a later commit replaces the rows of an earlier one
    return read_registry(spark, root)


@register("failed_artifacts")
def q_failed_artifacts(spark, d):
    """Registry rows whose bundle could not be loaded."""
    return failed_models(q_model_registry(spark, d)).select("model", "status", "error")


@register("failed_artifacts_all")
def q_failed_artifacts_all(spark, d):
    """Registry rows of all thirteen configurations whose bundle could not be loaded."""
    return failed_models(q_model_registry_all(spark, d)).select("model", "status", "error")


@register("score_batch")
def q_score_batch(spark, d):
    """Load the saved baseline logistic model, score every client, tier the probability."""
    model = PipelineModel.load(trained(spark, d, "Logistic Regression")["path"])
    every = feature_matrix(featured(spark, d, "train"))
    scored = mdl.with_probability(model.transform(every))
    return with_tier(scored).select("ID", "score", "pct", "tier")


@register("score_stream_model")
def q_score_stream_model(spark, d):
    """Client files scored by a file stream with the saved logistic model: probability, tier and
    the five explanation factors per client."""
    model = PipelineModel.load(trained(spark, d, "Logistic Regression")["path"])

    return run_file_stream(spark, _stream_source(spark, d), lambda rows: mdl.with_probability(model.transform(feature_matrix(rows))),
                           factors=True)


_SC = f'sc AS (SELECT *, {score_sql()} AS score FROM ft)'


@register("score_stream", with_clients(
    f"SELECT ID, score, round(score * 100, 4) AS pct, {S.risk_tier('score * 100')} AS tier, "
    f"{S.tier_verdict(S.risk_tier('score * 100'))} AS verdict FROM sc", FT, _SC))
def q_score_stream(spark, d):
    """Client files scored by a file stream (availableNow) with the scorecard."""
    return run_file_stream(spark, _stream_source(spark, d), scorecard_score)


def _stream_source(spark, d) -> str:
    """Client files for the stream: the raw client view as Spark partitions it."""
    src = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-src-{uuid.uuid4().hex[:12]}"
    client_view(spark, d).write.parquet(src)
    return src


# --- results document ------------------------------------------------------------------------------
def _ordered_curves(test):
    """ROC and PR curves per model; ``_o`` is unique in a curve and orders its points."""
    roc = ev.roc_curve(test, by=["model"]).withColumn("_o", F.coalesce(-F.col("threshold"), F.lit(-2.0)))
    pr = ev.pr_curve(test, by=["model"]).withColumn("_o", F.coalesce(F.col("threshold"), F.lit(2.0)))
    return roc, pr


def results_document(preds, curve_points: bool = False):
    """One row per model: auc, f1, confusion matrix; with ``curve_points`` also the whole ROC and PR
    curves as arrays, one entry per distinct score.  The curves as rows are :func:`curve_rows`."""
    test = preds.filter(F.col("split") == "test")
    auc = ev.roc_auc(test, by=["model"], places=6)
    cm = confusion_by_model(preds)
    f1 = cm.select("model", F.round(ev._div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
                   F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("cm"))
    doc = auc.select("model", "auc").join(f1, "model")
    if not curve_points:
        return doc
    roc, pr = _ordered_curves(test)
    roc_a = roc.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("_o", "fpr", "tpr"))).alias("_r"))
    pr_a = pr.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("_o", "precision", "recall"))).alias("_p"))
    return (doc.join(roc_a, "model").join(pr_a, "model")
            .select("model", "auc", "f1", F.col("_r.fpr").alias("fpr"), F.col("_r.tpr").alias("tpr"),
                    F.col("_p.precision").alias("prec"), F.col("_p.recall").alias("rec"), "cm"))


def _curves_sql() -> list[str]:
    return [
        _card_preds_sql(),
        "tp0 AS (SELECT * FROM preds WHERE split = 'test')",
        "rkm2 AS (SELECT model, score, pos, neg, SUM(pos) OVER w AS cum_pos, SUM(neg) OVER w AS cum_neg FROM "
        "(SELECT model, score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM tp0 GROUP BY model, score) "
        "WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        "tot AS (SELECT model, SUM(pos) AS p, SUM(neg) AS n FROM rkm2 GROUP BY model)",
        "rocp AS (SELECT model, -score AS o, round(" + _div0("cum_neg", "n") + ", 6) AS fpr, round("
        + _div0("cum_pos", "p") + ", 6) AS tpr FROM (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg "
        "FROM rkm2 WINDOW w AS (PARTITION BY model ORDER BY score DESC)) JOIN tot USING (model) "
        "WHERE cum_pos + cum_neg = pos + neg OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg "
        "UNION ALL SELECT model, -2.0, 0.0, 0.0 FROM tot)",
    ]


@register("curve_points_long", with_clients(
    "SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY o) - 1 AS INTEGER) AS point, fpr, tpr FROM rocp",
    FT, SPLIT_CTE, *_curves_sql()))
def q_curve_points_long(spark, d):
    """ROC arrays of the results document exploded back to (model, point, fpr, tpr)."""
    doc = results_document(_card_preds(spark, d), curve_points=True)
    return doc.select("model", F.posexplode(F.arrays_zip("fpr", "tpr")).alias("point", "p")).select(
        "model", "point", F.col("p.fpr").alias("fpr"), F.col("p.tpr").alias("tpr"))


@register("model_lookup", with_clients(
    "SELECT model, CAST(count_if(label = 0 AND score < threshold) AS BIGINT) AS tn, "
    "CAST(count_if(label = 0 AND score >= threshold) AS BIGINT) AS fp, "
    "CAST(count_if(label = 1 AND score < threshold) AS BIGINT) AS fn, "
    "CAST(count_if(label = 1 AND score >= threshold) AS BIGINT) AS tp, "
    "(SELECT COUNT(*) FROM rocp WHERE rocp.model = 'Scorecard full') AS n_roc_points "
    "FROM tp0 WHERE model = 'Scorecard full' GROUP BY model",
    FT, SPLIT_CTE, *_curves_sql()))
def q_model_lookup(spark, d):
    """Results-document entry of one model by key: confusion cells (default
    zeros when absent) and the ROC length."""
    doc = results_document(_card_preds(spark, d), curve_points=True)
    zero = F.array(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")),
                   F.array(F.lit(0).cast("long"), F.lit(0).cast("long")))
    hit = doc.filter(F.col("model") == CARDS[0][0])
    cm = F.coalesce(F.col("cm"), zero)
    return hit.select("model", cm[0][0].alias("tn"), cm[0][1].alias("fp"), cm[1][0].alias("fn"),
                      cm[1][1].alias("tp"), F.size("fpr").cast("long").alias("n_roc_points"))
