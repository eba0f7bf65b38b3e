"""Queries over scored clients: the deterministic scorecard stands in for a
model so that every metric has an SQL twin; plus the stratified split, folds
and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import leaderboard as lb
from ..operators import sampling as smp
from ..operators.rates import class_balance
from ..operators.scoring import scorecard_score
from ..session import cut_lineage
from ..schema import (GROUP_BASELINE, GROUP_IMBALANCE, GROUP_TUNED, SCORECARD, THRESHOLD_BASELINE,
                      THRESHOLD_REBALANCED)
from . import oracle_sql as S
from .catalog import featured, register
from .oracle_sql import with_clients

THRESHOLDS = [THRESHOLD_REBALANCED, THRESHOLD_BASELINE]

# Scorecards compared on the SQL-checked leaderboard: the full card and two
# reduced cards (payment status only; usage only).
STATUS_CARD = {**SCORECARD, "util": 0.0, "ratio": 0.0}
USAGE_CARD = {**SCORECARD, "pay0": 0.0, "pay2": 0.0}
CARDS = [("Scorecard full", SCORECARD, GROUP_BASELINE, THRESHOLD_BASELINE),
         ("Scorecard status", STATUS_CARD, GROUP_IMBALANCE, THRESHOLD_REBALANCED),
         ("Scorecard usage", USAGE_CARD, GROUP_TUNED, THRESHOLD_REBALANCED)]


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def score_sql(coef=SCORECARD) -> str:
    z = (f"((({_d(coef['intercept'])} + {_d(coef['pay0'])} * greatest(PAY_0, 0)) "
         f"+ {_d(coef['pay2'])} * greatest(PAY_2, 0)) + {_d(coef['util'])} * round(UTIL_RATE, 6)) "
         f"+ {_d(coef['ratio'])} * round(PAY_RATIO, 6)")
    return f"round(1.0 / (1.0 + exp(-({z}))), 4)"


SCORED_CTE = f'scored AS (SELECT ID, "DEFAULT" AS label, {score_sql()} AS score FROM ft)'
SPLIT_CTE = (
    "spl AS (SELECT ID, \"DEFAULT\", rn AS class_rank, CASE WHEN rn <= n_test THEN 'test' ELSE 'train' END AS split, "
    "CAST(CASE WHEN rn > n_test THEN (rn - n_test - 1) % 5 END AS INTEGER) AS fold FROM ("
    "SELECT ID, \"DEFAULT\", row_number() OVER (PARTITION BY \"DEFAULT\" ORDER BY md5('42:' || CAST(ID AS VARCHAR)), ID) AS rn, "
    "CAST(round(COUNT(*) OVER (PARTITION BY \"DEFAULT\") * 0.2) AS BIGINT) AS n_test FROM clients))")
FT = S.features_cte("ft", "train")


def _scored(spark, d):
    """(ID, label, score), persisted once: every metric reads it several times."""
    return cut_lineage(scorecard_score(featured(spark, d, "train")).select(
        "ID", F.col("DEFAULT").alias("label"), "score"))


def _split(spark, d):
    """(ID, DEFAULT) with class rank, split and fold, written once per query."""
    from .catalog import clients
    return cut_lineage(smp.stratified_split(clients(spark, d).select("ID", "DEFAULT")))


@register("scorecard_score", with_clients("SELECT ID, label, score FROM scored", FT, SCORED_CTE))
def q_scorecard_score(spark, d):
    """Fixed-coefficient logistic scorecard: sigmoid of a linear score, 4 dp."""
    return _scored(spark, d)


@register("threshold_predictions", with_clients(
    "SELECT ID, label, score, CAST(score >= 0.5 AS INTEGER) AS pred_050, "
    "CAST(score >= 0.3 AS INTEGER) AS pred_030 FROM scored", FT, SCORED_CTE))
def q_threshold_predictions(spark, d):
    """Predicted class at the 0.5 and 0.3 thresholds (score >= t)."""
    s = _scored(spark, d)
    return s.select("ID", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred_050"),
                    (F.col("score") >= 0.3).cast("int").alias("pred_030"))


def _cm_sql(source: str, thresholds, by: str = "") -> str:
    sel_by = f"{by}, " if by else ""
    parts = []
    for t in thresholds:
        p = f"score >= {t}"
        parts.append(
            f"SELECT {sel_by}CAST({t} AS DOUBLE) AS threshold, "
            f"CAST(count_if(label = 0 AND NOT ({p})) AS BIGINT) AS tn, CAST(count_if(label = 0 AND {p}) AS BIGINT) AS fp, "
            f"CAST(count_if(label = 1 AND NOT ({p})) AS BIGINT) AS fn, CAST(count_if(label = 1 AND {p}) AS BIGINT) AS tp "
            f"FROM {source}" + (f" GROUP BY {by}" if by else ""))
    return " UNION ALL ".join(parts)


def _div0(n: str, d: str) -> str:
    return f"COALESCE(CAST({n} AS DOUBLE) / CAST(nullif({d}, 0) AS DOUBLE), 0.0)"


def _metrics_sql(src: str, places: int = 4, extra: str = "") -> str:
    return (f"SELECT {extra}threshold, tn, fp, fn, tp, round({_div0('tp + tn', 'tn + fp + fn + tp')}, {places}) AS accuracy, "
            f"round({_div0('tp', 'tp + fp')}, {places}) AS precision, round({_div0('tp', 'tp + fn')}, {places}) AS recall, "
            f"round({_div0('2 * tp', '2 * tp + fp + fn')}, {places}) AS f1 FROM ({src})")


@register("confusion_matrix", with_clients(_cm_sql("scored", THRESHOLDS), FT, SCORED_CTE))
def q_confusion_matrix(spark, d):
    """tn, fp, fn, tp of the scorecard at thresholds 0.3 and 0.5."""
    return ev.confusion_counts(_scored(spark, d), THRESHOLDS)


@register("classification_metrics", with_clients(_metrics_sql(_cm_sql("scored", [0.5])), FT, SCORED_CTE))
def q_classification_metrics(spark, d):
    """Accuracy, precision, recall, F1 (positive class, zero division → 0) at 0.5."""
    return ev.metrics_from_counts(ev.confusion_counts(_scored(spark, d), [0.5]))


_SCORED_SPLIT = "ss AS (SELECT s.*, p.split FROM scored s JOIN spl p USING (ID))"


@register("metrics_by_threshold", with_clients(
    _metrics_sql(_cm_sql("ss", THRESHOLDS, "split"), extra="split, "), FT, SCORED_CTE, SPLIT_CTE, _SCORED_SPLIT))
def q_metrics_by_threshold(spark, d):
    """Confusion counts and metrics per split (train / test) and threshold."""
    s = _scored(spark, d).join(_split(spark, d).select("ID", "split"), "ID")
    return ev.metrics_from_counts(ev.confusion_counts(s, THRESHOLDS, by=["split"]))


_RANK_CTE = ("rk AS (SELECT score, pos, neg, "
             "COALESCE(SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_pos, "
             "SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos, "
             "SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg "
             "FROM (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM scored "
             "WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY score))")
_AUC = "SUM(neg * (before_pos + pos / 2.0)) / CAST(nullif(SUM(pos) * SUM(neg), 0) AS DOUBLE)"


@register("roc_auc", with_clients(
    f"SELECT round({_AUC}, 6) AS auc, SUM(pos) AS n_pos, SUM(neg) AS n_neg FROM rk", FT, SCORED_CTE, _RANK_CTE))
def q_roc_auc(spark, d):
    """Exact ROC-AUC of the scorecard (ties ½), via distributed running sums."""
    return ev.roc_auc(_scored(spark, d))


@register("gini", with_clients(f"SELECT round(2 * round({_AUC}, 6) - 1, 6) AS gini FROM rk", FT, SCORED_CTE, _RANK_CTE))
def q_gini(spark, d):
    """Gini coefficient 2·AUC − 1."""
    return ev.roc_auc(_scored(spark, d)).select(F.round(2 * F.col("auc") - 1, 6).alias("gini"))


@register("roc_curve", with_clients(
    "SELECT score AS threshold, round(" + _div0("cum_neg", "n") + ", 6) AS fpr, round(" + _div0("cum_pos", "p") + ", 6) AS tpr "
    "FROM (SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, cum_pos + cum_neg - pos - neg AS above "
    "FROM rk WINDOW w AS (ORDER BY score DESC)), (SELECT SUM(pos) AS p, SUM(neg) AS n FROM rk) "
    "WHERE above = 0 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL SELECT NULL, 0.0, 0.0",
    FT, SCORED_CTE, _RANK_CTE))
def q_roc_curve(spark, d):
    """ROC points (fpr, tpr) in descending score from (0, 0), without points inside a straight step."""
    return ev.roc_curve(_scored(spark, d))


@register("pr_curve", with_clients(
    "SELECT score AS threshold, round(" + _div0("cum_pos", "cum_pos + cum_neg") + ", 6) AS precision, "
    "round(" + _div0("cum_pos", "p") + ", 6) AS recall FROM rk, (SELECT SUM(pos) AS p FROM rk) "
    "UNION ALL SELECT NULL, 1.0, 0.0", FT, SCORED_CTE, _RANK_CTE))
def q_pr_curve(spark, d):
    """Precision-recall points of every distinct score, closed by (recall 0, precision 1)."""
    return ev.pr_curve(_scored(spark, d))


@register("log_loss", with_clients(
    "SELECT round(avg(-(CAST(label AS DOUBLE) * ln(p) + (1 - CAST(label AS DOUBLE)) * ln(1 - p))), 6) AS log_loss, "
    "COUNT(*) AS n FROM (SELECT label, least(1 - 1e-15, greatest(1e-15, score)) AS p FROM scored)", FT, SCORED_CTE))
def q_log_loss(spark, d):
    """Mean log loss of the scorecard probabilities."""
    return ev.log_loss(_scored(spark, d))


@register("majority_baseline", with_clients(_metrics_sql(
    "SELECT NULL AS threshold, CAST(count_if(label = 0) AS BIGINT) AS tn, CAST(0 AS BIGINT) AS fp, "
    "CAST(count_if(label = 1) AS BIGINT) AS fn, CAST(0 AS BIGINT) AS tp FROM scored").replace(
    "SELECT threshold, ", "SELECT "), FT, SCORED_CTE))
def q_majority_baseline(spark, d):
    """Always 'no default': accuracy = share of class 0, precision/recall/F1 0."""
    return ev.majority_baseline(_scored(spark, d))


# --- split, folds, weights -------------------------------------------------------------
@register("stratified_split", with_clients("SELECT ID, \"DEFAULT\", class_rank, split, fold FROM spl", SPLIT_CTE))
def q_stratified_split(spark, d):
    """Exact 80/20 split per class in seeded hash order, with 5 stratified folds."""
    return _split(spark, d).select("ID", "DEFAULT", "class_rank", "split", "fold")


@register("stratified_folds", with_clients(
    "SELECT fold, \"DEFAULT\", COUNT(*) AS n FROM spl WHERE split = 'train' GROUP BY fold, \"DEFAULT\"", SPLIT_CTE))
def q_stratified_folds(spark, d):
    """Class counts per training fold (folds are balanced to ±1 row per class)."""
    return (smp.train_part(_split(spark, d)).groupBy("fold", "DEFAULT")
            .agg(F.count(F.lit(1)).alias("n")).orderBy("fold", "DEFAULT"))


_TRAIN = "tr AS (SELECT c.* FROM clients c JOIN spl USING (ID) WHERE spl.split = 'train')"


@register("balanced_weights", with_clients(
    "SELECT \"DEFAULT\", n_class, SUM(n_class) OVER () AS n, SUM(n_class) OVER () / (2.0 * n_class) AS weight "
    "FROM (SELECT \"DEFAULT\", COUNT(*) AS n_class FROM tr GROUP BY \"DEFAULT\")", SPLIT_CTE, _TRAIN))
def q_balanced_weights(spark, d):
    """'Balanced' class weights n / (2·n_class) on the training split."""
    return smp.balanced_weights(smp.train_part(_split(spark, d)))


@register("scale_pos_weight", with_clients(
    "SELECT CAST(count_if(\"DEFAULT\" = 0) AS BIGINT) AS n_neg, CAST(count_if(\"DEFAULT\" = 1) AS BIGINT) AS n_pos, "
    "CAST(count_if(\"DEFAULT\" = 0) AS DOUBLE) / nullif(count_if(\"DEFAULT\" = 1), 0) AS scale_pos_weight, "
    "round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS default_rate_pct FROM tr", SPLIT_CTE, _TRAIN))
def q_scale_pos_weight(spark, d):
    """Class counts and n0/n1 on the training split (the positive-class weight)."""
    return class_balance(smp.train_part(_split(spark, d)))


# --- leaderboard over scorecards ------------------------------------------------------------
def _card_preds(spark, d):
    """Predictions of every compared card on both splits, persisted once."""
    base = featured(spark, d, "train").join(_split(spark, d).select("ID", "split"), "ID")
    parts = []
    for name, coef, group, thr in CARDS:
        parts.append(scorecard_score(base, coef).select(
            F.lit(name).alias("model"), F.lit(group).alias("group"), F.lit(thr).alias("threshold"),
            "ID", "split", F.col("DEFAULT").alias("label"), "score"))
    return cut_lineage(lb.union_boards(*parts))


def _card_preds_sql() -> str:
    return "preds AS (" + " UNION ALL ".join(
        f"SELECT {S.lit(name)} AS model, {S.lit(group)} AS \"group\", {thr} AS threshold, ID, split, "
        f"ft.\"DEFAULT\" AS label, {score_sql(coef)} AS score FROM ft JOIN spl USING (ID)"
        for name, coef, group, thr in CARDS) + ")"


_PRED_CTES = (FT, SPLIT_CTE, _card_preds_sql(),
              "cmm AS (SELECT model, CAST(count_if(label = 0 AND score < threshold) AS BIGINT) AS tn, "
              "CAST(count_if(label = 0 AND score >= threshold) AS BIGINT) AS fp, "
              "CAST(count_if(label = 1 AND score < threshold) AS BIGINT) AS fn, "
              "CAST(count_if(label = 1 AND score >= threshold) AS BIGINT) AS tp FROM preds WHERE split = 'test' GROUP BY model)",
              "rkm AS (SELECT model, score, pos, neg, COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY score DESC "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_pos FROM (SELECT model, score, "
              "count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM preds WHERE split = 'test' GROUP BY model, score))",
              f"aucm AS (SELECT model, {_AUC} AS auc FROM rkm GROUP BY model)",
              "board AS (SELECT p.model, round(" + _div0("count_if(split = 'train' AND (score >= threshold) = (label = 1))",
                                                         "count_if(split = 'train')") + ", 4) AS train_accuracy, "
              "round(" + _div0("c.tp + c.tn", "c.tn + c.fp + c.fn + c.tp") + ", 4) AS test_accuracy, "
              "round(a.auc, 4) AS auc, round(" + _div0("2 * c.tp", "2 * c.tp + c.fp + c.fn") + ", 4) AS f1, "
              "round(" + _div0("c.tp", "c.tp + c.fp") + ", 4) AS precision, round(" + _div0("c.tp", "c.tp + c.fn")
              + ", 4) AS recall, p.\"group\" FROM preds p JOIN cmm c USING (model) JOIN aucm a USING (model) "
              "GROUP BY p.model, p.\"group\", c.tn, c.fp, c.fn, c.tp, a.auc)")


@register("leaderboard", with_clients(
    "SELECT b.*, CASE WHEN c.tp IS NULL THEN 'N/A' ELSE format('{:,} / {:,}', c.tp, c.tp + c.fn) END AS caught_defaulters, "
    "CASE WHEN c.tp IS NULL THEN 'N/A' ELSE format('{:,}', c.fp) END AS false_alarms "
    "FROM board b LEFT JOIN cmm c USING (model) ORDER BY auc DESC, model", *_PRED_CTES))
def q_leaderboard(spark, d):
    """Union of group boards ⟕ confusion counts, sorted by test AUC."""
    preds = _card_preds(spark, d)
    # one row per model, computed once; the group tables are cut from it
    rows = cut_lineage(lb.comparison_rows(preds))
    boards = [rows.filter(F.col("group") == g) for g in (GROUP_BASELINE, GROUP_IMBALANCE, GROUP_TUNED)]
    # the third group's columns come in another order, as in the reference
    boards[2] = boards[2].select("model", "group", *[c for c in boards[2].columns if c not in ("model", "group")])
    return lb.leaderboard(lb.union_boards(*boards), lb.confusion_by_model(preds))


@register("best_model", with_clients(
    "SELECT model, auc, \"group\" FROM board ORDER BY auc DESC, model LIMIT 1", *_PRED_CTES))
def q_best_model(spark, d):
    """The leaderboard's first model by test AUC."""
    return lb.best_model(lb.comparison_rows(_card_preds(spark, d)))


@register("leaderboard_from_cm", with_clients(
    "SELECT model, round(COALESCE(auc, 0.0), 4) AS auc_roc, round(pr, 3) AS precision, round(rc, 3) AS recall, "
    "round(COALESCE(2 * pr * rc / nullif(pr + rc, 0), 0.0), 3) AS f1, round(" + _div0("tp + tn", "tp + tn + fp + fn")
    + ", 3) AS accuracy, format('{:,} / {:,}', tp, tp + fn) AS caught_defaulters, format('{:,}', fp) AS false_alarms "
    "FROM (SELECT c.*, a.auc, " + _div0("tp", "tp + fp") + " AS pr, " + _div0("tp", "tp + fn")
    + " AS rc FROM cmm c LEFT JOIN aucm a USING (model)) ORDER BY auc_roc DESC, model", *_PRED_CTES))
def q_leaderboard_from_cm(spark, d):
    """Fallback board from confusion counts and AUC (3 dp metrics)."""
    preds = _card_preds(spark, d)
    auc = ev.roc_auc(preds.filter(F.col("split") == "test"), by=["model"], places=12)
    return lb.board_from_confusion(lb.confusion_by_model(preds), auc)
