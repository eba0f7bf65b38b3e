"""Queries that write and reread the sources and sinks (S1–S4, S7, S8), and the
rounded or formatted forms of summaries that the dashboard shows (P16, P17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import association as assoc
from ..operators import profile as prof
from ..operators.ingest import ingest
from ..operators.leaderboard import comparison_rows
from ..schema import CORR_COLS
from ..session import ensure_checkpoint_dir
from ..sources import io
from ..sources.clients import client_view
from . import oracle_sql as S
from .analysis_queries import _TARGET_COLS, PROFILE_COLS, _corr_matrix_sql, _corr_target_sql
from .catalog import clients, register
from .evaluation_queries import _AUC, _PRED_CTES, _card_preds
from .model_queries import results_document
from .oracle_sql import with_clients


def _folder(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}/{uuid.uuid4().hex}"


@register("scan_clients", with_clients("SELECT * FROM clients"))
def q_scan_clients(spark, d):
    """The client view written as CSV with a header, scanned with the declared schema, renamed."""
    path = _folder(spark, "clients-csv")
    client_view(spark, d).write.option("header", True).csv(path)
    return ingest(io.read_clients_csv(spark, path))


@register("optional_source", with_clients("SELECT COUNT(*) AS n_clients, CAST(0 AS BIGINT) AS n_absent FROM clients"))
def q_optional_source(spark, d):
    """Rows of the clients, and of an optional source whose path does not exist."""
    absent = io.read_optional(spark, _folder(spark, "absent"), io.LEADERBOARD)
    return clients(spark, d).agg(F.count(F.lit(1)).alias("n_clients")).withColumn("n_absent", F.lit(absent.count()).cast("long"))


@register("leaderboard_round_trip", with_clients("SELECT * FROM board", *_PRED_CTES))
def q_leaderboard_round_trip(spark, d):
    """The comparison table of the scorecards written as CSV and read back."""
    path = _folder(spark, "leaderboard")
    io.write_leaderboard(comparison_rows(_card_preds(spark, d)), path)
    return io.read_leaderboard(spark, f"{path}/csv")


@register("results_round_trip", with_clients(
    "SELECT c.model, round(a.auc, 6) AS auc, round(COALESCE(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1, tn, fp, fn, tp "
    "FROM cmm c JOIN aucm a USING (model)", *_PRED_CTES))
def q_results_round_trip(spark, d):
    """The scorecards' results document written as JSON and read back: metrics and matrix cells."""
    path = _folder(spark, "results")
    io.write_results(results_document(_card_preds(spark, d)), path)
    cm = F.col("cm")
    return io.read_results(spark, path).select("model", "auc", "f1", cm[0][0].alias("tn"), cm[0][1].alias("fp"),
                                               cm[1][0].alias("fn"), cm[1][1].alias("tp"))


def _rounded_sql(cols) -> str:
    whole = lambda x: f"CAST(round_even({x}, 0) AS BIGINT)"
    rows = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        rows.append([("variable", S.lit(c)), ("count", f"COUNT({c})"), ("mean", whole(f"avg({x})")), ("std", whole(f"stddev_samp({x})")),
                     ("min", whole(f"min({x})")), ("p25", whole(f"quantile_cont({x}, 0.25)")), ("median", whole(f"quantile_cont({x}, 0.5)")),
                     ("p75", whole(f"quantile_cont({x}, 0.75)")), ("max", whole(f"max({x})"))])
    return S.stack(rows, "clients")


@register("profile_display", with_clients(_rounded_sql(PROFILE_COLS)))
def q_profile_display(spark, d):
    """The numeric summary as the dashboard shows it: whole numbers, halves to even."""
    out = prof.numeric_summary(clients(spark, d), PROFILE_COLS, places=None)
    return out.select("variable", "count", *[F.bround(c, 0).cast("long").alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])


@register("corr_matrix_display", with_clients(_corr_matrix_sql(CORR_COLS).replace(", 6)", ", 3)")))
def q_corr_matrix_display(spark, d):
    """The Pearson matrix at the dashboard's three places."""
    return assoc.corr_matrix(clients(spark, d), CORR_COLS, places=3)


@register("corr_texts", with_clients(
    "SELECT feature, format('{:.3f}', r) AS text FROM (" + _corr_target_sql(_TARGET_COLS, "clients") + ")"))
def q_corr_texts(spark, d):
    """Correlations with the target as three-place texts."""
    return assoc.corr_with_target(clients(spark, d), CORR_COLS).select("feature", F.format_number("r", 3).alias("text"))
