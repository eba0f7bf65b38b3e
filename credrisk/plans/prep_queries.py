"""Preparation queries: scaling, one-hot and the Yeo-Johnson fit, each fitted
on the training split and applied to every client."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from ..operators import sampling as smp
from ..schema import BILL_COLS, CAT_COLS, NUM_BASE_COLS
from ..session import cut_lineage
from . import oracle_sql as S
from .catalog import featured, register
from .evaluation_queries import FT, SPLIT_CTE, _split
from .oracle_sql import with_clients

FT_SPLIT = "fts AS (SELECT ft.*, spl.split FROM ft JOIN spl USING (ID))"
TRAIN = "trf AS (SELECT * FROM fts WHERE split = 'train')"


def _featured_split(spark, d):
    """Train-variant features with the split column, persisted once."""
    return cut_lineage(featured(spark, d, "train").join(_split(spark, d).select("ID", "split"), "ID"))


def _std_sql() -> str:
    sel = ", ".join(
        f"round((CAST(f.{c} AS DOUBLE) - m.m_{c}) / (CASE WHEN m.s_{c} = 0 THEN 1.0 ELSE m.s_{c} END), 6) AS num__{c}"
        for c in NUM_BASE_COLS)
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in NUM_BASE_COLS)
    return f"SELECT f.ID, {sel} FROM fts f, (SELECT {stats} FROM trf) m"


@register("prep_standardize", with_clients(_std_sql(), FT, SPLIT_CTE, FT_SPLIT, TRAIN))
def q_prep_standardize(spark, d):
    """Population-std scaling of 11 numerics, fitted on the training split."""
    fs = _featured_split(spark, d)
    model = prep.PopulationStandardScaler(inputCols=NUM_BASE_COLS,
                                          outputCols=[f"num__{c}" for c in NUM_BASE_COLS]).fit(smp.train_part(fs))
    out = model.transform(fs)
    return out.select("ID", *[F.round(f"num__{c}", 6).alias(f"num__{c}") for c in NUM_BASE_COLS])


def _one_hot_sql() -> str:
    parts = [f"SELECT f.ID, '{c}' AS feature, l.level, CAST(CAST(f.{c} AS VARCHAR) = l.level AS INTEGER) AS value "
             f"FROM fts f, (SELECT DISTINCT CAST({c} AS VARCHAR) AS level FROM trf WHERE {c} IS NOT NULL) l"
             for c in CAT_COLS]
    return " UNION ALL ".join(parts)


@register("prep_one_hot", with_clients(_one_hot_sql(), FT, SPLIT_CTE, FT_SPLIT, TRAIN))
def q_prep_one_hot(spark, d):
    """One-hot of GENDER / EDUCATION / MARRIAGE on training levels, long form
    (ID, feature, level, value); an unseen level gives all zeros."""
    fs = _featured_split(spark, d)
    idx, ohe = prep.one_hot_stages()
    idx_model = idx.fit(smp.train_part(fs))
    enc = ohe.fit(idx_model.transform(smp.train_part(fs))).transform(idx_model.transform(fs))
    return prep.one_hot_long(idx_model, enc)


# --- Yeo-Johnson: λ by golden-section search in SQL -----------------------------------------------
def _psi(x: str, lam: str) -> str:
    return (f"(CASE WHEN {x} >= 0 THEN (CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END) "
            f"ELSE (CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END) END)")


YJ_BRACKET = (-10.0, 12.0)   # where the twin looks for the highest likelihood


def yj_ctes(rounds: int = 52) -> list[str]:
    """Golden-section search: each round keeps the side of the two inner points with the higher likelihood."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM trf" for c in BILL_COLS)
    g = (5 ** 0.5 - 1) / 2
    lo, hi = YJ_BRACKET

    def llf(lam: str) -> str:
        return f"-count(*) / 2.0 * ln(var_pop({_psi('x', lam)})) + ({lam} - 1) * sum(sign(x) * ln(1 + abs(x)))"
    ctes = [f"yjl AS (SELECT * FROM ({long}) WHERE x IS NOT NULL)",
            f"yg0 AS (SELECT variable, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi FROM yjl GROUP BY variable HAVING min(x) < max(x))"]
    for k in range(rounds):
        ctes.append(f"yg{k + 1} AS MATERIALIZED (SELECT variable, CASE WHEN fl < fr THEN l ELSE lo END AS lo, CASE WHEN fl < fr THEN hi ELSE r END AS hi FROM ("
                    f"SELECT variable, lo, hi, l, r, {llf('l')} AS fl, {llf('r')} AS fr FROM "
                    f"(SELECT *, hi - {g} * (hi - lo) AS l, lo + {g} * (hi - lo) AS r FROM yg{k}) JOIN yjl USING (variable) GROUP BY variable, lo, hi, l, r))")
    ctes.append(f"yjb AS MATERIALIZED (SELECT variable, round((lo + hi) / 2, {prep.YJ_PLACES}) AS best FROM yg{rounds})")
    return ctes


@register("yeo_johnson_lambda", with_clients(
    "SELECT variable, best AS lambda FROM yjb", FT, SPLIT_CTE, FT_SPLIT, TRAIN, *yj_ctes()))
def q_yeo_johnson_lambda(spark, d):
    """Maximum-likelihood Yeo-Johnson λ per bill column on the training split."""
    return prep.yeo_johnson_lambdas(smp.train_part(_featured_split(spark, d)), BILL_COLS)


def _yj_apply_sql() -> str:
    lam = "yjb"
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, avg({_psi(f'CAST(t.{c} AS DOUBLE)', 'b.best')}) AS m, "
        f"stddev_pop({_psi(f'CAST(t.{c} AS DOUBLE)', 'b.best')}) AS sd FROM trf t, {lam} b WHERE b.variable = '{c}'"
        for c in BILL_COLS)
    sel = ", ".join(
        f"round(({_psi(f'CAST(f.{c} AS DOUBLE)', f'l{i}.best')} - s{i}.m) / (CASE WHEN s{i}.sd = 0 THEN 1.0 ELSE s{i}.sd END), 6) AS yj__{c}"
        for i, c in enumerate(BILL_COLS))
    joins = " ".join(f"JOIN {lam} l{i} ON l{i}.variable = '{c}' JOIN yjs s{i} ON s{i}.variable = '{c}'"
                     for i, c in enumerate(BILL_COLS))
    return f"SELECT f.ID, {sel} FROM fts f {joins}", f"yjs AS ({stats})"


YJ_APPLY = _yj_apply_sql()


@register("prep_yeo_johnson", with_clients(YJ_APPLY[0], FT, SPLIT_CTE, FT_SPLIT, TRAIN, *yj_ctes(), YJ_APPLY[1]))
def q_prep_yeo_johnson(spark, d):
    """Yeo-Johnson + standardization of the six bills, fitted on the training split."""
    fs = _featured_split(spark, d)
    model = prep.YeoJohnsonTransformer(inputCols=BILL_COLS, outputCols=[f"yj__{c}" for c in BILL_COLS]).fit(
        smp.train_part(fs))
    return model.transform(fs).select("ID", *[F.round(f"yj__{c}", 6).alias(f"yj__{c}") for c in BILL_COLS])
