"""Queries over the client records: ingest, features, recodes, profiles,
group rates, distributions and correlations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.features import log1p_cols, with_features
from ..functions.recode import age_group, age_group_ord, with_labels
from ..operators import association as assoc
from ..operators import distribution as dist
from ..operators import ingest as ing
from ..operators import profile as prof
from ..operators import rates
from ..operators.intervals import band_lookup
from ..schema import (BILL_COLS, CORR_COLS, DOMAINS, FEATURES, HIST_BINS, HIST_BINS_FEATURES,
                      HIST_COLS, PAY_AMT_COLS, PAY_COLS, PROFILE_COLS, PROFILE_FEATURES, RAW_TARGET,
                      TOP_K_IMPORTANCES)
from ..session import cut_lineage
from ..sources.clients import client_view
from . import oracle_sql as S
from .catalog import clients, featured, register
from .oracle_sql import with_clients

ENGINEERED_TRAIN = ["UTIL_RATE", "AVG_PAY_STATUS", "TOTAL_BILL", "TOTAL_PAY", "PAY_RATIO",
                    "BILL_TREND", "PAY_TREND", "MAX_PAY_DELAY", "CONSEC_LATE"]
FEATURE_CORR_COLS = ["LIMIT_BAL", "AGE", "PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5", "PAY_6",
                     "BILL_AMT1", "PAY_AMT1", "UTIL_RATE", "PAY_RATIO", "AVG_PAY_STATUS",
                     "TOTAL_BILL", "TOTAL_PAY"]
CLIENT_COLS = (["ID", "LIMIT_BAL", "GENDER", "EDUCATION", "MARRIAGE", "AGE"] + PAY_COLS + BILL_COLS
               + PAY_AMT_COLS + ['"DEFAULT"'])


# --- ingest, matrix, alignment, casts ------------------------------------------
@register("ingest", with_clients("SELECT * FROM clients"))
def q_ingest(spark, d):
    """Client records after rename (SEX→GENDER, target→DEFAULT), ID kept."""
    return clients(spark, d)


_fm_cols = ", ".join(["ID"] + [f"COALESCE({c}, 0) AS {c}" for c in FEATURES]
                     + ['CAST("DEFAULT" AS INTEGER) AS "DEFAULT"', 'CAST("DEFAULT" AS DOUBLE) AS label'])


@register("feature_matrix", with_clients(f"SELECT {_fm_cols} FROM ft", S.features_cte("ft", "train")))
def q_feature_matrix(spark, d):
    """32-feature training frame, missing as 0, integer target and double label."""
    return ing.feature_matrix(featured(spark, d, "train"))


@register("align_features", with_clients(
    "SELECT ID, " + ", ".join(FEATURES) + " FROM fs", S.features_cte("fs", "score")))
def q_align_features(spark, d):
    """Score-variant frame projected onto the default 32-name model feature list."""
    return ing.align_features(featured(spark, d, "score"), None)


_DASH_HAS = ["UTIL_RATE", "AVG_PAY_STATUS", "TOTAL_BILL", "TOTAL_PAY", "PAY_RATIO"]


@register("align_features_absent", with_clients(
    "SELECT ID, " + ", ".join(c if c in _DASH_HAS or c not in ENGINEERED_TRAIN else f"0 AS {c}" for c in FEATURES) + " FROM fd",
    S.features_cte("fd", "dash")))
def q_align_features_absent(spark, d):
    """Dashboard frame, which lacks four of the model's features, projected onto its list: they become 0."""
    return ing.align_features(featured(spark, d, "dash"), None)


_dash_label_sel = (f"{S.SEX_LABEL} AS SEX_LABEL, {S.EDU_LABEL} AS EDU_LABEL, {S.MAR_LABEL} AS MAR_LABEL, "
                   f"{S.DEFAULT_LABEL} AS DEFAULT_LABEL, {S.age_group()} AS AGE_GROUP, "
                   f"{S.age_group_ord()} AS AGE_GROUP_ORD")
_DASH_CTE = f"dash AS (SELECT *, {_dash_label_sel}, {S.features_select('dash')} FROM clients)"
_DASH_NUMERIC = ([c.strip('"') for c in CLIENT_COLS]
                 + ["AGE_GROUP_ORD", "UTIL_RATE", "AVG_PAY_STATUS", "TOTAL_BILL", "TOTAL_PAY", "PAY_RATIO"])
_cast_sel = ", ".join(
    [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _DASH_NUMERIC]
    + [f"CAST({c} AS VARCHAR) AS {c}" for c in ("SEX_LABEL", "EDU_LABEL", "MAR_LABEL", "DEFAULT_LABEL", "AGE_GROUP")])


def dashboard_frame(spark, d):
    return with_features(with_labels(clients(spark, d)), "dash")


@register("cast_numeric", with_clients(f"SELECT {_cast_sel} FROM dash", _DASH_CTE))
def q_cast_numeric(spark, d):
    """Dashboard frame with every numeric column as double, labels as string."""
    return ing.cast_numeric(dashboard_frame(spark, d))


# --- features ---------------------------------------------------------------------
@register("features_train", with_clients(
    "SELECT ID, " + ", ".join(ENGINEERED_TRAIN) + " FROM ft", S.features_cte("ft", "train")))
def q_features_train(spark, d):
    """Nine engineered features, training definitions (clip floors −1 / −2)."""
    return featured(spark, d, "train").select("ID", *ENGINEERED_TRAIN)


@register("features_dashboard", with_clients(
    "SELECT ID, UTIL_RATE, AVG_PAY_STATUS, TOTAL_BILL, TOTAL_PAY, PAY_RATIO FROM fd",
    S.features_cte("fd", "dash")))
def q_features_dashboard(spark, d):
    """Five dashboard features (clip floors 0)."""
    return featured(spark, d, "dash").select(
        "ID", "UTIL_RATE", "AVG_PAY_STATUS", "TOTAL_BILL", "TOTAL_PAY", "PAY_RATIO")


@register("features_score", with_clients(
    "SELECT ID, " + ", ".join(ENGINEERED_TRAIN + ["CREDIT_USAGE_RATIO"]) + " FROM fs",
    S.features_cte("fs", "score")))
def q_features_score(spark, d):
    """Scoring-form features: divisors must be positive, plus CREDIT_USAGE_RATIO."""
    return featured(spark, d, "score").select("ID", *ENGINEERED_TRAIN, "CREDIT_USAGE_RATIO")


@register("prep_log1p", with_clients(
    "SELECT ID, " + ", ".join(f"round(ln(1 + {c}), 9) AS {c}" for c in PAY_AMT_COLS) + " FROM clients"))
def q_prep_log1p(spark, d):
    """log(1 + x) on the six payment amounts (9 dp)."""
    out = log1p_cols(clients(spark, d).select("ID", *PAY_AMT_COLS), PAY_AMT_COLS)
    return out.select("ID", *[F.round(c, 9).alias(c) for c in PAY_AMT_COLS])


# --- recodes ------------------------------------------------------------------------
@register("recode_labels", with_clients(
    f"SELECT ID, {S.SEX_LABEL} AS SEX_LABEL, {S.EDU_LABEL} AS EDU_LABEL, {S.MAR_LABEL} AS MAR_LABEL, "
    f"{S.DEFAULT_LABEL} AS DEFAULT_LABEL FROM clients"))
def q_recode_labels(spark, d):
    """Readable sex / education / marriage / default labels (with fallbacks)."""
    return with_labels(clients(spark, d)).select("ID", "SEX_LABEL", "EDU_LABEL", "MAR_LABEL", "DEFAULT_LABEL")


@register("age_group", with_clients(
    f"SELECT ID, AGE, {S.age_group()} AS AGE_GROUP, {S.age_group_ord()} AS age_group_ord FROM clients"))
def q_age_group(spark, d):
    """Right-closed age bins (20,25] … (60,80]; outside → NULL; with bin order."""
    return clients(spark, d).select("ID", "AGE", age_group().alias("AGE_GROUP"),
                                    age_group_ord().alias("age_group_ord"))


@register("pay_status_distribution", with_clients(
    f"SELECT PAY_0 AS pay_status, COUNT(*) AS count, {S.pay_status_label('PAY_0')} AS label "
    "FROM clients WHERE PAY_0 IS NOT NULL GROUP BY PAY_0 ORDER BY PAY_0"))
def q_pay_status_distribution(spark, d):
    """Latest repayment-status counts in status order, with status text."""
    return prof.pay_status_distribution(clients(spark, d))


# --- profile --------------------------------------------------------------------------
@register("kpi_summary", with_clients(
    f"SELECT COUNT(*) AS total_clients, {len(CLIENT_COLS)} AS n_columns, "
    'round(avg(CAST("DEFAULT" AS DOUBLE)) * 100, 4) AS default_rate_pct, '
    f"round(avg(CAST(LIMIT_BAL AS DOUBLE)), 4) AS avg_limit_bal, {len(FEATURES)} AS n_features FROM clients"))
def q_kpi_summary(spark, d):
    """Total clients, columns, default rate, average limit and number of features."""
    return prof.kpi_summary(clients(spark, d), len(FEATURES))


@register("null_profile", with_clients(S.stack(
    [[("column_name", S.lit(c.strip('"'))), ("n_missing", f"CAST(count_if({c} IS NULL) AS BIGINT)")]
     for c in CLIENT_COLS], "clients")))
def q_null_profile(spark, d):
    """Missing values per column."""
    return prof.null_profile(clients(spark, d))


@register("duplicate_ids", with_clients(
    "SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_distinct_ids, "
    "CAST(SUM(n - 1) AS BIGINT) AS n_duplicate_rows FROM (SELECT ID, COUNT(*) AS n FROM clients GROUP BY ID)"))
def q_duplicate_ids(spark, d):
    """Rows, distinct IDs and surplus rows of duplicated IDs."""
    return prof.duplicate_ids(clients(spark, d))


def _summary_sql(cols, source: str) -> str:
    rows = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        rows.append([
            ("variable", S.lit(c)), ("count", f"COUNT({c})"),
            ("mean", f"round(avg({x}), 4)"), ("std", f"round(stddev_samp({x}), 4)"),
            ("min", f"round(min({x}), 4)"), ("p25", f"round(quantile_cont({x}, 0.25), 4)"),
            ("median", f"round(quantile_cont({x}, 0.5), 4)"),
            ("p75", f"round(quantile_cont({x}, 0.75), 4)"), ("max", f"round(max({x}), 4)")])
    return S.stack(rows, source)


@register("profile_numeric", with_clients(_summary_sql(PROFILE_COLS, "clients")))
def q_profile_numeric(spark, d):
    """count, mean, std, min, exact quartiles, max of the 14 numeric columns."""
    return prof.numeric_summary(clients(spark, d), PROFILE_COLS)


@register("profile_features", with_clients(_summary_sql(PROFILE_FEATURES, "fd"), S.features_cte("fd", "dash")))
def q_profile_features(spark, d):
    """The same summary over the five dashboard features."""
    return prof.numeric_summary(featured(spark, d, "dash"), PROFILE_FEATURES)


@register("target_distribution", with_clients(
    f"SELECT DEFAULT_LABEL, COUNT(*) AS count FROM (SELECT {S.DEFAULT_LABEL} AS DEFAULT_LABEL FROM clients) "
    "WHERE DEFAULT_LABEL IS NOT NULL GROUP BY DEFAULT_LABEL ORDER BY count DESC"))
def q_target_distribution(spark, d):
    """Clients per default label, most frequent first."""
    return prof.target_distribution(clients(spark, d))


_zero = " + ".join(f"COALESCE(CAST({b} = 0 AS INTEGER), 0)" for b in BILL_COLS)


@register("zero_bill_profile", with_clients(
    f"SELECT zero_bill_months, COUNT(*) AS clients, CAST(SUM(\"DEFAULT\") AS BIGINT) AS defaults, "
    f"round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS default_rate_pct "
    f"FROM (SELECT *, CAST({_zero} AS INTEGER) AS zero_bill_months FROM clients) "
    "GROUP BY zero_bill_months ORDER BY zero_bill_months"))
def q_zero_bill_profile(spark, d):
    """Clients and default rate by number of zero-bill months."""
    return prof.zero_bill_profile(clients(spark, d))


# --- reshaping and checks ---------------------------------------------------------------
_months = [(i, p, b, a) for i, (p, b, a) in enumerate(zip(PAY_COLS, BILL_COLS, PAY_AMT_COLS), start=1)]


@register("monthly_long", with_clients(S.stack(
    [[("ID", "ID"), ("month", str(i)), ("pay_status", p), ("bill_amt", b), ("pay_amt", a)]
     for i, p, b, a in _months], "clients")))
def q_monthly_long(spark, d):
    """One row per client and month (month 1 = most recent)."""
    return ing.monthly_long(clients(spark, d))


@register("monthly_pay_ratio", with_clients(S.stack(
    [[("ID", "ID"), ("month", str(i)), ("monthly_pay_ratio", f"round({S.ratio_or_zero(a, b)}, 6)")]
     for i, p, b, a in _months], "clients")))
def q_monthly_pay_ratio(spark, d):
    """Per client and month: payment ÷ bill, 0 for a zero or missing bill."""
    return ing.monthly_pay_ratio(clients(spark, d))


def _domain_sql() -> str:
    raw_name = {"SEX": "GENDER", RAW_TARGET: '"DEFAULT"'}
    rows = []
    for c, dom in DOMAINS.items():
        x = raw_name.get(c, c)
        if isinstance(dom, list):
            bad = f"{x} IS NOT NULL AND {x} NOT IN ({', '.join(map(str, dom))})"
        else:
            lo, hi = dom
            conds = ([f"{x} < {lo}"] if lo is not None else []) + ([f"{x} > {hi}"] if hi is not None else [])
            bad = f"{x} IS NOT NULL AND ({' OR '.join(conds)})"
        rows.append([("column_name", S.lit(c)), ("n_rows", "COUNT(*)"),
                     ("n_null", f"CAST(count_if({x} IS NULL) AS BIGINT)"),
                     ("n_out_of_domain", f"CAST(count_if({bad}) AS BIGINT)")])
    return S.stack(rows, "clients")


@register("domain_check", with_clients(_domain_sql()))
def q_domain_check(spark, d):
    """Per raw column: rows, NULLs and values outside the data dictionary."""
    return ing.domain_check(client_view(spark, d))


# --- group default rates -------------------------------------------------------------------
def _rate_sql(label_expr: str, name: str) -> str:
    return with_clients(
        f"SELECT {name}, round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS default_rate_pct, "
        f"COUNT(\"DEFAULT\") AS count FROM (SELECT *, {label_expr} AS {name} FROM clients) "
        f"WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY {name}")


@register("default_rate_by_sex", _rate_sql(S.SEX_LABEL, "SEX_LABEL"))
def q_rate_sex(spark, d):
    """Default rate and count by sex label."""
    return rates.default_rate_breakdown(clients(spark, d), "sex")


@register("default_rate_by_education", _rate_sql(S.EDU_LABEL, "EDU_LABEL"))
def q_rate_edu(spark, d):
    """Default rate and count by education label."""
    return rates.default_rate_breakdown(clients(spark, d), "education")


@register("default_rate_by_marriage", _rate_sql(S.MAR_LABEL, "MAR_LABEL"))
def q_rate_mar(spark, d):
    """Default rate and count by marital-status label."""
    return rates.default_rate_breakdown(clients(spark, d), "marriage")


@register("default_rate_by_age", with_clients(
    "SELECT AGE_GROUP, age_group_ord, round(m * 100, 1) AS default_rate_pct, count, "
    f"{S.rate_band('round(m * 100, 1)')} AS band FROM ("
    f"SELECT {S.age_group()} AS AGE_GROUP, {S.age_group_ord()} AS age_group_ord, "
    'avg(CAST("DEFAULT" AS DOUBLE)) AS m, COUNT("DEFAULT") AS count FROM clients '
    "GROUP BY 1, 2) WHERE AGE_GROUP IS NOT NULL ORDER BY age_group_ord"))
def q_rate_age(spark, d):
    """Default rate by observed age group in bin order, 1 dp, with severity band."""
    return rates.default_rate_by_age(clients(spark, d))


@register("default_rate_breakdowns", with_clients(
    "SELECT breakdown, level, round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS default_rate_pct, "
    "COUNT(\"DEFAULT\") AS count FROM ("
    f"SELECT 'sex' AS breakdown, {S.SEX_LABEL} AS level, \"DEFAULT\" FROM clients UNION ALL "
    f"SELECT 'education', {S.EDU_LABEL}, \"DEFAULT\" FROM clients UNION ALL "
    f"SELECT 'marriage', {S.MAR_LABEL}, \"DEFAULT\" FROM clients UNION ALL "
    f"SELECT 'age_group', {S.age_group()}, \"DEFAULT\" FROM clients UNION ALL "
    "SELECT 'total', NULL, \"DEFAULT\" FROM clients) "
    "WHERE level IS NOT NULL OR breakdown = 'total' GROUP BY breakdown, level"))
def q_rate_breakdowns(spark, d):
    """All default-rate breakdowns in one GROUPING SETS aggregation."""
    return rates.default_rate_breakdowns(clients(spark, d))


# --- distributions ---------------------------------------------------------------------------
def _hist_sql(cols, n_bins: int, source: str) -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT {S.lit(c)} AS variable, CAST({c} AS DOUBLE) AS value, {S.DEFAULT_LABEL} AS DEFAULT_LABEL FROM {source}"
        for c in cols)
    return (
        f"SELECT variable, bin, round(lo + bin * (hi - lo) / {n_bins}, 6) AS bin_lo, "
        f"round(lo + (bin + 1) * (hi - lo) / {n_bins}, 6) AS bin_hi, DEFAULT_LABEL, COUNT(*) AS count FROM ("
        f"SELECT l.variable, l.DEFAULT_LABEL, r.lo, r.hi, CAST(CASE WHEN r.hi - r.lo = 0 THEN 0 ELSE "
        f"least({n_bins - 1}, floor((l.value - r.lo) * {n_bins} / (r.hi - r.lo))) END AS INTEGER) AS bin "
        f"FROM long_values l JOIN (SELECT variable, min(value) AS lo, max(value) AS hi FROM long_values "
        f"GROUP BY variable) r USING (variable)) GROUP BY variable, bin, DEFAULT_LABEL, lo, hi",
        f"long_values AS (SELECT * FROM ({long}) WHERE value IS NOT NULL)")


_h = _hist_sql(HIST_COLS, HIST_BINS, "fd")


@register("histogram_by_class", with_clients(_h[0], S.features_cte("fd", "dash"), _h[1]))
def q_histogram_by_class(spark, d):
    """50 equal-width bins per variable, counts by default label."""
    return dist.histogram_by_class(featured(spark, d, "dash"), HIST_COLS, HIST_BINS)


_hf = _hist_sql(PROFILE_FEATURES, HIST_BINS_FEATURES, "fd")


@register("histogram_features", with_clients(_hf[0], S.features_cte("fd", "dash"), _hf[1]))
def q_histogram_features(spark, d):
    """40 equal-width bins per engineered feature, counts by default label."""
    return dist.histogram_by_class(featured(spark, d, "dash"), PROFILE_FEATURES, HIST_BINS_FEATURES)


def _box_sql(cols, source: str) -> str:
    long = "\nUNION ALL\n".join(
        f"SELECT {S.lit(c)} AS variable, CAST({c} AS DOUBLE) AS value, {S.DEFAULT_LABEL} AS DEFAULT_LABEL FROM {source}"
        for c in cols)
    return with_clients(
        "SELECT variable, DEFAULT_LABEL, COUNT(*) AS n, round(min(value), 4) AS min, round(q1, 4) AS q1, "
        "round(median, 4) AS median, round(q3, 4) AS q3, round(max(value), 4) AS max, "
        "round(lf, 4) AS lower_fence, round(uf, 4) AS upper_fence, "
        "round(min(CASE WHEN value >= lf AND value <= uf THEN value END), 4) AS whisker_lo, "
        "round(max(CASE WHEN value >= lf AND value <= uf THEN value END), 4) AS whisker_hi, "
        "CAST(count_if(NOT (value >= lf AND value <= uf)) AS BIGINT) AS n_outliers "
        "FROM lv JOIN (SELECT variable, DEFAULT_LABEL, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lf, "
        "q3 + 1.5 * (q3 - q1) AS uf FROM (SELECT variable, DEFAULT_LABEL, quantile_cont(value, 0.25) AS q1, "
        "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM lv "
        "GROUP BY variable, DEFAULT_LABEL)) f USING (variable, DEFAULT_LABEL) "
        "GROUP BY variable, DEFAULT_LABEL, q1, median, q3, lf, uf",
        S.features_cte("fd", "dash"),
        f"lv AS (SELECT * FROM ({long}) WHERE value IS NOT NULL AND DEFAULT_LABEL IS NOT NULL)")


@register("box_by_class", _box_sql(HIST_COLS, "fd"))
def q_box_by_class(spark, d):
    """Box statistics (quartiles, fences, whiskers, outliers) per variable and class."""
    return dist.box_by_class(featured(spark, d, "dash"), HIST_COLS)


# --- correlations ------------------------------------------------------------------------------
def _r_sql(a: str, b: str) -> tuple[str, str]:
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    xm, ym = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    r = f"covar_pop({xm}, {ym}) / nullif(stddev_pop({xm}) * stddev_pop({ym}), 0)"
    return r, f"COUNT(CASE WHEN {both} THEN 1 END)"


def _corr_matrix_sql(cols) -> str:
    qc = [('"DEFAULT"' if c == "DEFAULT" else c) for c in cols]
    rows = []
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            r, n = _r_sql(qc[i], qc[j])
            rows.append([("x", S.lit(a)), ("y", S.lit(b)), ("r", f"round({r}, 6)"), ("n", n)])
            if a != b:
                rows.append([("x", S.lit(b)), ("y", S.lit(a)), ("r", f"round({r}, 6)"), ("n", n)])
    return S.stack(rows, "clients")


@register("corr_matrix", with_clients(_corr_matrix_sql(CORR_COLS)))
def q_corr_matrix(spark, d):
    """Pearson matrix of the 21 dashboard columns as (x, y, r, n)."""
    return assoc.corr_matrix(clients(spark, d), CORR_COLS)


def _corr_target_sql(cols, source: str) -> str:
    rows = []
    for c in cols:
        r, n = _r_sql(c, '"DEFAULT"')
        rows.append([("feature", S.lit(c)), ("r", f"round({r}, 6)"), ("n", n)])
    return (f"SELECT *, CASE WHEN r > 0 THEN 'raises risk' ELSE 'lowers risk' END AS direction "
            f"FROM ({S.stack(rows, source)})")


_TARGET_COLS = [c for c in CORR_COLS if c != "DEFAULT"]


@register("corr_with_target", with_clients(_corr_target_sql(_TARGET_COLS, "clients") + " ORDER BY abs(r), feature"))
def q_corr_with_target(spark, d):
    """r of the 20 raw columns with DEFAULT, ascending by |r|."""
    return assoc.corr_with_target(clients(spark, d), CORR_COLS)


@register("corr_features_with_target", with_clients(
    _corr_target_sql(FEATURE_CORR_COLS, "fd") + " ORDER BY abs(r) DESC, feature", S.features_cte("fd", "dash")))
def q_corr_features(spark, d):
    """r of 15 features (raw + engineered) with DEFAULT, descending by |r|."""
    return assoc.corr_with_target(featured(spark, d, "dash"), FEATURE_CORR_COLS + ["DEFAULT"], descending=True)


def _t_p_sql(t: str, df: str, steps: int = 4000) -> str:
    """Two-sided p of t by Simpson's rule over the density, substituted t = sqrt(df) tan(u)."""
    # the density becomes cos(u)^(df-1) / B(df/2, 1/2) for u in (-pi/2, pi/2)
    end = f"atan(abs({t}) / sqrt({df}))"
    area = (f"list_sum(list_transform(range({steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(cos(i * {end} / {steps}), {df} - 1))) * {end} / {steps} / 3")
    return f"greatest(0.0, 1 - 2 * ({area}) * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()))"


@register("corr_significance", with_clients(
    "SELECT feature, r, n, round(t, 4) AS t_stat, round(p, 6) AS p_value, p < 0.05 AS significant FROM ("
    f"SELECT *, CASE WHEN n > 2 THEN CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {_t_p_sql('t', '(n - 2)')} END END AS p FROM ("
    "SELECT *, r * sqrt((n - 2) / nullif(1 - r * r, 0)) AS t FROM ("
    + _corr_target_sql(_TARGET_COLS, "clients") + ")))"))
def q_corr_significance(spark, d):
    """t statistic of each correlation with DEFAULT, its two-sided p-value and a 5 % significance flag."""
    return assoc.corr_significance(assoc.corr_with_target(clients(spark, d), CORR_COLS))


@register("top_importances", with_clients(
    "SELECT feature, r, round(abs(r), 6) AS abs_r FROM (" + _corr_target_sql(FEATURE_CORR_COLS, "fd")
    + f") ORDER BY abs(r) DESC, feature LIMIT {TOP_K_IMPORTANCES}", S.features_cte("fd", "dash")))
def q_top_importances(spark, d):
    """Top 15 features by |r| with DEFAULT (association-based importance report)."""
    corr = assoc.corr_with_target(featured(spark, d, "dash"), FEATURE_CORR_COLS + ["DEFAULT"])
    return assoc.top_associations(corr, TOP_K_IMPORTANCES)


@register("top_training_features", with_clients(
    "SELECT feature, r, round(abs(r), 6) AS abs_r FROM (" + _corr_target_sql(FEATURES, "ft")
    + f") WHERE r IS NOT NULL ORDER BY abs(r) DESC, feature LIMIT {TOP_K_IMPORTANCES}", S.features_cte("ft", "train")))
def q_top_training_features(spark, d):
    """The 15 of the 32 training features with the largest |r| with DEFAULT."""
    corr = assoc.corr_with_target(featured(spark, d, "train"), [*FEATURES, "DEFAULT"])
    return assoc.top_associations(corr.where("r is not null"), TOP_K_IMPORTANCES)


_BANDS_SQL = ("limit_bands AS (SELECT EDUCATION, lag(LIMIT_BAL) OVER (PARTITION BY EDUCATION ORDER BY LIMIT_BAL) AS lo, LIMIT_BAL AS hi, "
              "round(avg(CAST(\"DEFAULT\" AS DOUBLE)) * 100, 4) AS label FROM clients GROUP BY EDUCATION, LIMIT_BAL)")


@register("limit_band_rate", with_clients(
    "SELECT f.ID, f.EDUCATION, round(f.TOTAL_BILL / 6.0, 4) AS mean_bill, b.label AS peer_rate_pct FROM ft f LEFT JOIN limit_bands b "
    "ON b.EDUCATION = f.EDUCATION AND (b.lo IS NULL OR f.TOTAL_BILL / 6.0 > b.lo) AND f.TOTAL_BILL / 6.0 <= b.hi",
    S.features_cte("ft", "train"), _BANDS_SQL))
def q_limit_band_rate(spark, d):
    """Default rate of the clients of equal education whose limit is the next one from a client's mean bill
    upwards: a lookup in a table of bands, one per education and distinct limit."""
    rate = F.round(F.avg(F.col("DEFAULT").cast("double")) * 100, 4).alias("label")
    limits = clients(spark, d).groupBy("EDUCATION", F.col("LIMIT_BAL").alias("hi")).agg(rate)
    below = F.lag("hi").over(Window.partitionBy("EDUCATION").orderBy("hi"))      # one row per distinct limit
    mean_bill = (F.col("TOTAL_BILL") / 6.0).alias("mean_bill")
    rows = featured(spark, d, "train").select("ID", "EDUCATION", mean_bill)
    found = band_lookup(rows, "mean_bill", cut_lineage(limits.withColumn("lo", below)), ["EDUCATION"])
    return found.select("ID", "EDUCATION", F.round("mean_bill", 4).alias("mean_bill"), F.col("label").alias("peer_rate_pct"))


__all__ = ["dashboard_frame"]


_CHI_COLS = ["GENDER", "EDUCATION", "MARRIAGE"]


def _chi_p_sql(x: str, k: str, steps: int = 4000) -> str:
    """Upper tail of chi-square by Simpson's rule over the density of its square root."""
    end = f"sqrt({x})"
    area = (f"list_sum(list_transform(range({steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(i * {end} / {steps}, {k} - 1) * exp(-pow(i * {end} / {steps}, 2) / 2))) * {end} / {steps} / 3")
    return f"greatest(0.0, 1 - 2 * ({area}) / (pow(2, {k} / 2.0) * gamma({k} / 2.0)))"


def _chi_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, \"DEFAULT\" AS y FROM clients "
        f"WHERE {c} IS NOT NULL AND \"DEFAULT\" IS NOT NULL" for c in _CHI_COLS)
    return (
        f"SELECT feature, round(chi, 6) AS statistic, dof, round(CASE WHEN dof > 0 THEN {_chi_p_sql('chi', 'dof')} END, 6) AS p_value FROM ("
        "SELECT feature, SUM((COALESCE(o, 0) - e) * (COALESCE(o, 0) - e) / e) AS chi, "
        "CAST((max(k) - 1) * (max(m) - 1) AS INTEGER) AS dof FROM ("
        "SELECT g.feature, g.level, g.y, ce.o, CAST(g.r AS DOUBLE) * g.c / g.n AS e, g.k, g.m FROM ("
        "SELECT r.feature, r.level, c.y, r.r, c.c, t.n, t.k, t.m FROM "
        "(SELECT feature, level, COUNT(*) AS r FROM lv GROUP BY ALL) r JOIN "
        "(SELECT feature, y, COUNT(*) AS c FROM lv GROUP BY ALL) c USING (feature) JOIN "
        "(SELECT feature, COUNT(*) AS n, COUNT(DISTINCT level) AS k, COUNT(DISTINCT y) AS m FROM lv GROUP BY ALL) t "
        "USING (feature)) g LEFT JOIN (SELECT feature, level, y, COUNT(*) AS o FROM lv GROUP BY ALL) ce "
        "USING (feature, level, y)) GROUP BY feature)",
        f"lv AS ({parts})")


_chi = _chi_sql()


@register("chi_square_categoricals", with_clients(_chi[0], _chi[1]))
def q_chi_square(spark, d):
    """Pearson χ² statistic, dof and p-value of sex / education / marriage against DEFAULT."""
    return assoc.chi_square(clients(spark, d), _CHI_COLS)
