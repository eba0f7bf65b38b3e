"""DuckDB SQL twins of the Spark queries (the driver's correctness oracle).

Only text is built here; nothing runs.  Every query starts from the ``clients``
CTE, which DuckDB derives from the driver's tables.
"""

from __future__ import annotations

from ..schema import (AGE_EDGES, AGE_LABELS, BILL_COLS, DEFAULT_LABELS, EDU_FALLBACK, EDU_LABELS,
                      MAR_FALLBACK, MAR_LABELS, PAY_AMT_COLS, PAY_COLS, PAY_STATUS_LABELS,
                      RATE_BAND_ELSE, RATE_BANDS, SEX_LABELS, TIER_ELSE, TIER_VERDICTS, TIERS)
from ..sources.clients import with_clients  # noqa: F401  (re-exported)


def q(name: str) -> str:
    return f'"{name}"'


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def case_map(col: str, mapping: dict, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    tail = f" ELSE {default}" if default is not None else ""
    return f"CASE {arms}{tail} END"


def clip(x: str, lo, hi) -> str:
    inner = x
    if lo is not None:
        inner = f"greatest({lo}, {inner})"
    if hi is not None:
        inner = f"least({hi}, {inner})"
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE {inner} END"


def ratio_or_zero(n: str, d: str, lo=None, hi=None) -> str:
    qv = f"(CAST({n} AS DOUBLE) / CAST(nullif({d}, 0) AS DOUBLE))"
    return f"CASE WHEN {n} IS NULL OR {d} IS NULL OR {d} = 0 THEN 0.0 ELSE {clip(qv, lo, hi)} END"


def row_sum(cols) -> str:
    return "(" + " + ".join(f"COALESCE({c}, 0)" for c in cols) + ")"


def row_mean(cols) -> str:
    n = "(" + " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in cols) + ")"
    return f"(CASE WHEN {n} = 0 THEN NULL ELSE CAST({row_sum(cols)} AS DOUBLE) / {n} END)"


def count_positive(cols) -> str:
    return "CAST(" + " + ".join(f"COALESCE(CAST({c} > 0 AS INTEGER), 0)" for c in cols) + " AS INTEGER)"


def features_select(variant: str) -> str:
    """Select list appending the engineered features of ``variant`` to clients."""
    tb = f"CAST({row_sum(BILL_COLS)} AS BIGINT)"
    tp = f"CAST({row_sum(PAY_AMT_COLS)} AS BIGINT)"
    if variant == "score":
        util_raw = "CASE WHEN LIMIT_BAL > 0 THEN CAST(BILL_AMT1 AS DOUBLE) / CAST(nullif(LIMIT_BAL, 0) AS DOUBLE) END"
        util = f"COALESCE({clip(util_raw, -1.0, 2.0)}, 0.0)"
        ratio_raw = f"CASE WHEN {tb} > 0 THEN CAST({tp} AS DOUBLE) / CAST(nullif({tb}, 0) AS DOUBLE) END"
        ratio = f"COALESCE({clip(ratio_raw, -2.0, 5.0)}, 0.0)"
    elif variant == "dash":
        util = ratio_or_zero("BILL_AMT1", "LIMIT_BAL", 0.0, 2.0)
        ratio = ratio_or_zero(tp, tb, 0.0, 5.0)
    else:
        util = ratio_or_zero("BILL_AMT1", "LIMIT_BAL", -1.0, 2.0)
        ratio = ratio_or_zero(tp, tb, -2.0, 5.0)
    parts = [f"{util} AS UTIL_RATE", f"{row_mean(PAY_COLS)} AS AVG_PAY_STATUS",
             f"{tb} AS TOTAL_BILL", f"{tp} AS TOTAL_PAY", f"{ratio} AS PAY_RATIO"]
    if variant != "dash":
        parts += ["BILL_AMT1 - BILL_AMT6 AS BILL_TREND", "PAY_AMT1 - PAY_AMT6 AS PAY_TREND",
                  f"greatest({', '.join(PAY_COLS)}) AS MAX_PAY_DELAY",
                  f"{count_positive(PAY_COLS)} AS CONSEC_LATE"]
    if variant == "score":
        parts.append(f"{util} AS CREDIT_USAGE_RATIO")
    return ", ".join(parts)


def features_cte(name: str, variant: str, source: str = "clients") -> str:
    return f"{name} AS (SELECT *, {features_select(variant)} FROM {source})"


# --- recodes -----------------------------------------------------------------
SEX_LABEL = case_map("GENDER", SEX_LABELS)
EDU_LABEL = case_map("EDUCATION", EDU_LABELS, lit(EDU_FALLBACK))
MAR_LABEL = case_map("MARRIAGE", MAR_LABELS, lit(MAR_FALLBACK))
DEFAULT_LABEL = case_map('"DEFAULT"', DEFAULT_LABELS)


def age_group(col: str = "AGE") -> str:
    arms = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {lit(lab)}"
                    for lo, hi, lab in zip(AGE_EDGES[:-1], AGE_EDGES[1:], AGE_LABELS))
    return f"CASE {arms} END"


def age_group_ord(col: str = "AGE") -> str:
    arms = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {i}"
                    for i, (lo, hi) in enumerate(zip(AGE_EDGES[:-1], AGE_EDGES[1:]), start=1))
    return f"CASE {arms} END"


def pay_status_label(col: str = "PAY_0") -> str:
    return case_map(col, PAY_STATUS_LABELS, f"CAST({col} AS VARCHAR)")


def rate_band(x: str) -> str:
    arms = " ".join(f"WHEN {x} > {b} THEN {lit(lab)}" for b, lab in RATE_BANDS)
    return f"CASE {arms} ELSE {lit(RATE_BAND_ELSE)} END"


def risk_tier(x: str) -> str:
    arms = " ".join(f"WHEN {x} < {b} THEN {lit(lab)}" for b, lab in TIERS)
    return f"CASE {arms} ELSE {lit(TIER_ELSE)} END"


def tier_verdict(x: str) -> str:
    return case_map(x, TIER_VERDICTS)


def stack(rows: list[list[tuple[str, str]]], source: str) -> str:
    """UNION ALL of one select per row (the SQL form of ``inline(array(struct))``)."""
    return "\nUNION ALL\n".join(
        "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in row) + f" FROM {source}"
        for row in rows)
