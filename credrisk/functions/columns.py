"""Null-safe column expressions used across the library.

Spark runs in ANSI mode: ``x / 0`` raises, ``a + NULL`` is NULL and
``greatest``/``least`` skip NULLs.  These helpers pin the semantics the
analyses need (missing terms count as 0 in sums, skipped in means / max,
zero divisors give 0 instead of the clip bound).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x, lo: float | None, hi: float | None) -> Column:
    """``least(hi, greatest(lo, x))`` that keeps NULL as NULL."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def ratio_or_zero(num, den, lo: float | None = None, hi: float | None = None) -> Column:
    """``num / den`` clipped to [lo, hi]; 0 when either side is NULL or den is 0."""
    num, den = col(num), col(den)
    q = num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
    return F.when(num.isNull() | den.isNull() | (den == 0), F.lit(0.0)).otherwise(clip(q, lo, hi))


def row_sum(cols) -> Column:
    """Row sum with missing terms counted as 0."""
    return reduce(add, [F.coalesce(col(c), F.lit(0)) for c in cols])


def row_count_nonnull(cols) -> Column:
    return reduce(add, [F.when(col(c).isNull(), 0).otherwise(1) for c in cols])


def row_mean(cols) -> Column:
    """Row mean skipping missing terms; NULL when all are missing."""
    n = row_count_nonnull(cols)
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(row_sum(cols).cast("double") / n)


def row_max(cols) -> Column:
    """Row maximum skipping missing terms (``greatest`` skips NULL)."""
    return F.greatest(*[col(c) for c in cols])


def count_positive(cols) -> Column:
    """Number of terms that are > 0; missing terms do not count."""
    return reduce(add, [F.coalesce((col(c) > 0).cast("int"), F.lit(0)) for c in cols])


def lookup(c, mapping: dict, default=None) -> Column:
    """Literal dictionary recode; ``default`` (a value or Column) when unmatched."""
    c = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def sigmoid(z) -> Column:
    return 1.0 / (1.0 + F.exp(-col(z)))
