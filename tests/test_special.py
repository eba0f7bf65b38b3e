"""p-values against tabulated values and closed forms."""
import math

import pytest
from pyspark.sql import functions as F

from credrisk.functions import special as sp


def column(spark, expr, rows, names):
    return [r[0] for r in spark.createDataFrame(rows, names).select(expr).collect()]


def test_ln_gamma_and_beta(spark):
    xs = [0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 11.99, 12.0, 50.5, 1e3, 1e6]
    got = column(spark, sp.ln_gamma(F.col("x")), [(x,) for x in xs], "x double")
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-13)
    got = column(spark, sp.ln_beta_half(F.col("x")), [(x,) for x in xs[:9]], "x double")
    assert got == pytest.approx([math.lgamma(x) + math.lgamma(0.5) - math.lgamma(x + 0.5) for x in xs[:9]], abs=1e-12)


def t_closed_form(t, df):
    """Two-sided p for whole df by the finite trigonometric series."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        term, total = c, 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 1 - 2 / math.pi * (theta + s * total)
    term, total = 1.0, 0.0
    for k in range(df // 2):
        total += term
        term *= c * c * (2 * k + 1) / (2 * k + 2)
    return 1 - s * total


def test_t_p_values(spark):
    # critical values of the published tables: (df, t, two-sided p)
    table = [(1, 12.706, 0.05), (2, 4.303, 0.05), (5, 2.571, 0.05), (10, 2.228, 0.05), (30, 2.042, 0.05), (120, 1.980, 0.05), (10, 3.169, 0.01), (30, 3.646, 0.001)]
    got = column(spark, sp.t_test_p(F.col("t"), F.col("df")), [(d, t) for d, t, _ in table], "df long, t double")
    assert got == pytest.approx([p for *_, p in table], rel=2e-3)
    cases = [(df, t) for df in (1, 2, 3, 4, 7, 10, 29, 100, 1498, 29_998) for t in (0.0, 0.01, 0.5, 1.0, 1.7, 1.96, 2.5, 4.0, 9.0, -2.0)]
    got = column(spark, sp.t_test_p(F.col("t"), F.col("df")), cases, "df long, t double")
    assert got == pytest.approx([t_closed_form(t, df) for df, t in cases], abs=1e-9)
    normal = [(10**9, t) for t in (0.3, 1.0, 1.959963984540054, 3.0)]
    got = column(spark, sp.t_test_p(F.col("t"), F.col("df")), normal, "df long, t double")
    assert got == pytest.approx([math.erfc(t / math.sqrt(2)) for _, t in normal], abs=1e-8)
    assert column(spark, sp.t_test_p(F.col("t"), F.col("df")), [(0, 1.0), (5, None)], "df long, t double") == [None, None]


def chi_closed_form(x, k):
    if k % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (k - 1) // 2 + 1):
        out += term
        term *= x / (2 * i + 1)
    return out


def test_chi_square_p_values(spark):
    table = [(1, 3.841, 0.05), (2, 5.991, 0.05), (3, 7.815, 0.05), (6, 12.592, 0.05), (10, 18.307, 0.05), (1, 6.635, 0.01), (4, 18.467, 0.001)]
    got = column(spark, sp.chi_square_p(F.col("x"), F.col("k")), [(x, k) for k, x, _ in table], "x double, k int")
    assert got == pytest.approx([p for *_, p in table], rel=2e-3)
    cases = [(x, k) for k in (1, 2, 3, 5, 6, 12, 33, 100) for x in (0.0, 1e-6, 0.3, 1.0, 2.9, 7.0, 30.0, 120.0)]
    got = column(spark, sp.chi_square_p(F.col("x"), F.col("k")), cases, "x double, k int")
    assert got == pytest.approx([chi_closed_form(x, k) for x, k in cases], abs=1e-9)
    assert column(spark, sp.chi_square_p(F.col("x"), F.col("k")), [(1.0, 0), (None, 3)], "x double, k int") == [None, None]
