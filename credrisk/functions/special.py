"""Special functions as column expressions: regularised incomplete gamma and beta,
and the p-values of the t and chi-square tests built on them.

Series and continued fractions run as folds over a sequence, inside the JVM; they are
meant for small tables of test statistics (one row per feature), where some hundred
steps a row cost nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
# Coefficients of Stirling's series for ln gamma, B(2k) / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
SHIFT = 12          # the series is used from here on, smaller arguments are raised by the recurrence


def _value(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def ln_gamma(x) -> Column:
    """ln of the gamma function for x > 0."""
    x = _value(x)
    steps = F.greatest(F.lit(0), F.ceil(F.lit(float(SHIFT)) - x)).cast("int")
    lowered = F.aggregate(F.sequence(F.lit(0), steps), F.lit(0.0),
                          lambda acc, k: acc + F.when(k < steps, F.log(x + k)).otherwise(0.0))
    y = x + steps
    series = F.lit(0.0)
    for k, c in enumerate(STIRLING):
        series = series + c / F.pow(y, F.lit(2.0 * k + 1))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - lowered


def ln_beta_half(a) -> Column:
    """ln B(a, 1/2), without the difference of two large logarithms for large a."""
    a = _value(a)
    large = -0.5 * F.log(a) + 1 / (8 * a) - 1 / (192 * F.pow(a, F.lit(3.0))) + 1 / (640 * F.pow(a, F.lit(5.0)))
    return 0.5 * math.log(math.pi) + F.when(a > 200, large).otherwise(ln_gamma(a) - ln_gamma(a + 0.5))


def _fold(steps: Column, start: list, step) -> Column:
    """Last state of ``step(state, k)`` for k = 1 .. steps, over a struct of doubles."""
    names = [f"v{i}" for i in range(len(start))]
    pack = lambda values: F.struct(*[v.cast("double").alias(n) for v, n in zip(values, names, strict=True)])
    return F.aggregate(F.sequence(F.lit(1), steps.cast("int")), pack([_value(s) for s in start]),
                       lambda state, k: pack(step([state[n] for n in names], k)))


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _beta_fraction(x: Column, a: Column, b: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    d0 = 1 / _safe(1 - (a + b) * x / (a + 1))

    def step(state, k):
        c, d, h = state
        for numerator in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 / _safe(1 + numerator * d), _safe(1 + numerator / c)
            h = h * d * c
        return [c, d, h]
    return _fold(steps, [F.lit(1.0), d0, d0], step)["v2"]


def beta_inc_half(x, a) -> Column:
    """I_x(a, 1/2), the regularised incomplete beta function, for 0 <= x <= 1 and a > 0."""
    x, a, b = _value(x), _value(a), F.lit(0.5)
    front = F.exp(a * F.log(x) + b * F.log1p(-x) - ln_beta_half(a))
    steps = 40 + F.ceil(8 * F.sqrt(a))
    direct = front * _beta_fraction(x, a, b, steps) / a
    mirrored = 1 - front * _beta_fraction(1 - x, b, a, steps) / b
    return (F.when(x <= 0, 0.0).when(x >= 1, 1.0)
            .when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored))


def gamma_inc_upper(a, x) -> Column:
    """Q(a, x), the regularised upper incomplete gamma function, for a > 0 and x >= 0."""
    a, x = _value(a), _value(x)
    front = F.exp(a * F.log(x) - x - ln_gamma(a))
    steps = 60 + F.ceil(10 * F.sqrt(F.greatest(a, x)))
    series = _fold(steps, [1 / a, 1 / a], lambda s, k: [s[0] * x / (a + k), s[1] + s[0] * x / (a + k)])["v1"]
    b0 = x + 1 - a

    def step(state, k):
        c, d, h = state
        numerator, b = -k * (k - a), b0 + 2 * k
        d, c = 1 / _safe(b + numerator * d), _safe(b + numerator / c)
        return [c, d, h * d * c]
    fraction = _fold(steps, [F.lit(1 / TINY), 1 / _safe(b0), 1 / _safe(b0)], step)["v2"]
    return F.when(x <= 0, 1.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def t_test_p(t, df) -> Column:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom; NULL without any."""
    t, df = _value(t), _value(df)
    return F.when(df > 0, beta_inc_half(df / (df + t * t), df / 2))


def chi_square_p(statistic, dof) -> Column:
    """Upper-tail p-value of a chi-square statistic; NULL without a degree of freedom."""
    statistic, dof = _value(statistic), _value(dof)
    return F.when(dof > 0, gamma_inc_upper(dof / 2, statistic / 2))
