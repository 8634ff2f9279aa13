"""Tail probabilities as column expressions: normal, beta, t, F, gamma and chi-square, in logarithms too.

Incomplete beta and gamma functions are continued fractions or series of positive terms, evaluated from their last term
inwards by ``aggregate``. Their number of terms grows with the root of the parameters, so large degrees of freedom
stay exact to about ten digits; logarithms hold tails far below the least double.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series eight places further on."""
    y = x + 8.0
    square = y * y
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * log(2 * pi) + series - F.ln(reduce(mul, [x + float(k) for k in range(1, 8)], x))


def _from_last(terms: Column, first: Column, step) -> Column:
    """Fold ``step(inner, n)`` from n = ``terms`` down to 1, beginning with ``first``."""
    return F.aggregate(F.sequence(terms.cast("int"), F.lit(1), F.lit(-1)), first, lambda inner, n: step(inner, n.cast("double")))


def _ln_beta_part(x: Column, y: Column, a: Column, b: Column) -> Column:
    """ln I_x(a, b) for x below (a + 1) / (a + b + 2), with y = 1 - x, by its continued fraction."""
    front = ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(y) - F.ln(a)

    def step(inner: Column, n: Column) -> Column:
        m = F.floor(n / 2)
        even = m * (b - m) * x / ((a + n - 1) * (a + n))
        odd = -(a + m) * (a + b + m) * x / ((a + n - 1) * (a + n))
        return 1 + F.when(n % 2 == 0, even).otherwise(odd) / inner

    terms = 60 + 6 * F.sqrt(F.greatest(a, b))
    return F.when(x <= 0, F.lit(float("-inf"))).otherwise(front - F.ln(_from_last(terms, F.lit(1.0), step)))


def ln_beta_tail(x: Column, y: Column, a: Column, b: Column) -> Column:
    """ln of the regularised incomplete beta function I_x(a, b); ``y`` is 1 - x, given apart so that neither is rounded away."""
    other = _ln_beta_part(y, x, b, a)
    return F.when(x * (a + b + 2) < a + 1, _ln_beta_part(x, y, a, b)).otherwise(F.when(y <= 0, F.lit(0.0)).otherwise(F.ln(-F.expm1(F.least(other, F.lit(-1e-300))))))


def ln_gamma_tail(s: Column, x: Column) -> Column:
    """ln of the regularised upper incomplete gamma function Q(s, x): series below s + 1, continued fraction above."""
    terms = 60 + 10 * F.sqrt(s)
    front = s * F.ln(x) - x - ln_gamma(s)
    series = _from_last(terms, F.lit(1.0), lambda inner, n: 1 + x / (s + n) * inner)
    lower = front - F.ln(s) + F.ln(series)
    fraction = _from_last(terms, x + 2 * F.floor(terms) + 1 - s, lambda inner, n: x + 2 * n - 1 - s - n * (n - s) / inner)
    return F.when(x <= 0, F.lit(0.0)).when(x < s + 1, F.ln(-F.expm1(F.least(lower, F.lit(-1e-300))))).otherwise(front - F.ln(fraction))


def ln_t_two_sided(t: Column, df: Column) -> Column:
    """ln P(abs(T) >= abs(t)) of Student's t."""
    square = t * t
    return ln_beta_tail(df / (df + square), square / (df + square), df / 2, F.lit(0.5))


def ln_f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """ln P(F >= f)."""
    return F.when(f <= 0, F.lit(0.0)).otherwise(ln_beta_tail(d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f), d2 / 2, d1 / 2))


def ln_chi2_upper(x: Column, df: Column) -> Column:
    """ln P(chi-square >= x)."""
    return ln_gamma_tail(df / 2, x / 2)


def with_p(ln_p: Column) -> dict[str, Column]:
    """Columns p and log10_p of a tail's logarithm."""
    return {"p": F.exp(ln_p), "log10_p": ln_p / log(10)}


def _shifted(x: Column, places: int, power: int) -> Column:
    """The sum of 1 / (x + k) ** power over the first ``places`` k."""
    return reduce(lambda s, k: s + 1 / F.pow(x + float(k), F.lit(power)), range(places), F.lit(0.0))


def digamma(x: Column) -> Column:
    """Derivative of ``ln_gamma`` for x > 0, to twelve digits or so."""
    y = x + 8.0
    q = 1 / (y * y)
    return F.ln(y) - 1 / (2 * y) - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - _shifted(x, 8, 1)


def trigamma(x: Column) -> Column:
    """Derivative of ``digamma``."""
    y = x + 8.0
    q = 1 / (y * y)
    return 1 / y + q / 2 + q / y * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66)))) + _shifted(x, 8, 2)


def _tetragamma(x: Column) -> Column:
    y = x + 8.0
    q = 1 / (y * y)
    return -q - q / y - q * q * (1 / 2 - q * (1 / 6 - q * (1 / 6 - q * 3 / 10))) - 2 * _shifted(x, 8, 3)


def inverse_trigamma(value: Column, steps: int = 40) -> Column:
    """The x at which ``trigamma`` is ``value`` > 0, by Newton's steps on its reciprocal, which is nearly straight, so they all fall short and never leave x > 0."""
    step = lambda x, _: x + trigamma(x) * (1 - trigamma(x) / value) / _tetragamma(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), 0.5 + 1 / value, step)
