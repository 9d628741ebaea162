"""Tail probabilities of the normal, chi-square, F and t distributions.

Textbook algorithms (series and Lentz continued fractions for the regularized
incomplete gamma and beta functions).  They run on a handful of scalars per
test, inside Arrow-batched pandas UDFs (``*_udf``) so results stay DataFrames.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship this small module with the UDFs (pickled by value), so executors need no
# copy of the package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 3e-16
_TINY = 1e-300
# Terms after which an expansion counts as divergent: an error, not a result.
_DIVERGED = 50_000_000


def _not_converged(what: str, *args: float) -> ArithmeticError:
    return ArithmeticError(f"{what}{args} did not converge")


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _gamma_series(a: float, x: float) -> float:
    """Regularized lower incomplete gamma P(a, x) by its series (x < a + 1)."""
    term = total = 1.0 / a
    ap = a
    for _ in range(_DIVERGED):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    raise _not_converged("gamma series", a, x)


def _gamma_cf(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x) by continued fraction (x >= a + 1)."""
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _DIVERGED):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h
    raise _not_converged("gamma fraction", a, x)


def gammaincc(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or dof <= 0 or math.isnan(x):
        return float("nan")
    return gammaincc(dof / 2.0, x / 2.0)


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = 1.0
    d = 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _DIVERGED):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            return h
    raise _not_converged("beta fraction", a, b, x)


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _beta_cf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_sf2(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


# --- Arrow-batched wrappers (one call per batch of result rows) -------------
def _vec(fn, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in vals)
                      else fn(*[float(v) for v in vals]) for vals in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, dof)


@F.pandas_udf(DoubleType())
def f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_sf, f, d1, d2)


@F.pandas_udf(DoubleType())
def t_sf2_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _vec(t_sf2, t, dof)


@F.pandas_udf(DoubleType())
def norm_sf2_udf(z: pd.Series) -> pd.Series:
    return _vec(lambda v: 2.0 * norm_sf(abs(v)), z)
