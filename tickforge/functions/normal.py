"""Standard normal distribution as column expressions, and a full-precision UDF."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
_P, _A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Acklam's rational approximation of the quantile.
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients: tuple[float, ...], x: Column, last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:] + (() if last is None else (last,)):
        out = out * x + F.lit(c)
    return out


def cdf(x: Column) -> Column:
    """Phi(x) to about 1e-7, inside code generation."""
    z = F.abs(x) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_P) * z)
    tail = _horner(_A[::-1], t) * t * F.exp(-z * z)
    return F.when(x >= 0, F.lit(0.5) + F.lit(0.5) * (F.lit(1.0) - tail)).otherwise(F.lit(0.5) * tail)


def ppf(p: Column) -> Column:
    """The quantile of p in (0, 1) to about 1e-9 relative; null outside."""
    low, high = 0.02425, 1 - 0.02425
    q = F.sqrt(-2 * F.ln(F.when(p < low, p).otherwise(1 - p)))
    edge = _horner(_QC, q) / _horner(_QD, q, 1.0)
    c = p - 0.5
    r = c * c
    middle = _horner(_QA, r) * c / _horner(_QB, r, 1.0)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, edge).when(p > high, -edge).otherwise(middle)


def sql_cdf(x: str) -> str:
    """cdf() as SQL text."""
    z, t = f"(abs({x})/sqrt(2.0::DOUBLE))", f"(1.0::DOUBLE/(1.0::DOUBLE+{_P}::DOUBLE*(abs({x})/sqrt(2.0::DOUBLE))))"
    poly = f"{_A[4]}::DOUBLE"
    for c in _A[3::-1]:
        poly = f"({poly}*{t}+({c}::DOUBLE))"
    tail = f"({poly}*{t}*exp(-{z}*{z}))"
    return f"(CASE WHEN {x}>=0 THEN 0.5::DOUBLE+0.5::DOUBLE*(1.0::DOUBLE-{tail}) ELSE 0.5::DOUBLE*{tail} END)"


def sql_ppf(p: str) -> str:
    def horner(cs: tuple[float, ...], x: str, last: float | None = None) -> str:
        out = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:] + (() if last is None else (last,)):
            out = f"({out}*{x}+({c!r}::DOUBLE))"
        return out

    q = f"sqrt(-2*ln(CASE WHEN {p}<0.02425 THEN {p} ELSE 1-{p} END))"
    c = f"({p}-0.5)"
    r = f"({c}*{c})"
    edge = f"({horner(_QC, q)}/{horner(_QD, q, 1.0)})"
    return f"(CASE WHEN {p}<=0 OR {p}>=1 THEN NULL WHEN {p}<0.02425 THEN {edge} WHEN {p}>0.97575 THEN -{edge} ELSE {horner(_QA, r)}*{c}/{horner(_QB, r, 1.0)} END)"


def exact_cdf(x: Column) -> Column:
    """Phi(x) to full double precision, by an Arrow-batched UDF; prefer cdf() in hot paths."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore")

    return run(x)


def exact_ppf(p: Column) -> Column:
    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None, na_action="ignore").astype("float64")

    return run(p)
