"""Distribution and dependence statistics by series."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import full, full_window, ordered, trailing


def autocorrelation(df: DataFrame, x: str, lag: int, *, by: list[str], order: list[str]) -> DataFrame:
    """Correlation of x with itself `lag` rows before, over pairs where both are known."""
    y = df.withColumn("__l", F.lag(x, lag).over(ordered(by, order)))
    return y.groupBy(*by).agg(F.corr(x, "__l").alias("autocorrelation"))


def rolling_autocorrelation(df: DataFrame, x: str, n: int, lag: int, *, by: list[str], order: list[str]) -> DataFrame:
    """Autocorrelation within windows of n rows: the correlation of the n - lag pairs that lie in each. Null until there are so many."""
    y = df.withColumn("__l", F.lag(x, lag).over(ordered(by, order)))
    w = trailing(by, order, n - lag)
    return y.withColumn("autocorrelation", full_window(F.corr(x, "__l").over(w), "__l", w, n - lag)).drop("__l")


def acf(df: DataFrame, x: str, lags: int, *, by: list[str], order: list[str]) -> DataFrame:
    """(series, lag, acf) for lags 0 .. lags, with the mean and sum of squares of all values."""
    y = df.filter(F.col(x).isNotNull()).withColumn("__d", F.col(x) - F.avg(x).over(full(by)))
    w = ordered(by, order)
    terms = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("__d") * F.lag("__d", k).over(w)).alias("s")) for k in range(lags + 1)])
    each = y.withColumn("__t", terms).select(*by, (F.col("__d") * F.col("__d")).alias("__q"), F.explode("__t").alias("t"))
    g = each.groupBy(*by, F.col("t.lag").alias("lag")).agg(F.sum("t.s").alias("__s"), F.sum("__q").alias("__v"))
    return g.select(*by, "lag", F.try_divide("__s", "__v").alias("acf"))


def jarque_bera(df: DataFrame, x: str, *, by: list[str]) -> DataFrame:
    """skewness (of the population), excess kurtosis, their joint statistic and its chi-square p-value with two degrees."""
    g = df.groupBy(*by).agg(F.count(x).alias("__n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("excess_kurtosis"))
    s, k = F.col("skewness"), F.col("excess_kurtosis")
    g = g.withColumn("jarque_bera", F.col("__n") / 6.0 * (s * s + k * k / 4))
    return g.withColumn("p_value", F.exp(-F.col("jarque_bera") / 2)).drop("__n")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int, *, by: list[str]) -> DataFrame:
    """(series, bin, n): counts of `bins` equal bins from low to high; the last one holds high."""
    own = df.filter((F.col(x) >= low) & (F.col(x) <= high))
    at = F.least(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return own.groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, x: str, *, by: list[str]) -> DataFrame:
    c = df.groupBy(*by, x).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(full(by)))


def regression(df: DataFrame, y: str, x: str, *, by: list[str]) -> DataFrame:
    """alpha, beta, r2 and residual deviation (n - 2 degrees) of y on x and a constant."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    g = df.groupBy(*by).agg(F.regr_slope(a, b).alias("beta"), F.regr_intercept(a, b).alias("alpha"), F.regr_r2(a, b).alias("r2"), F.regr_syy(a, b).alias("__s"), F.regr_count(a, b).alias("__n"))
    return g.withColumn("residual_std", F.sqrt(F.col("__s") * (1 - F.col("r2")) / (F.col("__n") - 2))).drop("__s", "__n")


def student_p(t: float, free: int) -> float:
    """Two-sided p-value of a t statistic with `free` degrees of freedom, by the finite series of its angle.

    Above 100,000 degrees the normal tail with its first correction stands in, which differs by less than 1e-9.
    """
    if t != t or free < 1:
        return math.nan
    if free > 100_000:
        return math.erfc(abs(t) * (1 - 1 / (4 * free)) / math.sqrt(1 + t * t / (2 * free)) / math.sqrt(2))
    angle = math.atan(abs(t) / math.sqrt(free))
    sine, cosine = math.sin(angle), math.cos(angle)
    odd = free % 2
    term, total = cosine if odd else 1.0, 0.0
    for k in range(1 + odd, free, 2):  # powers of the cosine up to free - 2
        total += term
        term *= cosine * cosine * k / (k + 1)
    inside = 2 / math.pi * (angle + sine * total) if odd else sine * total
    return min(1.0, max(0.0, 1.0 - inside))


def regression_tests(df: DataFrame, y: str, x: str, *, by: list[str]) -> DataFrame:
    """regression() with n, the slope's standard error, t statistic and two-sided p-value. One small row a series meets Python."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    spread = df.groupBy(*by).agg(F.regr_sxx(a, b).alias("__sxx"), F.regr_count(a, b).alias("n"))
    fit = regression(df, y, x, by=by)
    own = fit.join(spread, by) if by else fit.crossJoin(F.broadcast(spread))
    own = own.withColumn("beta_se", F.col("residual_std") / F.sqrt("__sxx")).withColumn("t", F.try_divide("beta", "beta_se")).drop("__sxx")

    @F.pandas_udf("double")
    def p(t: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([student_p(u, int(v)) for u, v in zip(t, free, strict=True)], dtype=float)

    return own.withColumn("p_value", p(F.col("t"), (F.col("n") - 2).cast("double")))
