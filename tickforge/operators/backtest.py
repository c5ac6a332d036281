"""Bet sizes, backtest statistics and strategy risk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clip, full, ordered, ratio, running
from ..functions.normal import cdf, ppf
from .align import densify, sweep

#: Fixed value: the Euler-Mascheroni constant.
EULER = 0.5772156649015329


def probability_size(p: Column, classes: int = 2, side: Column | None = None) -> Column:
    """2 Phi(z) - 1 with z = (p - 1/K) / sqrt(p (1 - p)), times the side if given."""
    size = 2 * cdf((p - 1.0 / classes) / F.sqrt(p * (1 - p))) - 1
    return size if side is None else side * size


def discretise(m: Column, step: float) -> Column:
    """floor(m / step) * step, held to [-1, 1]."""
    return clip(F.floor(m / step) * step, -1.0, 1.0)


def active_bets(points: DataFrame, bets: DataFrame, *, by: list[str], at: str, start: str, end: str, size: str, width: int | None = None) -> DataFrame:
    """points with the number and mean size of bets active then, start <= time < end. width cuts series into stretches, see sweep()."""
    x = sweep(points, bets, by=by, at=at, start=start, end=end, sums={"__n": F.lit(1), "__s": F.col(size)}, closed="left", width=width)
    n = F.round("__n").cast("long")
    return x.withColumns({"n_active": n, "mean_size": F.when(n > 0, F.col("__s") / n).otherwise(0.0)}).drop("__n", "__s")


def budget_size(points: DataFrame, bets: DataFrame, *, by: list[str], at: str, start: str, end: str, side: str, width: int | None = None) -> DataFrame:
    """points with counts of active long and short bets, and size long / max(long) - short / max(short). width cuts series into stretches, see sweep()."""
    x = sweep(points, bets, by=by, at=at, start=start, end=end, sums={"n_long": (F.col(side) > 0).cast("int"), "n_short": (F.col(side) < 0).cast("int")}, closed="left", width=width)
    x = x.withColumns({c: F.round(c).cast("long") for c in ("n_long", "n_short")})
    most = x.groupBy(*by).agg(F.max("n_long").alias("__l"), F.max("n_short").alias("__s"))
    part = lambda c, m: F.coalesce(ratio(F.col(c), F.col(m)), F.lit(0.0))
    return x.join(most, by).withColumn("size", part("n_long", "__l") - part("n_short", "__s")).drop("__l", "__s")


def power_size(w: float, x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x), w)


def sigmoid_size(w: float, x: Column) -> Column:
    return x / F.sqrt(F.lit(w) + x * x)


def size_curve(x: float, m: float, kind: str = "sigmoid") -> float:
    """The omega at which divergence x has size m."""
    if not 0 < abs(m) < 1 or x == 0:
        raise ValueError("m must lie between 0 and 1 and x must not be 0")
    return x * x * (m**-2 - 1) if kind == "sigmoid" else math.log(abs(m)) / math.log(abs(x))


def target_position(w: float, forecast: Column, price: Column, most: int, kind: str = "sigmoid") -> Column:
    """Size of the divergence of forecast and price, as a whole number of up to `most`."""
    size = sigmoid_size if kind == "sigmoid" else power_size
    return (size(w, forecast - price) * most).cast("long")


def inverse_price(w: float, forecast: Column, m: Column, kind: str = "sigmoid") -> Column:
    """The price at which the size is m."""
    x = m * F.sqrt(F.lit(w) / (1 - m * m)) if kind == "sigmoid" else F.signum(m) * F.pow(F.abs(m), 1.0 / w)
    return forecast - x


def limit_price(target: Column, position: Column, forecast: Column, w: float, most: int, kind: str = "sigmoid") -> Column:
    """Mean price over the units from position to target, each at the price of its size; null if there are none."""
    step = F.when(target >= position, F.lit(1)).otherwise(F.lit(-1))
    units = F.sequence(F.least(F.abs(position + step), F.abs(target)).cast("long"), F.greatest(F.abs(position + step), F.abs(target)).cast("long"))
    total = F.aggregate(units, F.lit(0.0), lambda a, j: a + inverse_price(w, forecast, step * j / float(most), kind))
    return F.when(target != position, total / F.size(units))


def mixture_cdf(x: Column, mu1: float, mu2: float, s1: float, s2: float, p1: float) -> Column:
    return p1 * cdf((x - mu1) / s1) + (1 - p1) * cdf((x - mu2) / s2)


def mixture_size(c: Column, mu1: float, mu2: float, s1: float, s2: float, p1: float) -> Column:
    """(F(c) - F(0)) / (1 - F(0)) for c >= 0, else (F(c) - F(0)) / F(0)."""
    here, zero = mixture_cdf(c, mu1, mu2, s1, s2, p1), mixture_cdf(F.lit(0.0), mu1, mu2, s1, s2, p1)
    return F.when(c >= 0, (here - zero) / (1 - zero)).otherwise((here - zero) / zero)


# ---- statistics


def concentration(values: DataFrame, x: str, *, by: list[str]) -> DataFrame:
    """Herfindahl-Hirschman concentration (sum w**2 - 1/n) / (1 - 1/n) of x's shares; null for two values or fewer or a sum of zero."""
    agg = values.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("__s"), F.sum(F.col(x) * F.col(x)).alias("__q"))
    n, s, q = F.col("n"), F.col("__s"), F.col("__q")
    return agg.select(*by, "n", F.when((n > 2) & (F.abs(s) > 1e-12), (q / (s * s) - 1 / n) / (1 - 1 / n)).alias("hhi"))


def drawdowns(wealth: DataFrame, x: str, *, by: list[str], order: list[str], dollars: bool = False) -> DataFrame:
    """One row for each high-water mark with a fall below it: hwm, start, least, drawdown and years under water.

    Time under water runs to the next mark's start, or the last row, in years of 365 days. The first
    order column is a timestamp.
    """
    w = wealth.withColumn("hwm", F.max(x).over(running(by, order)))
    groups = w.groupBy(*by, "hwm").agg(F.min(x).alias("least"), F.min(order[0]).alias("start"))
    last = wealth.groupBy(*by).agg(F.max(order[0]).alias("__last"))
    deep = groups.filter(F.col("hwm") > F.col("least")).join(last, by)
    nxt = F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("start")), F.col("__last"))
    seconds = (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    fall = F.col("hwm") - F.col("least") if dollars else 1 - F.col("least") / F.col("hwm")
    return deep.withColumns({"drawdown": fall, "years": seconds / (365 * 86400)}).drop("__last")


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """Phi((SR - SR*) sqrt(n - 1) / sqrt(1 - skew SR + (kurtosis - 1) / 4 SR**2)); kurtosis of a normal is 3."""
    return cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr))


def deflated_benchmark(variance: Column, trials: Column) -> Column:
    """The greatest Sharpe ratio to expect of so many trials without skill."""
    return F.sqrt(variance) * ((1 - EULER) * ppf(1 - 1.0 / trials) + EULER * ppf(1 - 1.0 / (trials * math.e)))


def statistics(prices: DataFrame, price: str, *, by: list[str], order: list[str], per_year: float, risk_free: float = 0.015, target: float = 1.1, trial_variance: float = 0.5, trials: float = 100) -> DataFrame:
    """One row of statistics a series, from its prices (nulls left out).

    Concentration of gains, losses and rows by month (months without rows count 0); 95 % drawdown and
    years under water; mean return a year, of gains and of losses; Sharpe and information ratio
    (against a yearly risk-free rate); probabilistic Sharpe against the target, and deflated Sharpe
    against the best of so many trials. Thresholds are yearly, tests use the ratio of one row.
    """
    x = prices.filter(F.col(price).isNotNull())
    r = F.col(price) / F.lag(price).over(ordered(by, order)) - 1
    x = x.withColumn("__r", r)
    got = x.filter("__r is not null")
    out = got.groupBy(*by).agg(F.count("__r").alias("n"), F.avg("__r").alias("__m"), F.stddev_samp("__r").alias("__s"), F.skewness("__r").alias("__g3"), (F.kurtosis("__r") + 3).alias("__g4"), F.avg(F.when(F.col("__r") > 0, F.col("__r"))).alias("mean_gain"), F.avg(F.when(F.col("__r") < 0, F.col("__r"))).alias("mean_loss"))
    part = lambda df, c, name: concentration(df, c, by=by).select(*by, F.col("hhi").alias(name))
    months = densify(got.groupBy(*by, F.date_trunc("month", F.col(order[0])).cast("date").alias("month")).agg(F.count("*").alias("c")), by=by, period="month", step="1 month", fill={"c": 0})
    falls = drawdowns(x, price, by=by, order=order).groupBy(*by).agg(F.percentile("drawdown", 0.95).alias("drawdown95"), F.percentile("years", 0.95).alias("under_water95"))
    for more in (part(got.filter("__r > 0"), "__r", "hhi_gains"), part(got.filter("__r < 0"), "__r", "hhi_losses"), part(months, "c", "hhi_months"), falls):
        out = out.join(more, by, "left")
    one, root = ratio(F.col("__m"), F.col("__s")), math.sqrt(per_year)
    free = (1 + risk_free) ** (1 / per_year) - 1
    best = deflated_benchmark(F.lit(float(trial_variance)), F.lit(float(trials)))
    psr = lambda goal: probabilistic_sharpe(one, goal, F.col("n"), F.col("__g3"), F.col("__g4"))
    out = out.withColumns({"annual_return": F.col("__m") * per_year, "sharpe": one * root, "information_ratio": ratio(F.col("__m") - free, F.col("__s")) * root})
    out = out.withColumns({"psr": psr(F.lit(target / root)), "dsr_benchmark": best, "dsr_benchmark_row": best / root, "target_row": F.lit(target / root)})
    return out.withColumn("dsr", psr(F.col("dsr_benchmark_row"))).drop("__m", "__s", "__g3", "__g4")


def year_signed_growth(returns: DataFrame, r: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Long in even years, short in odd ones: signed returns and their growth."""
    sign = F.when(F.year(order[0]) % 2 == 0, 1.0).otherwise(-1.0)
    x = returns.withColumn("signed", F.col(r) * sign)
    return x.withColumn("wealth", F.exp(F.sum(F.log1p(F.coalesce("signed", F.lit(0.0)))).over(running(by, order))))


# ---- risk of a strategy with two outcomes


def sharpe_symmetric(p: Column, n: Column) -> Column:
    """(2p - 1) / (2 sqrt(p (1 - p))) * sqrt(n)."""
    return (2 * p - 1) / (2 * F.sqrt(p * (1 - p))) * F.sqrt(n)


def precision_symmetric(sr: Column, n: Column) -> Column:
    """The precision that gives sr in the symmetric case."""
    return (1 + F.sqrt(sr * sr / (n + sr * sr))) / 2


def sharpe(p: Column, n: Column, win: Column, loss: Column) -> Column:
    """((win - loss) p + loss) / ((win - loss) sqrt(p (1 - p))) * sqrt(n); loss is negative."""
    return ((win - loss) * p + loss) / ((win - loss) * F.sqrt(p * (1 - p))) * F.sqrt(n)


def implied_precision(sr: Column, n: Column, win: Column, loss: Column) -> Column:
    """The precision at which sharpe() is sr: the larger root of its square."""
    d = win - loss
    a = (n + sr * sr) * d * d
    b = (2 * n * loss - sr * sr * d) * d
    c = n * loss * loss
    return (-b + F.sqrt(b * b - 4 * a * c)) / (2 * a)


def implied_frequency(sr: Column, p: Column, win: Column, loss: Column) -> Column:
    """Bets a year at which sharpe() is sr; null where more bets cannot give it."""
    edge = (win - loss) * p + loss
    n = F.pow(sr * (win - loss), 2) * p * (1 - p) / F.pow(edge, 2)
    return F.when(F.signum(edge) == F.signum(sr), n)


def implied_win(sr: Column, p: Column, n: Column, loss: Column) -> Column:
    """The win at which sharpe() is sr."""
    k = sr * F.sqrt(p * (1 - p) / n)
    return loss * (k - (p - 1)) / (k - p)


def implied_loss(sr: Column, p: Column, n: Column, win: Column) -> Column:
    k = sr * F.sqrt(p * (1 - p) / n)
    return win * (p - k) / (p - 1 - k)


def failure_probability(bets: DataFrame, r: str, *, by: list[str], per_year: float, target: float, variance_scale: bool = True) -> DataFrame:
    """The chance that a strategy's precision is below the one its target Sharpe ratio needs.

    Phi((p* - p) / s) with s = p (1 - p), the variance, or its root if variance_scale is False.
    """
    x = bets.groupBy(*by).agg(F.avg((F.col(r) > 0).cast("double")).alias("precision"), F.avg(F.when(F.col(r) > 0, F.col(r))).alias("win"), F.avg(F.when(F.col(r) <= 0, F.col(r))).alias("loss"))
    need = implied_precision(F.lit(float(target)), F.lit(float(per_year)), F.col("win"), F.col("loss"))
    v = F.col("precision") * (1 - F.col("precision"))
    x = x.withColumn("needed", need)
    return x.withColumn("failure", cdf((F.col("needed") - F.col("precision")) / (v if variance_scale else F.sqrt(v))))


