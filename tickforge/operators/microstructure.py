"""Trade signs, spreads, volatility and price impact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, full_window, need, ordered, ratio, running, trailing


def tick_rule(ticks: DataFrame, price: str, *, by: list[str], order: list[str]) -> DataFrame:
    """sign: of the price change, else the last one that was not zero; 0 before the first."""
    w = ordered(by, order)
    change = F.signum(F.col(price) - F.lag(price).over(w))
    x = need(ticks, price).withColumn("__s", F.when(change != 0, change))
    return x.withColumn("sign", F.coalesce(F.last("__s", ignorenulls=True).over(running(by, order)), F.lit(0.0)).cast("int")).drop("__s")


def sign_accuracy(trades: DataFrame, predicted: str, truth: str, *, by: list[str]) -> DataFrame:
    """n and the share of rows whose two signs agree, among rows where both are known and not zero."""
    known = trades.filter((F.col(predicted) != 0) & (F.col(truth) != 0))
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("accuracy"))


def roll_model(ticks: DataFrame, price: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Variance and lag-1 covariance of price changes, the half and whole spread, and the variance of true changes."""
    w = ordered(by, order)
    x = ticks.withColumn("__d", F.col(price) - F.lag(price).over(w)).withColumn("__l", F.lag("__d").over(w))
    out = x.groupBy(*by).agg(F.var_samp("__d").alias("variance"), F.covar_samp("__d", "__l").alias("covariance"))
    half = F.sqrt(F.greatest(-F.col("covariance"), F.lit(0.0)))
    return out.withColumns({"half_spread": half, "spread": 2 * half, "true_variance": F.col("variance") + 2 * F.col("covariance")})


def parkinson(bars: DataFrame, *, by: list[str], high: str = "high", low: str = "low") -> DataFrame:
    """sqrt(mean ln(high / low)**2 / (4 ln 2)) over bars of positive prices; null if there is none."""
    r = F.when((F.col(high) > 0) & (F.col(low) > 0), F.ln(F.col(high) / F.col(low)))
    return bars.groupBy(*by).agg(F.sqrt(F.avg(r * r) / (4 * math.log(2))).alias("parkinson"))


def close_volatility(bars: DataFrame, *, by: list[str], order: list[str], close: str = "close") -> DataFrame:
    x = bars.withColumn("__r", F.ln(close) - F.ln(F.lag(close).over(ordered(by, order))))
    return x.groupBy(*by).agg(F.stddev_samp("__r").alias("close_volatility"))


def volatility_summary(bars: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    n = bars.groupBy(*by).agg(F.count("*").alias("bars"))
    return n.join(parkinson(bars, by=by), by).join(close_volatility(bars, by=by, order=order), by)


_K = 3 - 2 * math.sqrt(2)


def corwin_schultz(bars: DataFrame, *, by: list[str], order: list[str], n: int = 1, high: str = "high", low: str = "low") -> DataFrame:
    """bars with beta, gamma, alpha, spread and sigma of the high-low estimator; start_time is the bar before, where its window begins."""
    w = ordered(by, order)
    r = F.ln(F.col(high) / F.col(low))
    x = bars.withColumn("__r2", r * r)
    x = x.withColumn("__two", full_window(F.sum("__r2").over(trailing(by, order, 2)), "__r2", trailing(by, order, 2), 2))
    x = x.withColumn("beta", full_window(F.avg("__two").over(trailing(by, order, n)), "__two", trailing(by, order, n), n))
    h = full_window(F.max(high).over(trailing(by, order, 2)), high, trailing(by, order, 2), 2)
    low2 = F.min(low).over(trailing(by, order, 2))
    x = x.withColumn("gamma", F.pow(F.ln(h / low2), 2))
    root = F.sqrt(F.col("gamma") / _K)
    x = x.withColumn("alpha", clip((math.sqrt(2) - 1) * F.sqrt("beta") / _K - root, 0.0, None))
    e = F.exp("alpha")
    k2 = math.sqrt(8 / math.pi)
    sigma = (2**-0.5 - 1) * F.sqrt("beta") / (k2 * _K) + F.sqrt(F.col("gamma") / (k2**2 * _K))
    x = x.withColumns({"spread": 2 * (e - 1) / (1 + e), "sigma": clip(sigma, 0.0, None), "start_time": F.lag(order[0]).over(w)})
    return x.drop("__r2", "__two")


def slope(y: Column, x: Column) -> Column:
    """The least-squares slope without intercept over rows where both are known; null where x is all zero."""
    both = y.isNotNull() & x.isNotNull()
    return ratio(F.sum(F.when(both, x * y)), F.sum(F.when(both, x * x)))


def impact(bars: DataFrame, *, by: list[str]) -> DataFrame:
    """Kyle's, Amihud's and Hasbrouck's lambda of flow bars.

    Kyle: price return on mean signed size times volume, and on the bar's signed volume
    (kyle_signed). Amihud: absolute log return on dollars. Hasbrouck: log return on the sum of sign
    times root dollars. Each uses the rows where its own inputs are known.
    """
    return bars.groupBy(*by).agg(
        slope(F.col("price_return"), F.col("mean_signed_size") * F.col("volume")).alias("kyle"),
        slope(F.col("price_return"), F.col("signed_volume")).alias("kyle_signed"),
        slope(F.abs("log_return"), F.col("dollar")).alias("amihud"),
        slope(F.col("log_return"), F.col("root_flow")).alias("hasbrouck"),
    )


def describe_by(df: DataFrame, value: str, *, by: list[str]) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles and greatest of a column, by group."""
    q = [F.percentile(value, p).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), *q, F.max(value).alias("greatest"))


def share_table(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Shares of `columns` values within each value of `rows`."""
    x = df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return x.select(rows, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) / total).alias(str(v)) for v in values])


def minute_activity(trades: DataFrame, *, by: list[str], at: str, sums: list[str]) -> DataFrame:
    """trades with the number of trades and the sums in their minute."""
    minute = F.date_trunc("minute", F.col(at))
    agg = trades.groupBy(*by, minute.alias("minute")).agg(F.count("*").alias("minute_trades"), *[F.sum(c).alias(f"minute_{c}") for c in sums])
    return trades.withColumn("minute", minute).join(agg, [*by, "minute"], "left")
