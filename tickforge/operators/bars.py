"""Bars: rows sampled from a series of ticks, or aggregated from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import business_day, full, need, ordered, ratio, running, week_label
from .align import densify
from .fold import ImbalanceBars, Threshold, ordered_fold


def tick_bars(ticks: DataFrame, size: int, *, by: list[str], order: list[str]) -> DataFrame:
    """Each series' rows at positions 0, size, 2 * size and so on."""
    if size < 1:
        raise ValueError("size must be positive")
    return ticks.withColumn("__n", F.row_number().over(ordered(by, order))).filter((F.col("__n") - 1) % size == 0).drop("__n")


def threshold_ids(ticks: DataFrame, column: str, size: float, *, by: list[str], order: list[str]) -> DataFrame:
    """ticks with bar_id and closes: bars of a greedy threshold on the running sum of `column`, overshoot discarded."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema)
    return ordered_fold(ticks, by, order, lambda: Threshold(column, size), f"{names}, bar_id long, closes boolean")


def threshold_bars(ticks: DataFrame, column: str, size: float, *, by: list[str], order: list[str]) -> DataFrame:
    """The rows at which the running sum of `column` reaches size; a last, incomplete bar gives none."""
    return threshold_ids(ticks, column, size, by=by, order=order).filter("closes").drop("closes")


def imbalance_bars(ticks: DataFrame, *, by: list[str], order: list[str], price: str = "price", dollar: str = "dollar", first: int = 100, bars: int = 3, clip: tuple[float, float] | None = None) -> DataFrame:
    """Rows that close a dollar imbalance bar; see fold.ImbalanceBars."""
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema)
    return ordered_fold(ticks, by, order, lambda: ImbalanceBars(price, dollar, first, bars, clip), f"{names}, closes boolean").filter("closes").drop("closes")


def _ohlc(price: str, order: list[str]) -> list:
    o = F.struct(*order)
    return [F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close")]


def dollar_bars(ticks: DataFrame, threshold: float, *, by: list[str], order: list[str], price: str = "price", dollar: str = "dollar") -> DataFrame:
    """Open, high, low, close, dollar sum, ticks and times of greedy dollar bars; the last, partial bar is kept.

    Rows with a null or non-positive price or dollar do not count.
    """
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    need(ticks, price, dollar, *by, *order)
    good = ticks.filter((F.col(price) > 0) & (F.col(dollar) > 0))
    marked = threshold_ids(good, dollar, threshold, by=by, order=order)
    return marked.groupBy(*by, "bar_id").agg(*_ohlc(price, order), F.sum(dollar).alias("dollar"), F.count("*").alias("ticks"), F.min(order[0]).alias("start_time"), F.max(order[0]).alias("end_time"))


def flow_bars(trades: DataFrame, threshold: float, *, by: list[str], order: list[str], price: str = "price", dollar: str = "dollar", size: str = "vol", sign: str = "sign") -> DataFrame:
    """dollar_bars() with volume, mean signed size, sum of sign * sqrt(dollar), and log and price returns between bars."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    good = trades.filter((F.col(price) > 0) & (F.col(dollar) > 0) & F.col(sign).isNotNull() & F.col(size).isNotNull())
    marked = threshold_ids(good, dollar, threshold, by=by, order=order)
    bars = marked.groupBy(*by, "bar_id").agg(
        *_ohlc(price, order), F.sum(dollar).alias("dollar"), F.count("*").alias("ticks"), F.sum(size).alias("volume"),
        F.avg(F.col(sign) * F.col(size)).alias("mean_signed_size"), F.sum(F.col(sign) * F.sqrt(dollar)).alias("root_flow"), F.sum(F.col(sign) * F.col(size)).alias("signed_volume"),
    )
    w = ordered(by, ["bar_id"])
    return bars.withColumns({"log_return": F.ln("close") - F.ln(F.lag("close").over(w)), "price_return": F.col("close") - F.lag("close").over(w)})


def time_bars(ticks: DataFrame, unit: str, *, by: list[str], order: list[str], price: str = "price", sums: list[str] = ()) -> DataFrame:
    """Open, high, low, close and sums by calendar unit (hour, day, ...) or step ("5 minutes", "90 seconds"); empty ones give no row.

    Steps of less than a day begin at midnight of the first day of 1970, as those that divide a day do on every day.
    """
    need(ticks, price, *by, *order, *sums)
    at = F.col(order[0])
    time = F.window(at, unit)["start"] if unit[0].isdigit() else F.date_trunc(unit, at)
    return ticks.groupBy(*by, time.alias("time")).agg(*_ohlc(price, order), F.count("*").alias("ticks"), *[F.sum(c).alias(c) for c in sums])


def week_counts(bars: DataFrame, *, by: list[str], ts: str) -> DataFrame:
    """Rows in each week, labelled by the Sunday that ends it; weeks without rows between two others count 0."""
    return densify(bars.groupBy(*by, week_label(F.col(ts)).alias("week")).agg(F.count("*").alias("n")), by=by, period="week", step="7 days", fill={"n": 0})


def day_counts(bars: DataFrame, *, by: list[str], ts: str) -> DataFrame:
    return densify(bars.groupBy(*by, F.col(ts).cast("date").alias("day")).agg(F.count("*").alias("n")), by=by, period="day", step="1 day", fill={"n": 0})


def month_variances(returns: DataFrame, value: str, *, by: list[str], ts: str) -> DataFrame:
    """The variance over months of the variance within a month."""
    months = returns.groupBy(*by, F.date_trunc("month", F.col(ts)).alias("month")).agg(F.var_samp(value).alias("v"))
    return months.groupBy(*by).agg(F.var_samp("v").alias("variance_of_variances"), F.count("v").alias("months"))


def last_by(df: DataFrame, value: str, period: str, *, by: list[str], order: list[str]) -> DataFrame:
    """The last value of each period: day, week (its Sunday) or business (weekend rows count to Friday)."""
    ts = F.col(order[0])
    bucket = {"day": ts.cast("date"), "week": week_label(ts), "business": business_day(ts)}[period]
    return df.groupBy(*by, bucket.alias("period")).agg(F.max_by(value, F.struct(*order)).alias(value))


def roll_adjust(bars: DataFrame, *, by: list[str], order: list[str], open_: str = "open", close: str = "close", match_end: bool = True) -> DataFrame:
    """close less the running sum of gaps open - previous close; match_end makes the last gap sum zero. Adds rolled."""
    w = ordered(by, order)
    gap = F.coalesce(F.col(open_) - F.lag(close).over(w), F.lit(0.0))
    x = bars.withColumn("__gap", gap).withColumn("__gaps", F.sum("__gap").over(running(by, order)))
    shift = F.max_by("__gaps", F.struct(*order)).over(full(by)) if match_end else F.lit(0.0)
    return x.withColumn("rolled", F.col(close) - (F.col("__gaps") - shift)).drop("__gap", "__gaps")


def roll_returns(rolled: DataFrame, *, by: list[str], order: list[str], price: str = "rolled", close: str = "close") -> DataFrame:
    """Growth of 1 by returns of the rolled price over the raw price before; adds ret and wealth."""
    w = ordered(by, order)
    x = rolled.withColumn("ret", ratio(F.col(price) - F.lag(price).over(w), F.lag(close).over(w)))
    return x.withColumn("wealth", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(running(by, order))))


def pca_weights(returns: DataFrame, a: str, b: str, *, by: list[str], order: list[str], n: int = 100) -> DataFrame:
    """Weights of two legs with all risk on the least eigenvector of their rolling covariance, lagged one row, and their spread return.

    For a symmetric 2 x 2 matrix the eigenvector of the least eigenvalue m is (cov, m - var a),
    scaled so that absolute weights sum to 1.
    """
    w, at = ordered(by, order).rowsBetween(-(n - 1), 0), ordered(by, order)
    x = returns.withColumns({"__va": F.var_samp(a).over(w), "__vb": F.var_samp(b).over(w), "__c": F.covar_samp(a, b).over(w), "__n": F.count(F.col(a) + F.col(b)).over(w)})
    least = (F.col("__va") + F.col("__vb")) / 2 - F.sqrt(F.pow((F.col("__va") - F.col("__vb")) / 2, 2) + F.col("__c") * F.col("__c"))
    x = x.withColumns({"__x": F.col("__c"), "__y": least - F.col("__va")})
    norm = F.abs("__x") + F.abs("__y")
    ready = (F.col("__n") == n) & (norm > 0)
    x = x.withColumns({"__wa": F.when(ready, F.col("__x") / norm), "__wb": F.when(ready, F.col("__y") / norm)})
    x = x.withColumns({"weight_a": F.lag("__wa").over(at), "weight_b": F.lag("__wb").over(at)})
    x = x.withColumn("spread_return", F.col("weight_a") * F.col(a) + F.col("weight_b") * F.col(b))
    x = x.withColumn("spread", F.exp(F.sum(F.log1p(F.coalesce("spread_return", F.lit(0.0)))).over(running(by, order))))
    return x.select(*returns.columns, "weight_a", "weight_b", "spread_return", "spread")


