"""Encodings of returns as symbols, and entropy of symbol sequences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite, full


def encode_binary(returns: DataFrame, x: str) -> DataFrame:
    """code: 1 above zero, 0 below; zeros and what is not finite go."""
    return returns.withColumn(x, finite(F.col(x))).filter((F.col(x) != 0) & F.col(x).isNotNull()).withColumn("code", (F.col(x) > 0).cast("int"))


def encode_product(returns: DataFrame, x: str, *, by: list[str], order: list[str]) -> DataFrame:
    """code: 1 where x times x of the row before is not negative, else 0; rows without one before go."""
    p = F.col(x) * F.lag(x).over(Window.partitionBy(*by).orderBy(*order))
    return returns.withColumn("code", (p >= 0).cast("int")).filter("code is not null")


def encode_quantile(returns: DataFrame, x: str, n: int, *, by: list[str]) -> DataFrame:
    """code: how many of the series' n - 1 inner quantiles (linear) are at most the value."""
    if n < 2:
        raise ValueError("n must be at least 2")
    good = returns.withColumn(x, finite(F.col(x))).filter(F.col(x).isNotNull())
    edges = good.groupBy(*by).agg(F.percentile(x, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("__edges"))
    return good.join(edges, by).withColumn("code", F.size(F.filter("__edges", lambda e: e <= F.col(x)))).drop("__edges")


def encode_sigma(returns: DataFrame, x: str, sigma: float, *, by: list[str]) -> DataFrame:
    """code: steps of sigma above the series' least value, at most ceil(range / sigma) - 1; 0 where the range is 0."""
    if not sigma > 0:
        raise ValueError("sigma must be positive")
    good = returns.withColumn(x, finite(F.col(x))).filter(F.col(x).isNotNull())
    low, high = F.min(x).over(full(by)), F.max(x).over(full(by))
    top = F.ceil((F.col("__high") - F.col("__low")) / sigma) - 1
    y = good.withColumns({"__low": low, "__high": high})
    code = F.when(F.col("__high") == F.col("__low"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("__low")) / sigma), top))
    return y.withColumn("code", F.greatest(code, F.lit(0)).cast("int")).drop("__low", "__high")


def words_of(symbols: DataFrame, code: str, width: int, *, by: list[str], order: list[str]) -> DataFrame:
    """(series, word): every run of `width` neighbouring codes, joined by commas."""
    if width < 1:
        raise ValueError("width must be positive")
    w = Window.partitionBy(*by).orderBy(*order)
    parts = [F.lag(F.col(code), k).over(w).cast("string") for k in range(width - 1, -1, -1)]
    return symbols.withColumn("word", F.when(parts[0].isNotNull(), F.concat_ws(",", *parts))).filter("word is not null").select(*by, "word")


def word_shares(words: DataFrame, *, by: list[str]) -> DataFrame:
    counts = words.groupBy(*by, "word").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(full(by)))


def plugin_entropy(symbols: DataFrame, code: str, width: int, *, by: list[str], order: list[str]) -> DataFrame:
    """Maximum-likelihood entropy in bits a symbol of words of `width` codes."""
    p = word_shares(words_of(symbols, code, width, by=by, order=order), by=by)
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p")) / width).alias("entropy"))


def match_length(s: np.ndarray, i: int, n: int) -> int:
    """1 + the longest run from place i that also begins at one of the n places before it (overlap allowed)."""
    best, m = 0, len(s)
    for j in range(i - n, i):
        k = 0
        while k < n and i + k < m and s[j + k] == s[i + k]:
            k += 1
        best = max(best, k)
    return best + 1


def window_matches(s: np.ndarray, n: int) -> np.ndarray:
    """match_length(s, i, n) of every i from n to len(s) - n: runs of equal symbols at each lag, all places at once."""
    m = len(s)
    best = np.zeros(m - 2 * n + 1, np.int64)
    for lag in range(1, n + 1):
        differ = np.append(s[:-lag] != s[lag:], True)
        stop = np.minimum.accumulate(np.where(differ, np.arange(len(differ)), len(differ))[::-1])[::-1]
        runs = stop - np.arange(len(stop))
        best = np.maximum(best, np.minimum(runs[n - lag : m - n - lag + 1], n))
    return best + 1


def kontoyiannis(symbols: np.ndarray, window: int | None = None) -> tuple[float, float]:
    """Entropy rate in bits from match lengths, and redundancy 1 - rate / log2(alphabet).

    With a window, n = min(window, len // 2) places before each of n .. len - n; without, all places
    before each of 1 .. len // 2.
    """
    m = len(symbols)
    if m < 2:
        raise ValueError("at least two symbols are needed")
    if window is None:
        places = range(1, m // 2 + 1)
        rate = sum(math.log2(i + 1) / match_length(symbols, i, i) for i in places) / len(places)
    else:
        n = min(window, m // 2)
        rate = float(np.mean(math.log2(n + 1) / window_matches(symbols, n)))
    letters = len(np.unique(symbols))
    return rate, (1 - rate / math.log2(letters) if letters > 1 else float("nan"))


def kontoyiannis_entropy(symbols: DataFrame, code: str, *, by: list[str], order: list[str], window: int | None = None) -> DataFrame:
    """(series, entropy, redundancy) of each series; give series or blocks that fit a task."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in symbols.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, r = kontoyiannis(pdf.sort_values(order)[code].to_numpy(), window)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "entropy": [h], "redundancy": [None if math.isnan(r) else r]})

    return symbols.groupBy(*by).applyInPandas(run, f"{keys}, entropy double, redundancy double")


def blocks(series: DataFrame, n: int, *, by: list[str], order: list[str]) -> DataFrame:
    """series with block 0 .. n - 1 of equal size; rows that do not fill a block go from the start."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = series.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(full(by))})
    size, head = F.floor(F.col("__n") / n), F.col("__n") % n
    return x.filter((F.col("__i") > head) & (size > 0)).withColumn("block", F.floor((F.col("__i") - head - 1) / size).cast("long")).drop("__i", "__n")


def share_entropy(weights: DataFrame, p: str, *, by: list[str]) -> DataFrame:
    """-sum p ln p of shares (nats), and its exponential, the effective number."""
    h = -F.sum(F.when(F.col(p) > 0, F.col(p) * F.ln(p)).otherwise(0.0))
    return weights.groupBy(*by).agg(h.alias("entropy")).withColumn("effective", F.exp("entropy"))


def gaussian_entropy(series: DataFrame, x: str, *, by: list[str]) -> DataFrame:
    """Differential entropy ln(2 pi e variance) / 2 (nats)."""
    return series.groupBy(*by).agg((0.5 * F.ln(F.lit(2 * math.pi * math.e) * F.var_samp(x))).alias("entropy"))
