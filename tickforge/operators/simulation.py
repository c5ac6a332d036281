"""Mean-reverting prices, trading rules simulated on them, and mixtures fitted by moments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ordered, ratio


def ou_fit(series: DataFrame, price: str, *, by: list[str], order: list[str]) -> DataFrame:
    """Regression of price changes on the price before, per series: alpha, beta, kappa, theta, sigma, half_life, r2 and t of beta."""
    w = ordered(by, order)
    x = series.withColumn("__x", F.lag(price).over(w)).withColumn("__y", F.col(price) - F.col("__x")).filter("__x is not null")
    g = x.groupBy(*by).agg(F.regr_slope("__y", "__x").alias("beta"), F.regr_intercept("__y", "__x").alias("alpha"), F.regr_r2("__y", "__x").alias("r2"), F.count("*").alias("n"), F.regr_syy("__y", "__x").alias("__syy"), F.regr_sxx("__y", "__x").alias("__sxx"))
    rss = F.col("__syy") * (1 - F.col("r2"))
    g = g.withColumns({"kappa": -F.col("beta"), "theta": -F.try_divide(F.col("alpha"), F.col("beta")), "sigma": F.sqrt(rss / (F.col("n") - 1)), "half_life": F.when(F.col("beta") < 0, math.log(2) / -F.col("beta")), "t_beta": F.col("beta") / F.sqrt(rss / (F.col("n") - 2) / F.col("__sxx"))})
    return g.drop("__syy", "__sxx")


def rule_grid(spark: SparkSession, profits: list[float], losses: list[float], *, forecast: float, sigma: float, half_life: float | None = None, phi: float | None = None, paths: int = 100_000, longest: int = 100, start: float = 0.0, seed: int = 1, untouched: bool = False, block: int = 10_000) -> DataFrame:
    """(profit, loss, n, mean, std, sharpe) of exits from simulated paths, for each pair of barriers.

    A path moves as p = (1 - phi) forecast + phi p + sigma e until its gain passes the profit or falls
    below minus the loss, `longest` steps at most; paths that touch neither count only if untouched
    (at their last price). Pairs and blocks of paths are rows of one table, each block simulated with
    numpy from a seed of its own; sums are added up by pair. std divides by n; a pair with one exit
    or none gets zeros.
    """
    phi = 2 ** (-1.0 / half_life) if phi is None else phi
    pairs = spark.range(1).select(F.explode(F.array(*[F.lit(float(p)) for p in profits])).alias("profit")).select("profit", F.explode(F.array(*[F.lit(float(x)) for x in losses])).alias("loss"))
    blocks = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-paths // block) - 1))))
    spread = blocks.repartition(spark.sparkContext.defaultParallelism, "profit", "loss", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for profit, loss, b in pdf.itertuples(index=False):
                n = min(block, paths - b * block)
                rng = np.random.default_rng([seed, b, int(profit * 1e6), int(loss * 1e6)])
                p, live, exits = np.full(n, float(start)), np.arange(n), []
                for _ in range(longest):
                    p = (1 - phi) * forecast + phi * p + sigma * rng.standard_normal(len(p))
                    gain = p - start
                    gone = (gain > profit) | (gain < -loss)
                    exits.append(gain[gone])
                    p, live = p[~gone], live[~gone]
                    if not len(p):
                        break
                if untouched:
                    exits.append(p - start)
                x = np.concatenate(exits)
                out.append((profit, loss, len(x), float(x.sum()), float((x * x).sum())))
            yield pd.DataFrame(out, columns=["profit", "loss", "n", "s", "q"])

    sums = spread.mapInPandas(run, "profit double, loss double, n long, s double, q double").groupBy("profit", "loss").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = ratio(F.col("s"), F.col("n"))
    std = F.sqrt(F.greatest(ratio(F.col("q"), F.col("n")) - mean * mean, F.lit(0.0)))
    some = F.col("n") > 1
    return sums.select("profit", "loss", "n", F.when(some, mean).otherwise(0.0).alias("mean"), F.when(some, std).otherwise(0.0).alias("std"), F.when(some & (std > 0), ratio(mean, std)).otherwise(0.0).alias("sharpe"))


def best_rule(grid: DataFrame) -> DataFrame:
    """The pair of the greatest Sharpe ratio, the least profit and loss of equals."""
    best = F.max_by(F.struct(*grid.columns), F.struct("sharpe", -F.col("profit"), -F.col("loss")))
    return grid.agg(best.alias("b")).select("b.*")


# ---- mixtures of two normals by moments


def raw_moments(x: str, k: int = 5) -> list[Column]:
    return [F.avg(F.pow(F.col(x), i)).alias(f"m{i}") for i in range(1, k + 1)]


def central_moment(raw: list[float], k: int) -> float:
    """The k-th central moment from raw ones."""
    m = [1.0, *raw]
    return sum(math.comb(k, j) * (-1) ** (k - j) * m[j] * m[1] ** (k - j) for j in range(k + 1))


def raw_moment(central: list[float], mean: float) -> list[float]:
    """Raw moments from central ones (the first is 0) and the mean."""
    c = [1.0, *central]
    return [sum(math.comb(k, j) * c[j] * mean ** (k - j) for j in range(k + 1)) for k in range(1, len(c))]


def mixture_moments(mu: tuple[float, float], sigma: tuple[float, float], p: float) -> np.ndarray:
    """The first five raw moments of p N(mu0, sigma0) + (1 - p) N(mu1, sigma1)."""

    def one(m: float, s: float) -> np.ndarray:
        v = s * s
        return np.array([m, v + m**2, 3 * v * m + m**3, 3 * v * v + 6 * v * m**2 + m**4, 15 * v * v * m + 10 * v * m**3 + m**5])

    return p * one(mu[0], sigma[0]) + (1 - p) * one(mu[1], sigma[1])


def _step(m: np.ndarray, mu2: float, p: float, variant: int) -> tuple[float, float, float, float, float] | None:
    """One round of moment matching: (mu1, mu2, sigma1, sigma2, p) or None where it leaves the reals.

    With mu1 from the first moment, the second and third give both variances, and the fourth (or the
    fourth and fifth) a new mixing share (or second mean and share).
    """
    if not 0 < p < 1:
        return None
    q = 1 - p
    mu1 = (m[0] - q * mu2) / p
    gap = mu2 - mu1
    if gap == 0:
        return None
    # The third moment is linear in the second variance once the first one is eliminated by the second.
    v2 = (m[2] - 3 * mu1 * m[1] + 2 * p * mu1**3 + q * (3 * mu1 * mu2**2 - mu2**3)) / (3 * q * gap)
    v1 = (m[1] - q * (v2 + mu2**2)) / p - mu1**2
    if v1 < 0 or v2 < 0:
        return None
    fourth = lambda mu, v: 3 * v * v + 6 * v * mu**2 + mu**4
    fifth = lambda mu, v: 15 * v * v * mu + 10 * v * mu**3 + mu**5
    if variant == 1:
        below = fourth(mu1, v1) - fourth(mu2, v2)
        share = (m[3] - fourth(mu2, v2)) / below if below else -1.0
    else:
        if q < 1e-4:
            return None
        inner = 6 * v2 * v2 + (m[3] - p * fourth(mu1, v1)) / q
        square = math.sqrt(inner) - 3 * v2 if inner >= 0 else -1.0
        if square < 0:
            return None
        mu2 = math.sqrt(square)
        below = fifth(mu1, v1) - fifth(mu2, v2)
        share = (m[4] - fifth(mu2, v2)) / below if below else -1.0
    return (mu1, mu2, math.sqrt(v1), math.sqrt(v2), share) if 0 <= share <= 1 else None


def fit_mixture(moments: list[float], mu2: float, p: float, *, epsilon: float, variant: int = 1, rounds: int = 100_000) -> tuple[float, tuple] | None:
    """(squared error of moments, parameters) after rounds until p moves less than epsilon; None if a round fails."""
    if variant not in (1, 2):
        raise ValueError("variant must be 1 or 2")
    m, best = np.asarray(moments, float), None
    for _ in range(rounds):
        got = _step(m, mu2, p, variant)
        if got is None:
            return best
        error = float(((mixture_moments(got[:2], got[2:4], got[4]) - m) ** 2).sum())
        if best is None or error < best[0]:
            best = (error, got)
        if abs(got[4] - p) < epsilon:
            return best
        p, mu2 = got[4], got[1]
    return best


def ef3m(spark: SparkSession, moments: list[float], *, runs: int = 10, epsilon: float = 1e-3, factor: float = 5.0, variant: int = 1, seed: int = 1, rounds: int = 1000) -> DataFrame:
    """(run, mu1, mu2, sigma1, sigma2, p1, error): the best fit of each run over a grid of second means, from seeded first shares."""
    spread = math.sqrt(max(central_moment(moments, 2), 0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf["id"]:
                rng, best = np.random.default_rng([seed, int(r)]), None
                for i in range(1, int(1 / epsilon)):
                    got = fit_mixture(moments, moments[0] + i * epsilon * factor * spread, float(rng.uniform(0, 1)), epsilon=epsilon, variant=variant, rounds=rounds)
                    if got and (best is None or got[0] < best[0]):
                        best = got
                if best:
                    out.append((r, *best[1], best[0]))
            yield pd.DataFrame(out, columns=["run", "mu1", "mu2", "sigma1", "sigma2", "p1", "error"])

    ids = spark.range(runs).repartition(max(1, min(runs, spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(run, "run long, mu1 double, mu2 double, sigma1 double, sigma2 double, p1 double, error double")
