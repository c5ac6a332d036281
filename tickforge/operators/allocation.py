"""Portfolio weights from moments that Spark aggregates; only the matrices of few assets are solved locally."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import full, ordered
from .bars import last_by


def period_returns(prices: DataFrame, price: str, period: str, *, by: list[str], order: list[str]) -> DataFrame:
    """(asset, period, ret): returns of each asset's last prices by day, week or business day."""
    last = last_by(prices, price, period, by=by, order=order)
    return last.withColumn("ret", F.col(price) / F.lag(price).over(ordered(by, ["period"])) - 1).filter("ret is not null").drop(price)


def moments(returns: DataFrame, asset: str, at: str, value: str = "ret") -> DataFrame:
    """(a, b, n, covariance, correlation) for each pair of assets over the times both have: a self-join on time, aggregated by pair."""
    x = returns.select(F.col(asset).alias("a"), F.col(at).alias("__t"), F.col(value).alias("__x"))
    y = returns.select(F.col(asset).alias("b"), F.col(at).alias("__t"), F.col(value).alias("__y"))
    return x.join(y, "__t").groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("__x", "__y").alias("covariance"), F.corr("__x", "__y").alias("correlation"))


def matrices(pairs: DataFrame, most: int = 2000) -> tuple[list, np.ndarray, np.ndarray]:
    """(assets, covariance, correlation) of moments(); refuses more than `most` assets, so what comes to the driver is bounded."""
    n = pairs.select("a").distinct().count()
    if n > most:
        raise ValueError(f"{n} assets are more than {most}")
    rows = pairs.collect()
    assets = sorted({r["a"] for r in rows})
    at = {a: i for i, a in enumerate(assets)}
    cov, corr = np.full((len(assets),) * 2, np.nan), np.full((len(assets),) * 2, np.nan)
    for r in rows:
        cov[at[r["a"]], at[r["b"]]], corr[at[r["a"]], at[r["b"]]] = r["covariance"], r["correlation"] if r["correlation"] is not None else np.nan
    return assets, cov, corr


def as_weights(spark: SparkSession, assets: list, weights: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(a, float(w)) for a, w in zip(assets, weights, strict=True)], "asset string, weight double")


def inverse_variance(returns: DataFrame, asset: str, value: str = "ret") -> DataFrame:
    v = returns.groupBy(asset).agg(F.try_divide(F.lit(1.0), F.var_samp(value)).alias("__i"))
    return v.select(F.col(asset).alias("asset"), (F.col("__i") / F.sum("__i").over(full([F.lit(1)]))).alias("weight"))


def equal_weight(returns: DataFrame, asset: str) -> DataFrame:
    a = returns.select(F.col(asset).alias("asset")).distinct()
    return a.withColumn("weight", 1.0 / F.count("*").over(full([F.lit(1)])))


# ---- hierarchical risk parity


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves in the order of a single-linkage tree, from the edges of a minimum spanning tree by length.

    Joining edges from the shortest up merges the same clusters as single linkage; the cluster that was
    made first (or the leaf of the lower number) stands left.
    """
    n = len(distance)
    best, near, inside, edges = distance[0].copy(), np.zeros(n, int), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((float(best[j]), int(near[j]), j))
        inside[j] = True
        closer = distance[j] < best
        best, near = np.where(closer, distance[j], best), np.where(closer, j, near)
    cluster = {i: (i, [i]) for i in range(n)}  # by leaf: the cluster's number and its leaves
    for number, (_, i, j) in enumerate(sorted(edges, key=lambda e: e[0]), n):
        (a, left), (b, right) = sorted((cluster[i], cluster[j]), key=lambda c: c[0])
        both = (number, left + right)
        for leaf in both[1]:
            cluster[leaf] = both
    return cluster[0][1]


def cluster_variance(cov: np.ndarray, items: list[int]) -> float:
    part = cov[np.ix_(items, items)]
    w = 1 / np.diag(part)
    w = w / w.sum()
    return float(w @ part @ w)


def risk_parity(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Weights by halving the leaf order again and again, each half weighed by the other's variance."""
    if len(cov) < 2 or cov.shape != corr.shape or not np.isfinite(corr).all():
        raise ValueError("two assets at least and finite square matrices are needed")
    distance = np.sqrt(np.clip((1 - corr) / 2, 0, 1))
    np.fill_diagonal(distance, 0)
    weights, todo = np.ones(len(cov)), [leaf_order(distance)]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        a, b = cluster_variance(cov, left), cluster_variance(cov, right)
        if a + b <= 0:
            raise ValueError("variances must be positive")
        weights[left] *= b / (a + b)
        weights[right] *= a / (a + b)
        todo += [left, right]
    return weights


# ---- mean and variance


def max_sharpe_long(mean: np.ndarray, cov: np.ndarray, risk_free: float = 0.0, rounds: int = 100) -> np.ndarray:
    """Long-only weights of the greatest Sharpe ratio: least y'Cy with (mean - r)'y = 1, y >= 0, by active sets."""
    m = np.asarray(mean, float) - risk_free
    if not (m > 0).any():
        w = np.zeros(len(m))
        w[int(m.argmax())] = 1.0
        return w
    free = m > 0
    for _ in range(rounds):
        y = np.zeros(len(m))
        y[free] = np.linalg.solve(cov[np.ix_(free, free)], m[free])
        if (y[free] < -1e-12).any():
            free = free & (y > 0)
            continue
        pull = m - cov @ y
        worst = int(np.where(free, -np.inf, pull).argmax())
        if free.all() or pull[worst] <= 1e-10:
            break
        free[worst] = True
    y = np.maximum(y, 0)
    return y / y.sum()


class CriticalLine:
    """The mean-variance frontier within bounds, as turning points from the greatest mean to the least variance.

    For a trade-off lam the weights of assets between their bounds solve C w = lam * mean + gamma with
    all weights summing to 1, so they are straight lines in lam until one meets a bound or a bound
    asset's condition (C w - lam mean - gamma) changes sign. Going down from lam = infinity, each such
    event changes one asset and is a turning point; at lam = 0 the variance is least.
    """

    def __init__(self, mean: np.ndarray, cov: np.ndarray, lower: np.ndarray | float = 0.0, upper: np.ndarray | float = 1.0):
        self.mean, self.cov, n = np.asarray(mean, float), np.asarray(cov, float), len(mean)
        self.lower, self.upper = np.broadcast_to(np.asarray(lower, float), n).copy(), np.broadcast_to(np.asarray(upper, float), n).copy()
        if (self.lower > self.upper).any() or self.lower.sum() > 1 + 1e-12 or self.upper.sum() < 1 - 1e-12:
            raise ValueError("the bounds leave no weights that sum to 1")
        # Bounds that differ a little keep two weights from meeting theirs at once, also at the start.
        self.upper += np.where(self.lower < self.upper, 1e-9 * np.arange(1, n + 1) / n, 0.0)
        self.points: list[tuple[float, np.ndarray]] = []
        self._solve()

    def _line(self, free: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """a, b, c, d: free weights are a + b * lam and gamma is c + d * lam."""
        f, held = np.flatnonzero(free), np.flatnonzero(~free)
        C = self.cov[np.ix_(f, f)]
        k = len(f)
        system = np.zeros((k + 1, k + 1))
        system[:k, :k], system[:k, k], system[k, :k] = C, -1.0, 1.0
        fixed = np.concatenate([-self.cov[np.ix_(f, held)] @ w[held], [1.0 - w[held].sum()]])
        slope = np.concatenate([self.mean[f], [0.0]])
        x = np.linalg.solve(system, np.column_stack([fixed, slope]))
        return x[:k, 0], x[:k, 1], x[k, 0], x[k, 1]

    def _solve(self) -> None:
        n = len(self.mean)
        w, free = self.lower.copy(), np.zeros(n, bool)
        for i in np.argsort(-self.mean, kind="stable"):
            room = 1 - w.sum()
            if room > self.upper[i] - self.lower[i] + 1e-15:
                w[i] = self.upper[i]
            else:
                w[i] += room
                free[i] = True
                break
        if not free.any():  # the upper bounds sum to 1
            free[int(self.mean.argmin())] = True
        lam, changed = np.inf, -1
        self.points.append((lam, w.copy()))
        for _ in range(20 * n + 20):
            a, b, c, d = self._line(free, w)
            f = np.flatnonzero(free)
            events = []
            # Falling lam moves a weight against its slope: with a positive one, to the lower bound.
            for x, y, i in zip(a, b, f, strict=True) if len(f) > 1 else ():
                if abs(y) > 1e-14:
                    bound = self.lower[i] if y > 0 else self.upper[i]
                    events.append(((bound - x) / y, i, bound))
            wa, wb = w.copy(), np.zeros(n)
            wa[f], wb[f] = a, b
            base, slope = self.cov @ wa - c, self.cov @ wb - self.mean - d
            for i in np.flatnonzero(~free & (self.lower < self.upper)):
                # At the lower bound the condition is >= 0 and fails below its root if its slope is positive.
                if abs(slope[i]) > 1e-14 and (slope[i] > 0) == (w[i] <= self.lower[i] + 1e-12):
                    events.append((-base[i] / slope[i], i, None))
            # The asset that just changed is at its root now; only a lower one counts for it.
            events = [e for e in events if 0 < e[0] < lam and (e[1] != changed or e[0] < lam * (1 - 1e-9))]
            nxt = max(events, key=lambda e: e[0], default=(0.0, -1, None))
            lam = max(nxt[0], 0.0)
            w[f] = a + b * lam
            self.points.append((lam, np.clip(w, self.lower, self.upper)))
            if lam <= 0 or nxt[1] < 0:
                return
            i, bound = nxt[1], nxt[2]
            changed = i
            if bound is None:
                free[i] = True
            else:
                free[i], w[i] = False, bound
        raise RuntimeError("the frontier did not end")

    def mean_of(self, w: np.ndarray) -> float:
        return float(w @ self.mean)

    def deviation(self, w: np.ndarray) -> float:
        return float(math.sqrt(max(w @ self.cov @ w, 0.0)))

    def min_volatility(self) -> np.ndarray:
        return self.points[-1][1]

    def max_sharpe(self, risk_free: float = 0.0, steps: int = 80) -> np.ndarray:
        """The best ratio over all segments between turning points, each searched by golden section."""
        ratio = lambda w: (self.mean_of(w) - risk_free) / max(self.deviation(w), 1e-300)
        best = max((w for _, w in self.points), key=ratio)
        g = (math.sqrt(5) - 1) / 2
        for (_, u), (_, v) in zip(self.points, self.points[1:], strict=False):
            low, high = 0.0, 1.0
            at = lambda t, u=u, v=v: u + t * (v - u)
            for _ in range(steps):
                x, y = high - g * (high - low), low + g * (high - low)
                low, high = (low, y) if ratio(at(x)) >= ratio(at(y)) else (x, high)
            best = max(best, at((low + high) / 2), key=ratio)
        return best

    def frontier(self, n: int = 100) -> list[tuple[float, float, np.ndarray]]:
        """(mean, deviation, weights) of n points along the frontier, spread over its segments."""
        out, share = [], max(1, n // max(1, len(self.points) - 1))
        for (_, u), (_, v) in zip(self.points, self.points[1:], strict=False):
            for t in np.linspace(0, 1, share, endpoint=False):
                w = u + t * (v - u)
                out.append((self.mean_of(w), self.deviation(w), w))
        w = self.points[-1][1]
        return [*out, (self.mean_of(w), self.deviation(w), w)]


def expected(returns: DataFrame, asset: str, value: str = "ret") -> dict:
    """Mean return of each asset."""
    return {r[0]: r[1] for r in returns.groupBy(asset).agg(F.avg(value)).collect()}


def price_moments(prices: DataFrame, asset: str, at: str, price: str) -> DataFrame:
    """moments() of price levels instead of returns."""
    return moments(prices, asset, at, price)


def allocate(returns: DataFrame, kind: str, *, asset: str, at: str, value: str = "ret", pairs: DataFrame | None = None) -> DataFrame:
    """(asset, weight) by inverse_variance, equal_weight, mean_variance, hierarchical, min_volatility or max_sharpe."""
    if kind == "inverse_variance":
        return inverse_variance(returns, asset, value)
    if kind == "equal_weight":
        return equal_weight(returns, asset)
    if kind not in ("mean_variance", "hierarchical", "min_volatility", "max_sharpe"):
        raise ValueError(f"unknown allocation: {kind}")
    assets, cov, corr = matrices(pairs if pairs is not None else moments(returns, asset, at, value))
    if kind == "hierarchical":
        return as_weights(returns.sparkSession, assets, risk_parity(cov, corr))
    by = expected(returns, asset, value)
    mean = np.array([by[a] for a in assets])
    if kind == "mean_variance":
        return as_weights(returns.sparkSession, assets, max_sharpe_long(mean, cov))
    line = CriticalLine(mean, cov)
    return as_weights(returns.sparkSession, assets, line.min_volatility() if kind == "min_volatility" else line.max_sharpe())


def correlation_of(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    return np.clip(cov / np.outer(s, s), -1, 1)


def rescale_spectrum(cov: np.ndarray, condition: float) -> np.ndarray:
    """cov with its small eigenvalues raised so that the largest is at most `condition` times the least; the trace stays."""
    values, vectors = np.linalg.eigh(cov)
    raised = np.maximum(values, values.max() / condition)
    raised *= values.sum() / raised.sum()
    return vectors @ np.diag(raised) @ vectors.T


def compare(weights: dict[str, DataFrame], base: str) -> DataFrame:
    """(asset, kind, weight, deviation): each allocation's weights and their difference from the base one's."""
    out = None
    for kind, w in weights.items():
        x = w.select("asset", F.lit(kind).alias("kind"), "weight")
        out = x if out is None else out.unionByName(x)
    b = weights[base].select("asset", F.col("weight").alias("__b"))
    return out.join(b, "asset", "left").withColumn("deviation", F.col("weight") - F.coalesce("__b", F.lit(0.0))).drop("__b")
