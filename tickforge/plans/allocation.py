"""Portfolio and simulation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, simulation
from ..sources import synthetic, views
from .base import q, query, r, rounded

_RET = views.PANEL + ", rr AS (SELECT asset, week+6 AS period, price/lag(price) OVER (PARTITION BY asset ORDER BY week)-1 AS ret FROM panel), x AS (SELECT * FROM rr WHERE ret IS NOT NULL)"


def _returns(spark, sf):
    return allocation.period_returns(views.panel(spark, sf), "price", "week", by=["asset"], order=["week"])


@query(f"WITH {_RET} SELECT asset, period, {q('ret')} AS ret FROM x", dates=("period",))
def period_returns(spark, sf):
    return rounded(_returns(spark, sf), "ret")


@query(f"WITH {_RET} SELECT a.asset AS a, b.asset AS b, count(*) AS n, {q('covar_samp(a.ret,b.ret)', 8)} AS covariance, {q('corr(a.ret,b.ret)')} AS correlation FROM x a JOIN x b ON a.period=b.period GROUP BY 1,2")
def cov_matrix(spark, sf):
    m = allocation.moments(_returns(spark, sf), "asset", "period")
    return rounded(m, "correlation").withColumn("covariance", r("covariance", 8))


@query(f"WITH {_RET}, v AS (SELECT asset, 1/var_samp(ret) AS i FROM x GROUP BY 1) SELECT asset, {q('i/sum(i) OVER ()')} AS weight FROM v")
def ivp_weights(spark, sf):
    return rounded(allocation.inverse_variance(_returns(spark, sf), "asset"), "weight")


@query(f"WITH {_RET}, d AS (SELECT DISTINCT asset FROM x) SELECT asset, {q('1.0::DOUBLE/count(*) OVER ()')} AS weight FROM d")
def equal_weights(spark, sf):
    return rounded(allocation.equal_weight(_returns(spark, sf), "asset"), "weight")


@query()
def hrp_weights(spark, sf):
    return rounded(allocation.allocate(_returns(spark, sf), "hierarchical", asset="asset", at="period"), "weight")


@query()
def mvo_weights(spark, sf):
    return rounded(allocation.allocate(_returns(spark, sf), "mean_variance", asset="asset", at="period"), "weight")


@query()
def cla_min_vol(spark, sf):
    return rounded(allocation.allocate(_returns(spark, sf), "min_volatility", asset="asset", at="period"), "weight")


@query()
def cla_max_sharpe(spark, sf):
    return rounded(allocation.allocate(_returns(spark, sf), "max_sharpe", asset="asset", at="period"), "weight")


@query(f"WITH {_RET}, v AS (SELECT asset, 1/var_samp(ret) AS i FROM x GROUP BY 1), w AS (SELECT asset, i/sum(i) OVER () AS iv, 1.0::DOUBLE/count(*) OVER () AS eq FROM v) SELECT asset, 'equal' AS kind, {q('eq')} AS weight, {q('eq-iv')} AS deviation FROM w UNION ALL SELECT asset, 'inverse', {q('iv')}, {q('iv-iv')} FROM w")
def weight_comparison(spark, sf):
    x = _returns(spark, sf)
    both = {"equal": allocation.equal_weight(x, "asset"), "inverse": allocation.inverse_variance(x, "asset")}
    return rounded(allocation.compare(both, "inverse"), "weight", "deviation")


@query(f"WITH {views.PANEL}, y AS (SELECT asset, price-lag(price) OVER w AS y, lag(price) OVER w AS x FROM panel WINDOW w AS (PARTITION BY asset ORDER BY week)), g AS (SELECT asset, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, regr_r2(y,x) AS r2, regr_syy(y,x) AS syy, count(*) AS n FROM y WHERE x IS NOT NULL GROUP BY 1) SELECT asset, {q('a', 2)} AS alpha, {q('b')} AS beta, {q('-a/b', 2)} AS theta, {q('sqrt(syy*(1-r2)/(n-1))', 2)} AS sigma, CASE WHEN b<0 THEN {q('ln(2.0::DOUBLE)/-b')} END AS half_life, {q('r2')} AS r2 FROM g")
def ou_fit(spark, sf):
    x = simulation.ou_fit(views.panel(spark, sf), "price", by=["asset"], order=["week"])
    return rounded(rounded(x.select("asset", "alpha", "beta", "theta", "sigma", "half_life", "r2"), "beta", "half_life", "r2"), "alpha", "theta", "sigma", digits=2)


@query()
def otr_grid(spark, sf):
    barriers = [0.5 + k * 9.5 / 9 for k in range(10)]
    g = simulation.rule_grid(spark, barriers, barriers, forecast=0.0, sigma=1.0, half_life=5)
    return rounded(g, "mean", "std", "sharpe")


@query()
def otr_best(spark, sf):
    g = simulation.rule_grid(spark, [0.5, 1.0, 2.0], [1.0, 4.0], forecast=1.0, sigma=1.0, half_life=5)
    return rounded(simulation.best_rule(g), "mean", "std", "sharpe")


@query()
def ef3m(spark, sf):
    x = synthetic.mixture(spark, 20_000, (-2.0, 1.0), (2.0, 1.0), 0.1)
    m = list(x.agg(*simulation.raw_moments("ret")).first())
    return rounded(simulation.ef3m(spark, m, epsilon=0.02, rounds=200), "mu1", "mu2", "sigma1", "sigma2", "p1", "error", digits=4)
