"""Bet sizing, backtest statistics and strategy risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.normal import sql_cdf, sql_ppf
from ..operators import backtest
from ..operators.align import DAY
from ..sources import views
from .base import q, query, r, rounded

BY = ["series_id"]


@query(f"WITH {views.INTERVALS}, z AS (SELECT *, (p-0.5::DOUBLE)/sqrt(p*(1-p)) AS z, CASE WHEN label=1 THEN 1 ELSE -1 END AS s FROM iv WHERE p<1) SELECT series_id, seq, {q(f's*(2*{sql_cdf("z")}-1)')} AS size, {q(f'greatest(least(floor((s*(2*{sql_cdf("z")}-1))/0.2::DOUBLE)*0.2::DOUBLE,1),-1)')} AS stepped FROM z")
def bet_size_prob(spark, sf):
    x = views.intervals(spark, sf).filter("p < 1").withColumn("m", backtest.probability_size(F.col("p"), 2, F.when(F.col("label") == 1, 1).otherwise(-1)))
    return x.select("series_id", "seq", r("m").alias("size"), r(backtest.discretise(F.col("m"), 0.2)).alias("stepped"))


_ACTIVE = views.INTERVALS + ", a AS (SELECT b.series_id, b.seq, count(*) AS n, avg(e.p) AS m, count(*) FILTER (e.label=1) AS l, count(*) FILTER (e.label=0) AS s FROM iv b JOIN iv e ON e.series_id=b.series_id AND b.at>=e.t0 AND b.at<e.t1 GROUP BY 1,2)"


@query(f"WITH {_ACTIVE} SELECT series_id, seq, n AS n_active, {q('m')} AS mean_size FROM a")
def active_bets(spark, sf):
    x = views.intervals(spark, sf)
    out = backtest.active_bets(x.select("series_id", "seq", "at"), x.select("series_id", "t0", "t1", "p"), by=BY, at="at", start="t0", end="t1", size="p", width=5 * DAY)
    return out.select("series_id", "seq", "n_active", r("mean_size").alias("mean_size"))


@query(f"WITH {_ACTIVE} SELECT series_id, seq, l AS n_long, s AS n_short, {q('l/max(l) OVER (PARTITION BY series_id)::DOUBLE - s/max(s) OVER (PARTITION BY series_id)::DOUBLE')} AS size FROM a".replace("OVER (PARTITION BY series_id)::DOUBLE", "OVER (PARTITION BY series_id)"))
def long_short_budget(spark, sf):
    x = views.intervals(spark, sf).withColumn("side", F.when(F.col("label") == 1, 1).otherwise(-1))
    out = backtest.budget_size(x.select("series_id", "seq", "at"), x.select("series_id", "t0", "t1", "side"), by=BY, at="at", start="t0", end="t1", side="side", width=5 * DAY)
    return out.select("series_id", "seq", "n_long", "n_short", r("size").alias("size"))


@query(f"WITH {views.TICKS}, x AS (SELECT series_id, seq, (price-250)/250 AS x, (vol-50)/50.0::DOUBLE AS m, vol::INTEGER AS target FROM ticks) SELECT series_id, seq, {q('sign(x)*power(abs(x),1.5::DOUBLE)')} AS power_size, {q('x/sqrt(2.0::DOUBLE+x*x)')} AS sigmoid_size, CASE WHEN abs(m)<1 THEN {q('100-m*sqrt(2.0::DOUBLE/(1-m*m))')} END AS sigmoid_price, {q('100-sign(m)*power(abs(m),1/1.5::DOUBLE)')} AS power_price, trunc(10*x/sqrt(2.0::DOUBLE+x*x))::BIGINT AS position FROM x")
def price_sizes(spark, sf):
    x = views.ticks(spark, sf).select("series_id", "seq", ((F.col("price") - 250) / 250).alias("x"), ((F.col("vol") - 50) / 50.0).alias("m"))
    price = F.when(F.abs("m") < 1, backtest.inverse_price(2.0, F.lit(100.0), F.col("m")))
    return x.select("series_id", "seq", r(backtest.power_size(1.5, F.col("x"))).alias("power_size"), r(backtest.sigmoid_size(2.0, F.col("x"))).alias("sigmoid_size"), r(price).alias("sigmoid_price"), r(backtest.inverse_price(1.5, F.lit(100.0), F.col("m"), "power")).alias("power_price"), backtest.target_position(2.0, F.col("x"), F.lit(0.0), 10).alias("position"))


@query(f"WITH t AS (SELECT unnest(range(1,10)) AS target) SELECT target, {q('(SELECT avg(100-power(j/10.0::DOUBLE,1/1.5::DOUBLE)) FROM (SELECT unnest(range(1,target+1)) AS j))')} AS price FROM t")
def limit_price(spark, sf):
    x = spark.range(1, 10).select(F.col("id").alias("target"))
    return x.select("target", r(backtest.limit_price(F.col("target"), F.lit(0), F.lit(100.0), 1.5, 10, "power")).alias("price"))


_MIX = lambda x: f"(0.6::DOUBLE*{sql_cdf(f'(({x}-1.0::DOUBLE)/2.0::DOUBLE)')}+0.4::DOUBLE*{sql_cdf(f'(({x}+2.0::DOUBLE)/1.0::DOUBLE)')})"


@query(f"WITH x AS (SELECT unnest(range(-5,6)) AS id), f AS (SELECT id, {_MIX('id')} AS a, {_MIX('0')} AS z FROM x) SELECT id, {q('CASE WHEN id>=0 THEN (a-z)/(1-z) ELSE (a-z)/z END')} AS size FROM f")
def mixture_size(spark, sf):
    return spark.range(-5, 6).select("id", r(backtest.mixture_size(F.col("id").cast("double"), 1.0, -2.0, 2.0, 1.0, 0.6)).alias("size"))


@query(f"WITH {views.TICKS}, g AS (SELECT series_id, count(*) AS n, sum(price) AS s, sum(price*price) AS q FROM ticks GROUP BY 1) SELECT series_id, n, {q('(q/(s*s)-1.0::DOUBLE/n)/(1-1.0::DOUBLE/n)', 8)} AS hhi FROM g")
def hhi(spark, sf):
    return rounded(backtest.concentration(views.ticks(spark, sf), "price", by=BY), "hhi", digits=8)


_DD = views.PANEL + ", h AS (SELECT *, max(price) OVER (PARTITION BY asset ORDER BY week ROWS UNBOUNDED PRECEDING) AS hwm FROM panel), g AS (SELECT asset, hwm, min(price) AS least, min(week) AS start FROM h GROUP BY 1,2), l AS (SELECT asset, max(week) AS fin FROM panel GROUP BY 1), d AS (SELECT g.asset, hwm, least, start, fin FROM g JOIN l USING(asset) WHERE hwm>least), dd AS (SELECT *, 1-least/hwm AS drawdown, (coalesce(lead(start) OVER (PARTITION BY asset ORDER BY start),fin)-start)/365.0::DOUBLE AS years FROM d)"


@query(f"WITH {_DD} SELECT asset, start, {q('drawdown')} AS drawdown, {q('years')} AS years FROM dd", dates=("start",))
def drawdown_tuw(spark, sf):
    x = backtest.drawdowns(views.panel(spark, sf), "price", by=["asset"], order=["week"])
    return rounded(x.select("asset", "start", "drawdown", "years"), "drawdown", "years")


_CASES = "c AS (SELECT * FROM (VALUES ('normal',0.036::DOUBLE,0.079::DOUBLE,24,0.0::DOUBLE,3.0::DOUBLE),('skewed',0.036::DOUBLE,0.079::DOUBLE,24,-2.448::DOUBLE,10.164::DOUBLE)) v(name,m,s,n,g3,g4))"


@query(f"WITH {_CASES}, x AS (SELECT name, (m/s)*sqrt(n-1)/sqrt(1-g3*(m/s)+(g4-1)/4*(m/s)*(m/s)) AS z FROM c) SELECT name, {q(sql_cdf('z'))} AS psr FROM x")
def psr(spark, sf):
    x = spark.createDataFrame([("normal", 0.036, 0.079, 24, 0.0, 3.0), ("skewed", 0.036, 0.079, 24, -2.448, 10.164)], "name string, m double, s double, n int, g3 double, g4 double")
    return x.select("name", r(backtest.probabilistic_sharpe(F.col("m") / F.col("s"), F.lit(0.0), F.col("n"), F.col("g3"), F.col("g4"))).alias("psr"))


@query(f"WITH t AS (SELECT unnest([10,50,100,1000]) AS trials) SELECT trials, {q(f'sqrt(0.5::DOUBLE)*((1-0.5772156649015329::DOUBLE)*{sql_ppf("(1-1.0::DOUBLE/trials)")}+0.5772156649015329::DOUBLE*{sql_ppf("(1-1.0::DOUBLE/(trials*exp(1.0::DOUBLE)))")})')} AS benchmark FROM t")
def dsr_benchmark(spark, sf):
    x = spark.createDataFrame([(n,) for n in (10, 50, 100, 1000)], "trials int")
    return x.select("trials", r(backtest.deflated_benchmark(F.lit(0.5), F.col("trials"))).alias("benchmark"))


_STAT = _DD + f""", rr AS (SELECT asset, week, price/lag(price) OVER (PARTITION BY asset ORDER BY week)-1 AS r FROM panel), gs AS (SELECT asset, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(r) FILTER (r>0) AS mg, avg(r) FILTER (r<0) AS ml FROM rr WHERE r IS NOT NULL GROUP BY 1),
 k AS (SELECT asset, avg(power(r-m,2)) AS m2, avg(power(r-m,3)) AS m3, avg(power(r-m,4)) AS m4 FROM rr JOIN gs USING(asset) WHERE r IS NOT NULL GROUP BY 1), hg AS (SELECT asset, (sum(r*r)/power(sum(r),2)-1.0::DOUBLE/count(*))/(1-1.0::DOUBLE/count(*)) AS hg FROM rr WHERE r>0 GROUP BY 1 HAVING count(*)>2),
 mo AS (SELECT asset, date_trunc('month',week) AS mo, count(*) AS c FROM rr WHERE r IS NOT NULL GROUP BY 1,2), gr AS (SELECT asset, unnest(generate_series(min(mo),max(mo),INTERVAL 1 MONTH)) AS mo FROM mo GROUP BY 1), mc AS (SELECT gr.asset, coalesce(c,0)::DOUBLE AS c FROM gr LEFT JOIN mo ON mo.asset=gr.asset AND mo.mo=gr.mo), hm AS (SELECT asset, (sum(c*c)/power(sum(c),2)-1.0::DOUBLE/count(*))/(1-1.0::DOUBLE/count(*)) AS hm FROM mc GROUP BY 1 HAVING count(*)>2),
 q AS (SELECT asset, quantile_cont(drawdown,0.95) AS d95, quantile_cont(years,0.95) AS y95 FROM dd GROUP BY 1), z AS (SELECT *, (m/s-1.1::DOUBLE/sqrt(52.0::DOUBLE))*sqrt(n-1)/sqrt(1-(m3/power(m2,1.5))*(m/s)+(m4/(m2*m2)-1)/4*(m/s)*(m/s)) AS zp FROM gs JOIN k USING(asset))"""


@query(f"WITH {_STAT} SELECT z.asset, z.n, {q('mg')} AS mean_gain, {q('ml')} AS mean_loss, {q('hg')} AS hhi_gains, {q('hm')} AS hhi_months, {q('d95')} AS drawdown95, {q('y95')} AS under_water95, {q('m*52')} AS annual_return, {q('m/s*sqrt(52.0::DOUBLE)')} AS sharpe, {q('(m-(power(1.015::DOUBLE,1/52.0::DOUBLE)-1))/s*sqrt(52.0::DOUBLE)')} AS information_ratio, {q(sql_cdf('zp'))} AS psr FROM z LEFT JOIN hg ON hg.asset=z.asset LEFT JOIN hm ON hm.asset=z.asset LEFT JOIN q ON q.asset=z.asset")
def backtest_stats(spark, sf):
    x = backtest.statistics(views.panel(spark, sf), "price", by=["asset"], order=["week"], per_year=52)
    names = ("mean_gain", "mean_loss", "hhi_gains", "hhi_months", "drawdown95", "under_water95", "annual_return", "sharpe", "information_ratio", "psr")
    return rounded(x.select("asset", "n", *names), *names)


@query(f"WITH {views.PANEL}, rr AS (SELECT asset, week, price/lag(price) OVER (PARTITION BY asset ORDER BY week)-1 AS r FROM panel) SELECT asset, {q('corr(r, CASE WHEN year(week)%2=0 THEN r ELSE -r END)')} AS correlation FROM rr WHERE abs(r)<0.1 GROUP BY 1")
def year_strategy(spark, sf):
    x = views.panel(spark, sf)
    ret = F.col("price") / F.lag("price").over(C.ordered(["asset"], ["week"])) - 1
    y = backtest.year_signed_growth(x.withColumn("r", ret), "r", by=["asset"], order=["week"])
    return rounded(y.filter(F.abs("r") < 0.1).groupBy("asset").agg(F.corr("r", "signed").alias("correlation")), "correlation")


_GRID = "x AS (SELECT p/20.0::DOUBLE AS p, n::DOUBLE AS n FROM (SELECT unnest(range(11,20)) AS p) CROSS JOIN (SELECT unnest([12,52,260]) AS n))"


def _grid(spark):
    p = spark.range(11, 20).select((F.col("id") / 20.0).alias("p"))
    return p.crossJoin(spark.createDataFrame([(12.0,), (52.0,), (260.0,)], "n double"))


@query(f"WITH {_GRID} SELECT p, n, {q('(2*p-1)/(2*sqrt(p*(1-p)))*sqrt(n)')} AS symmetric, {q('(3*p-2)/(3*sqrt(p*(1-p)))*sqrt(n)')} AS asymmetric, {q('(1+sqrt(4/(n+4)))/2')} AS precision, CASE WHEN 3*p-2>0 THEN {q('36*p*(1-p)/power(3*p-2,2)', 4)} END AS frequency FROM x")
def sr_closed_forms(spark, sf):
    x = _grid(spark)
    p, n = F.col("p"), F.col("n")
    two = F.lit(2.0)
    return x.select("p", "n", r(backtest.sharpe_symmetric(p, n)).alias("symmetric"), r(backtest.sharpe(p, n, F.lit(1.0), F.lit(-2.0))).alias("asymmetric"), r(backtest.precision_symmetric(two, n)).alias("precision"), r(backtest.implied_frequency(two, p, F.lit(1.0), F.lit(-2.0)), 4).alias("frequency"))


@query(f"WITH {_GRID}, s AS (SELECT p, n, (3*p-2)/(3*sqrt(p*(1-p)))*sqrt(n) AS sr FROM x) SELECT p, n, {q('p')} AS precision_back, {q('1.0')} AS win_back, {q('-2.0')} AS loss_back FROM s WHERE abs(3*p-2)>1e-9 AND sr>0")
def sr_inversions(spark, sf):
    p, n, w, loss = F.col("p"), F.col("n"), F.lit(1.0), F.lit(-2.0)
    x = _grid(spark).withColumn("sr", backtest.sharpe(p, n, w, loss)).filter((F.abs(3 * p - 2) > 1e-9) & (F.col("sr") > 0))
    sr = F.col("sr")
    return x.select("p", "n", r(backtest.implied_precision(sr, n, w, loss)).alias("precision_back"), r(backtest.implied_win(sr, p, n, loss)).alias("win_back"), r(backtest.implied_loss(sr, p, n, w)).alias("loss_back"))


@query(f"WITH {_GRID}, s AS (SELECT n, (2*p-1)/(2*sqrt(p*(1-p)))*sqrt(n) AS sr FROM x) SELECT n, {q('stddev_pop(sr)')} AS spread, {q('max(sr)')} AS best FROM s GROUP BY 1")
def sr_sensitivity(spark, sf):
    return rounded(_grid(spark).groupBy("n").agg(F.stddev_pop(backtest.sharpe_symmetric(F.col("p"), F.col("n"))).alias("spread"), F.max(backtest.sharpe_symmetric(F.col("p"), F.col("n"))).alias("best")), "spread", "best")


_FAIL = views.PANEL + ", rr AS (SELECT asset, price/lag(price) OVER (PARTITION BY asset ORDER BY week)-1 AS r FROM panel), g AS (SELECT asset, avg(CASE WHEN r>0 THEN 1.0::DOUBLE ELSE 0 END) AS p, avg(r) FILTER (r>0) AS w, avg(r) FILTER (r<=0) AS l FROM rr WHERE r IS NOT NULL GROUP BY 1), a AS (SELECT *, 53*power(w-l,2) AS qa, (104*l-(w-l))*(w-l) AS qb, 52*l*l AS qc FROM g), n AS (SELECT *, (-qb+sqrt(qb*qb-4*qa*qc))/(2*qa) AS needed FROM a), z AS (SELECT *, (needed-p)/(p*(1-p)) AS z FROM n)"


@query(f"WITH {_FAIL} SELECT asset, {q('p')} AS precision, {q('needed')} AS needed, {q(sql_cdf('z'))} AS failure FROM z")
def failure_probability(spark, sf):
    ret = F.col("price") / F.lag("price").over(C.ordered(["asset"], ["week"])) - 1
    x = views.panel(spark, sf).withColumn("r", ret).filter("r is not null")
    out = backtest.failure_probability(x, "r", by=["asset"], per_year=52, target=1.0)
    return rounded(out.select("asset", "precision", "needed", "failure"), "precision", "needed", "failure")
