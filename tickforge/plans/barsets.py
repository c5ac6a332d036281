"""Bar, return, rolling and distribution queries."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import stats
from ..operators import bars, labels
from ..sources import views
from .base import q, query, r, rounded

BY, ORDER = ["series_id"], ["ts", "seq"]
SIZE, DOLLARS = 400, 2_500_000


def _ticks(spark, sf):
    return views.ticks(spark, sf)


def jumps(column: str, size: int) -> str:
    """Rows that close greedy bars: jumps along the running sum, one lookup a bar."""
    return f"""{views.TICKS}, c AS MATERIALIZED (SELECT series_id, ts, seq, price, at, vol, dollar_c, row_number() OVER w AS i, sum({column}) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS cs FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, seq)),
 j AS (SELECT series_id, 0::BIGINT AS bar, 0::BIGINT AS base, (SELECT min(cs) FROM c x WHERE x.series_id=s.series_id AND x.cs>={size}) AS nxt FROM (SELECT DISTINCT series_id FROM c) s
  UNION ALL SELECT j.series_id, j.bar+1, j.nxt, (SELECT min(cs) FROM c x WHERE x.series_id=j.series_id AND x.cs>=j.nxt+{size}) FROM j WHERE j.nxt IS NOT NULL),
 closes AS (SELECT c.*, j.bar FROM j JOIN c ON c.series_id=j.series_id AND c.cs=j.nxt)"""


@query(f"WITH {views.TICKS}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, seq) AS i FROM ticks) SELECT series_id, seq, price FROM x WHERE (i-1)%20=0")
def bars_tick(spark, sf):
    return bars.tick_bars(_ticks(spark, sf), 20, by=BY, order=ORDER).select("series_id", "seq", "price")


@query(f"WITH RECURSIVE {jumps('vol', SIZE)} SELECT series_id, seq, bar AS bar_id FROM closes")
def bars_volume(spark, sf):
    return bars.threshold_bars(_ticks(spark, sf), "vol", SIZE, by=BY, order=ORDER).select("series_id", "seq", "bar_id")


@query(f"WITH RECURSIVE {jumps('dollar_c', DOLLARS)} SELECT series_id, seq, bar AS bar_id FROM closes")
def bars_dollar(spark, sf):
    return bars.threshold_bars(_ticks(spark, sf), "dollar_c", DOLLARS, by=BY, order=ORDER).select("series_id", "seq", "bar_id")


_MEMBERS = f"WITH RECURSIVE {jumps('dollar_c', DOLLARS)}, m AS (SELECT c.*, (SELECT count(*) FROM closes k WHERE k.series_id=c.series_id AND k.i<c.i) AS bar_id FROM c)"
_OHLC = "arg_min(price,(ts,seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price,(ts,seq)) AS close"


@query(_MEMBERS + f" SELECT series_id, bar_id, {_OHLC}, sum(dollar_c)::BIGINT AS dollar, count(*) AS ticks, min(ts) AS start_time, max(ts) AS end_time FROM m GROUP BY 1,2")
def bars_dollar_ohlc(spark, sf):
    return bars.dollar_bars(_ticks(spark, sf), DOLLARS, by=BY, order=ORDER, dollar="dollar_c")


@query(f"WITH {views.TICKS} SELECT series_id, date_trunc('hour',ts) AS time, {_OHLC}, count(*) AS ticks, sum(vol)::BIGINT AS vol, sum(dollar_c)::BIGINT AS dollar_c FROM ticks GROUP BY 1,2")
def bars_time_hour(spark, sf):
    return bars.time_bars(_ticks(spark, sf), "hour", by=BY, order=ORDER, sums=["vol", "dollar_c"]).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"WITH {views.TICKS} SELECT series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS time, {_OHLC}, count(*) AS ticks, sum(vol)::BIGINT AS vol FROM ticks GROUP BY 1,2")
def bars_time_quarter_hour(spark, sf):
    return bars.time_bars(_ticks(spark, sf), "15 minutes", by=BY, order=ORDER, sums=["vol"]).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"WITH RECURSIVE {jumps('dollar_c', DOLLARS)}, n AS (SELECT series_id, CAST(date_trunc('week',ts) AS DATE)+6 AS week, count(*) AS n FROM closes GROUP BY 1,2), g AS (SELECT series_id, CAST(unnest(generate_series(min(week),max(week),INTERVAL 7 DAY)) AS DATE) AS week FROM n GROUP BY 1) SELECT g.series_id, g.week, coalesce(n.n,0)::BIGINT AS n FROM g LEFT JOIN n USING(series_id,week)", dates=("week",))
def bars_week_counts(spark, sf):
    return bars.week_counts(bars.threshold_bars(_ticks(spark, sf), "dollar_c", DOLLARS, by=BY, order=ORDER), by=BY, ts="ts")


@query(f"WITH RECURSIVE {jumps('dollar_c', DOLLARS)}, x AS (SELECT series_id, i, ln(price)-lag(ln(price)) OVER w AS r FROM closes WINDOW w AS (PARTITION BY series_id ORDER BY i)), y AS (SELECT *, lag(r) OVER (PARTITION BY series_id ORDER BY i) AS l FROM x), n AS (SELECT series_id, CAST(date_trunc('week',ts) AS DATE)+6 AS week, count(*) AS n FROM closes GROUP BY 1,2), g AS (SELECT series_id, CAST(unnest(generate_series(min(week),max(week),INTERVAL 7 DAY)) AS DATE) AS week FROM n GROUP BY 1), a AS (SELECT series_id, corr(r,l) AS ac FROM y GROUP BY 1) SELECT g.series_id, g.week, coalesce(n.n,0)::BIGINT AS n, {q('ac')} AS autocorrelation FROM g LEFT JOIN n USING(series_id,week) JOIN a USING(series_id)", dates=("week",))
def bars_weekly_autocorr(spark, sf):
    b = bars.threshold_bars(_ticks(spark, sf), "dollar_c", DOLLARS, by=BY, order=ORDER)
    x = b.withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(C.ordered(BY, ORDER)))
    a = stats.autocorrelation(x, "r", 1, by=BY, order=ORDER)
    return bars.week_counts(b, by=BY, ts="ts").join(rounded(a, "autocorrelation"), "series_id")


@query(f"WITH {views.TICKS}, x AS (SELECT series_id, ts, ln(price)-lag(ln(price)) OVER (PARTITION BY series_id ORDER BY ts, seq) AS r FROM ticks), w AS (SELECT series_id, date_trunc('week',ts) AS m, var_samp(r) AS v FROM x GROUP BY 1,2) SELECT series_id, {q('var_samp(v)')} AS v, count(v) AS n FROM w GROUP BY 1")
def variance_of_variances(spark, sf):
    x = _ticks(spark, sf).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(C.ordered(BY, ORDER)))
    w = x.groupBy("series_id", F.date_trunc("week", "ts").alias("m")).agg(F.var_samp("r").alias("v"))
    return w.groupBy("series_id").agg(r(F.var_samp("v")).alias("v"), F.count("v").alias("n"))


@query(f"WITH x AS (SELECT o_orderpriority AS asset, o_orderdate AS ts, o_orderkey AS seq, year(o_orderdate) AS y, o_totalprice AS p FROM orders), m AS (SELECT asset, date_trunc('month',ts) AS m, var_samp(p) AS v FROM x GROUP BY 1,2) SELECT asset, {q('var_samp(v)/1e16')} AS variance_of_variances, count(v) AS months FROM m GROUP BY 1")
def bars_month_varvar(spark, sf):
    x = views.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("p"))
    return bars.month_variances(x, "p", by=["asset"], ts="ts").withColumn("variance_of_variances", r(F.col("variance_of_variances") / 1e16))


_FRIDAY = "CAST(ts AS DATE) - greatest(CAST(isodow(ts) AS INTEGER)-5,0)"


@query(f"WITH {views.TICKS} SELECT series_id, {_FRIDAY} AS period, arg_max(price,(ts,seq)) AS price FROM ticks GROUP BY 1,2", dates=("period",))
def last_by_business_day(spark, sf):
    return bars.last_by(_ticks(spark, sf), "price", "business", by=BY, order=ORDER)


def _rolls(spark, sf):
    x = views.panel(spark, sf)
    return x.withColumn("open", F.avg("price").over(Window.partitionBy("asset").orderBy("week").rowsBetween(-1, 0)))


_ROLL = views.PANEL + ", o AS (SELECT *, avg(price) OVER (PARTITION BY asset ORDER BY week ROWS 1 PRECEDING) AS open FROM panel), g AS (SELECT *, coalesce(open-lag(price) OVER (PARTITION BY asset ORDER BY week),0) AS gap FROM o), s AS (SELECT *, sum(gap) OVER (PARTITION BY asset ORDER BY week ROWS UNBOUNDED PRECEDING) AS gaps FROM g), e AS (SELECT *, last_value(gaps) OVER (PARTITION BY asset ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM s), ro AS (SELECT *, price-(gaps-fin) AS rolled FROM e)"


@query(f"WITH {_ROLL} SELECT asset, week, {q('rolled', 4)} AS rolled FROM ro", dates=("week",))
def roll_adjust(spark, sf):
    return bars.roll_adjust(_rolls(spark, sf), by=["asset"], order=["week"], close="price").select("asset", "week", r("rolled", 4).alias("rolled"))


@query(f"WITH {_ROLL}, x AS (SELECT *, (rolled-lag(rolled) OVER w)/lag(price) OVER w AS ret FROM ro WINDOW w AS (PARTITION BY asset ORDER BY week)) SELECT asset, week, {q('ret')} AS ret, {q('sum(ln(1+coalesce(ret,0))) OVER (PARTITION BY asset ORDER BY week ROWS UNBOUNDED PRECEDING)')} AS log_wealth FROM x WHERE (SELECT min(1+coalesce(ret,0)) FROM x y WHERE y.asset=x.asset)>0", dates=("week",))
def roll_nonneg(spark, sf):
    x = bars.roll_adjust(_rolls(spark, sf), by=["asset"], order=["week"], close="price")
    out = bars.roll_returns(x, by=["asset"], order=["week"], close="price")
    low = F.min(1 + F.coalesce("ret", F.lit(0.0))).over(C.full(["asset"]))
    return out.withColumn("low", low).filter("low > 0").select("asset", "week", r("ret").alias("ret"), r(F.ln("wealth")).alias("log_wealth"))


@query()
def bars_imbalance(spark, sf):
    x = _ticks(spark, sf).withColumn("dollar", F.col("dollar_c") / 100.0)
    return bars.imbalance_bars(x, by=BY, order=ORDER, first=20).select("series_id", "seq")


_PCA = f"{views.PANEL}, wide AS (SELECT week, ln(max(price) FILTER (asset='1-URGENT')) AS la, ln(max(price) FILTER (asset='2-HIGH')) AS lb FROM panel GROUP BY 1), ab AS (SELECT week, la-lag(la) OVER (ORDER BY week) AS a, lb-lag(lb) OVER (ORDER BY week) AS b FROM wide), m AS (SELECT *, var_samp(a) OVER w AS va, var_samp(b) OVER w AS vb, covar_samp(a,b) OVER w AS c, count(a+b) OVER w AS n FROM ab WINDOW w AS (ORDER BY week ROWS 51 PRECEDING)), e AS (SELECT *, (va+vb)/2-sqrt(((va-vb)/2)*((va-vb)/2)+c*c)-va AS y FROM m), u AS (SELECT *, CASE WHEN n=52 AND abs(c)+abs(y)>0 THEN c/(abs(c)+abs(y)) END AS wa, CASE WHEN n=52 AND abs(c)+abs(y)>0 THEN y/(abs(c)+abs(y)) END AS wb FROM e), l AS (SELECT week, a, b, lag(wa) OVER (ORDER BY week) AS wa, lag(wb) OVER (ORDER BY week) AS wb FROM u), r AS (SELECT *, wa*a+wb*b AS ret FROM l)"


@query(f"WITH {_PCA} SELECT week, {q('a')} AS a, {q('b')} AS b, {q('wa')} AS weight_a, {q('wb')} AS weight_b, {q('ret')} AS spread_return, {q('exp(sum(coalesce(ln(1+ret),0)) OVER (ORDER BY week))')} AS spread FROM r", dates=("week",))
def spread_weights(spark, sf):
    x = views.panel(spark, sf).groupBy("week").pivot("asset", ["1-URGENT", "2-HIGH"]).agg(F.first("price")).withColumn("k", F.lit(1))
    w = C.ordered(["k"], ["week"])
    x = x.select("k", "week", (F.ln("1-URGENT") - F.lag(F.ln("1-URGENT")).over(w)).alias("a"), (F.ln("2-HIGH") - F.lag(F.ln("2-HIGH")).over(w)).alias("b"))
    return rounded(bars.pca_weights(x, "a", "b", by=["k"], order=["week"], n=52), "a", "b", "weight_a", "weight_b", "spread_return", "spread").drop("k")


# ---- returns and windows

_W = "(PARTITION BY series_id ORDER BY ts, seq)"


@query(f"WITH {views.TICKS} SELECT series_id, seq, {q('price/lag(price) OVER w - 1')} AS ret1, {q('price/lag(price,5) OVER w - 1')} AS ret5, {q('ln(price)-lag(ln(price)) OVER w')} AS log_return, {q('price-lag(price) OVER w')} AS diff, {q('lag(price) OVER w/lag(price,3) OVER w - 1')} AS momentum FROM ticks WINDOW w AS {_W}")
def returns_lags(spark, sf):
    w = C.ordered(BY, ORDER)
    p = F.col("price")
    lag = lambda k: F.lag("price", k).over(w)
    x = _ticks(spark, sf).select("series_id", "seq", (p / lag(1) - 1).alias("ret1"), (p / lag(5) - 1).alias("ret5"), (F.ln(p) - F.ln(lag(1))).alias("log_return"), (p - lag(1)).alias("diff"), (lag(1) / lag(3) - 1).alias("momentum"))
    return rounded(x, "ret1", "ret5", "log_return", "diff", "momentum")


_T = "(PARTITION BY series_id ORDER BY ts, seq ROWS 19 PRECEDING)"


@query(f"WITH {views.TICKS} SELECT series_id, seq, {q('avg(price) OVER t')} AS mean, CASE WHEN count(*) OVER t=20 THEN {q('stddev_samp(price) OVER t')} END AS std, sum(vol) OVER t::BIGINT AS vol_sum, max(price) OVER t AS high, min(price) OVER t AS low, {q('sqrt(avg(price*price) OVER e)')} AS rms FROM ticks WINDOW t AS {_T}, e AS (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)".replace("sum(vol) OVER t::BIGINT", "CAST(sum(vol) OVER t AS BIGINT)"))
def rolling_stats(spark, sf):
    t, e = C.trailing(BY, ORDER, 20), C.running(BY, ORDER)
    x = _ticks(spark, sf)
    return x.select("series_id", "seq", r(F.avg("price").over(t)).alias("mean"), r(C.full_window(F.stddev_samp("price").over(t), "price", t, 20)).alias("std"), F.sum("vol").over(t).alias("vol_sum"), F.max("price").over(t).alias("high"), F.min("price").over(t).alias("low"), r(F.sqrt(F.avg(F.col("price") * F.col("price")).over(e))).alias("rms"))


_R = f"{views.TICKS}, x AS (SELECT series_id, ts, seq, price, ln(price)-lag(ln(price)) OVER {_W} AS r FROM ticks), y AS (SELECT *, lag(r) OVER {_W} AS l FROM x)"


def _returns(spark, sf):
    return _ticks(spark, sf).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(C.ordered(BY, ORDER)))


@query(f"WITH {_R} SELECT series_id, seq, CASE WHEN count(l) OVER t=18 THEN {q('corr(r,l) OVER t', 5)} END AS autocorrelation FROM y WINDOW t AS (PARTITION BY series_id ORDER BY ts, seq ROWS 17 PRECEDING)")
def rolling_autocorr(spark, sf):
    x = stats.rolling_autocorrelation(_returns(spark, sf), "r", 19, 1, by=BY, order=ORDER)
    return x.select("series_id", "seq", r("autocorrelation", 5).alias("autocorrelation"))


@query(f"WITH {views.TICKS} SELECT series_id, seq, CASE WHEN count(*) OVER t=20 THEN {q('covar_samp(price,vol) OVER t', 4)} END AS covariance FROM ticks WINDOW t AS {_T}")
def rolling_covariance(spark, sf):
    t = C.trailing(BY, ORDER, 20)
    return _ticks(spark, sf).select("series_id", "seq", r(C.full_window(F.covar_samp("price", "vol").over(t), "price", t, 20), 4).alias("covariance"))


@query(f"WITH {views.TICKS} SELECT series_id, count(DISTINCT user_id) AS users, count(DISTINCT vol) AS volumes, arg_max(seq,(price,-seq)) AS top FROM ticks GROUP BY 1")
def distinct_and_top(spark, sf):
    return _ticks(spark, sf).groupBy("series_id").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("vol").alias("volumes"), F.max_by("seq", F.struct("price", -F.col("seq"))).alias("top"))


@query(f"WITH {views.TICKS}, d AS (SELECT series_id, CAST(ts AS DATE) AS day, count(*) AS n FROM ticks WHERE vol>90 GROUP BY 1,2), g AS (SELECT series_id, CAST(unnest(generate_series(min(day),max(day),INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1) SELECT g.series_id, g.day, coalesce(d.n,0)::BIGINT AS n FROM g LEFT JOIN d USING(series_id,day)", dates=("day",))
def bars_day_counts(spark, sf):
    return bars.day_counts(_ticks(spark, sf).filter("vol > 90"), by=BY, ts="ts")


@query(f"WITH {_R} SELECT series_id, {q('corr(r,l)')} AS autocorrelation FROM y GROUP BY 1")
def autocorr_summary(spark, sf):
    return rounded(stats.autocorrelation(_returns(spark, sf), "r", 1, by=BY, order=ORDER), "autocorrelation")


@query(f"WITH {_R}, m AS (SELECT *, r-avg(r) OVER (PARTITION BY series_id) AS d, row_number() OVER {_W} AS i FROM x WHERE r IS NOT NULL), v AS (SELECT series_id, sum(d*d) AS v FROM m GROUP BY 1), k AS (SELECT unnest(range(0,6)) AS lag), s AS (SELECT a.series_id, k.lag, sum(a.d*b.d) AS s FROM k CROSS JOIN m a JOIN m b ON b.series_id=a.series_id AND b.i=a.i-k.lag GROUP BY 1,2) SELECT s.series_id, lag::INTEGER AS lag, {q('s/v')} AS acf FROM s JOIN v USING(series_id)")
def acf_table(spark, sf):
    return rounded(stats.acf(_returns(spark, sf), "r", 5, by=BY, order=ORDER), "acf")


@query(f"WITH {_R}, m AS (SELECT series_id, count(r) AS n, avg(r) AS mu FROM x GROUP BY 1), c AS (SELECT x.series_id, any_value(n) AS n, avg(power(r-mu,2)) AS m2, avg(power(r-mu,3)) AS m3, avg(power(r-mu,4)) AS m4 FROM x JOIN m USING(series_id) WHERE r IS NOT NULL GROUP BY 1), s AS (SELECT series_id, n, m3/power(m2,1.5) AS sk, m4/(m2*m2)-3 AS ku FROM c) SELECT series_id, {q('sk')} AS skewness, {q('ku')} AS excess_kurtosis, {q('n/6.0::DOUBLE*(sk*sk+ku*ku/4)', 4)} AS jarque_bera, {q('exp(-(n/6.0::DOUBLE*(sk*sk+ku*ku/4))/2)')} AS p_value FROM s")
def jarque_bera(spark, sf):
    return rounded(stats.jarque_bera(_returns(spark, sf), "r", by=BY), "skewness", "excess_kurtosis", "p_value").withColumn("jarque_bera", r("jarque_bera", 4))


@query(f"WITH {views.TICKS} SELECT series_id, count(price) AS n, {q('avg(price)')} AS mean, {q('stddev_samp(price)')} AS std, min(price) AS least, {q('quantile_cont(price,0.25)')} AS q25, {q('median(price)')} AS q50, {q('quantile_cont(price,0.75)')} AS q75, max(price) AS greatest FROM ticks GROUP BY 1")
def describe_prices(spark, sf):
    from ..operators.microstructure import describe_by

    return rounded(describe_by(_ticks(spark, sf), "price", by=BY), "mean", "std", "q25", "q50", "q75")


@query(f"WITH {views.TICKS} SELECT series_id, least(floor(price/50),9)::BIGINT AS bin, count(*) AS n FROM ticks WHERE price<500 GROUP BY 1,2")
def histogram(spark, sf):
    return stats.histogram(_ticks(spark, sf).filter("price < 500"), "price", 0.0, 500.0, 10, by=BY)


@query(f"WITH {views.TICKS}, c AS (SELECT series_id, vol//25 AS v, count(*) AS n FROM ticks GROUP BY 1,2) SELECT series_id, v, n, {q('n/sum(n) OVER (PARTITION BY series_id)')} AS share FROM c")
def value_counts(spark, sf):
    return rounded(stats.value_counts(_ticks(spark, sf).withColumn("v", F.floor(F.col("vol") / 25)), "v", by=BY), "share")


@query(f"WITH {views.TICKS} SELECT series_id, {q('avg(price)', 4)} AS m1, {q('avg(power(price,2))', 2)} AS m2, {q('avg(power(price/100,3))', 4)} AS m3, {q('avg(power(price/100,4))', 3)} AS m4, {q('avg(power(price/100,5))', 2)} AS m5, {q('var_pop(price)', 4)} AS var_pop, {q('covar_samp(price,vol)', 4)} AS covariance, {q('corr(price,vol)')} AS correlation FROM ticks GROUP BY 1")
def moments(spark, sf):
    p, s = F.col("price"), F.col("price") / 100
    return _ticks(spark, sf).groupBy("series_id").agg(r(F.avg(p), 4).alias("m1"), r(F.avg(F.pow(p, 2)), 2).alias("m2"), r(F.avg(F.pow(s, 3)), 4).alias("m3"), r(F.avg(F.pow(s, 4)), 3).alias("m4"), r(F.avg(F.pow(s, 5)), 2).alias("m5"), r(F.var_pop("price"), 4).alias("var_pop"), r(F.covar_samp("price", "vol"), 4).alias("covariance"), r(F.corr("price", "vol")).alias("correlation"))


_REG = "regr_slope(y,x) AS beta, regr_intercept(y,x) AS alpha, regr_r2(y,x) AS r2"


@query(f"WITH {views.TICKS}, x AS (SELECT series_id, price AS y, vol::DOUBLE AS x FROM ticks), g AS (SELECT series_id, {_REG}, regr_syy(y,x) AS syy, count(*) AS n FROM x GROUP BY 1) SELECT series_id, {q('beta')} AS beta, {q('alpha')} AS alpha, {q('r2')} AS r2, {q('sqrt(syy*(1-r2)/(n-2))')} AS residual_std FROM g")
def regression(spark, sf):
    return rounded(stats.regression(_ticks(spark, sf), "price", "vol", by=BY), "beta", "alpha", "r2", "residual_std")


@query(f"WITH {views.TICKS}, s AS (SELECT *, CASE WHEN vol>=50 THEN 'high' ELSE 'low' END AS state FROM ticks), n AS (SELECT *, CASE WHEN state=lag(state) OVER {_W} THEN 0 ELSE 1 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT series_id, run, state, min(ts) AS start, max(ts) AS \"end\", count(*) AS n, (CAST(max(ts) AS DATE)-CAST(min(ts) AS DATE)+1)::INTEGER AS calendar_days FROM g GROUP BY 1,2,3")
def regime_periods(spark, sf):
    from ..operators.breaks import runs

    return runs(_ticks(spark, sf).withColumn("state", F.when(F.col("vol") >= 50, "high").otherwise("low")), "state", by=BY, order=ORDER)


@query(f"WITH {views.TICKS}, b AS (SELECT *, avg(price) OVER t AS mid, stddev_samp(price) OVER t AS sd FROM ticks WINDOW t AS {_T}), x AS (SELECT *, price>=mid-1.0*sd AND price<=mid+1.0*sd AS inside FROM b), e AS (SELECT series_id, CASE WHEN lag(inside) OVER {_W} AND NOT inside THEN 1 ELSE 0 END AS ex FROM x) SELECT series_id, sum(ex)::BIGINT AS exits FROM e GROUP BY 1")
def band_exits(spark, sf):
    x = labels.bollinger(_ticks(spark, sf), "price", by=BY, order=ORDER, n=20, width=1.0)
    return labels.band_exits(x, "price", "lower", "upper", by=BY, order=ORDER)


@query(f"WITH {views.TICKS}, d AS (SELECT series_id, ts, seq, CAST(sign(avg(price_c) OVER a - avg(price_c) OVER b) AS INTEGER) AS s FROM ticks WINDOW a AS (PARTITION BY series_id ORDER BY ts, seq ROWS 4 PRECEDING), b AS {_T}) SELECT * FROM (SELECT series_id, seq, lag(s) OVER {_W} AS side FROM d) WHERE side IS NOT NULL")
def ma_cross_side(spark, sf):
    # Prices are whole cents, so equal means come out equal in integers.
    x = labels.crossover_side(_ticks(spark, sf), "price_c", by=BY, order=ORDER, short=5, long=20)
    return x.select("series_id", "seq", F.col("side").cast("int").alias("side")).filter("side is not null")


@query(f"WITH {views.TICKS}, b AS (SELECT *, avg(price) OVER t AS mid, stddev_samp(price) OVER t AS sd FROM ticks WINDOW t AS {_T}), s AS (SELECT *, CASE WHEN price<=mid-1.5*sd THEN 1 WHEN price>=mid+1.5*sd THEN -1 END AS s FROM b) SELECT * FROM (SELECT series_id, seq, last_value(s IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS side FROM s) WHERE side IS NOT NULL")
def bollinger_side(spark, sf):
    return labels.bollinger_side(_ticks(spark, sf), "price", by=BY, order=ORDER, n=20, width=1.5).select("series_id", "seq", "side").filter("side is not null")


