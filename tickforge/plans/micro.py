"""Entropy and microstructure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bars, entropy, microstructure
from ..sources import ticks, views
from .barsets import DOLLARS, jumps
from .base import q, query, r, rounded
from .ingest import _BOOK, _GOOD

BY, ORDER = ["series_id"], ["ts", "seq"]
_W = "(PARTITION BY series_id ORDER BY ts, seq)"
_RET = f"{views.TICKS}, x AS (SELECT series_id, ts, seq, price, vol, r FROM (SELECT *, ln(price)-lag(ln(price)) OVER {_W} AS r FROM ticks) WHERE r IS NOT NULL)"


def _returns(spark, sf):
    return views.ticks(spark, sf).withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(C.ordered(BY, ORDER)))


@query(f"WITH {_RET} SELECT series_id, seq, (r>0)::INTEGER AS code FROM x WHERE r<>0")
def encode_binary(spark, sf):
    return entropy.encode_binary(_returns(spark, sf), "r").select("series_id", "seq", "code")


_QUANT = f"{views.TICKS}, e AS (SELECT series_id, quantile_cont(price,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM ticks GROUP BY 1), c AS (SELECT t.series_id, ts, seq, len(list_filter(e, lambda v: v<=price))::INTEGER AS code FROM ticks t JOIN e USING(series_id))"


@query(f"WITH {_QUANT} SELECT series_id, code, count(*) AS n FROM c GROUP BY 1,2")
def encode_quantile(spark, sf):
    return entropy.encode_quantile(views.ticks(spark, sf), "price", 10, by=BY).groupBy("series_id", "code").agg(F.count("*").alias("n"))


@query(f"WITH {views.TICKS}, m AS (SELECT series_id, min(price) AS lo, max(price) AS hi FROM ticks GROUP BY 1) SELECT series_id, seq, greatest(least(floor((price-lo)/37.5),ceil((hi-lo)/37.5)-1),0)::INTEGER AS code FROM ticks JOIN m USING(series_id)")
def encode_sigma(spark, sf):
    return entropy.encode_sigma(views.ticks(spark, sf), "price", 37.5, by=BY).select("series_id", "seq", "code")


@query(f"WITH {_QUANT}, w AS (SELECT series_id, lag(code,2) OVER w AS a, lag(code) OVER w AS b, code AS c FROM c WINDOW w AS {_W}), n AS (SELECT series_id, a, b, c, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY ALL), p AS (SELECT *, n/sum(n) OVER (PARTITION BY series_id) AS p FROM n) SELECT series_id, {q('-sum(p*log2(p))/3')} AS entropy FROM p GROUP BY 1")
def plugin_entropy(spark, sf):
    x = entropy.encode_quantile(views.ticks(spark, sf), "price", 10, by=BY)
    return rounded(entropy.plugin_entropy(x, "code", 3, by=BY, order=ORDER), "entropy")


@query(f"WITH {views.TICKS}, p AS (SELECT series_id, vol/sum(vol) OVER (PARTITION BY series_id) AS p FROM ticks) SELECT series_id, {q('-sum(p*ln(p))')} AS entropy, {q('exp(-sum(p*ln(p)))', 4)} AS effective FROM p GROUP BY 1")
def risk_entropy(spark, sf):
    x = views.ticks(spark, sf).withColumn("p", F.col("vol") / F.sum("vol").over(C.full(BY)))
    return rounded(entropy.share_entropy(x, "p", by=BY), "entropy").withColumn("effective", r("effective", 4))


@query(f"WITH {_RET} SELECT series_id, {q('0.5::DOUBLE*ln(2*pi()*exp(1.0::DOUBLE)*var_samp(r))')} AS entropy FROM x GROUP BY 1")
def gaussian_entropy(spark, sf):
    return rounded(entropy.gaussian_entropy(_returns(spark, sf), "r", by=BY), "entropy")


def _match_rates(codes: str, n_blocks: int, window: int) -> str:
    """Match-length entropy of blocks in SQL: at each lag the run of equal symbols from each place, the longest over the lags."""
    return f"""k0 AS (SELECT *, row_number() OVER {_W} AS ii, count(*) OVER (PARTITION BY series_id) AS nn FROM ({codes})), k1 AS MATERIALIZED (SELECT series_id, (ii-nn%{n_blocks}-1)//(nn//{n_blocks}) AS block, code, row_number() OVER (PARTITION BY series_id, (ii-nn%{n_blocks}-1)//(nn//{n_blocks}) ORDER BY ts, seq)-1 AS i, nn//{n_blocks} AS m FROM k0 WHERE ii>nn%{n_blocks}),
 k2 AS (SELECT *, least({window}, m//2) AS n FROM k1), lags AS (SELECT unnest(range(1,{window + 1})) AS l), d AS (SELECT a.series_id, a.block, a.i, a.m, a.n, l, CASE WHEN b.code IS NULL OR a.code<>b.code THEN a.i END AS stop FROM k2 a JOIN lags ON l<=a.n AND a.i+l<=a.m LEFT JOIN k1 b ON b.series_id=a.series_id AND b.block=a.block AND b.i=a.i+l),
 runs AS (SELECT *, coalesce(min(stop) OVER (PARTITION BY series_id, block, l ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), m-l)-i AS run FROM d), best AS (SELECT series_id, block, i+l AS place, n, max(least(run,n)) AS best FROM runs WHERE i+l>=n AND i+l<=m-n GROUP BY ALL), rate AS (SELECT series_id, block, avg(log2(n+1)/(best+1)) AS rate FROM best GROUP BY 1,2), letters AS (SELECT series_id, block, count(DISTINCT code) AS a FROM k1 GROUP BY 1,2)"""


@query(f"WITH {_RET}, {_match_rates('SELECT series_id, ts, seq, (r>0)::INT AS code FROM x WHERE r<>0', 8, 40)} SELECT series_id, block, {q('rate')} AS entropy, {q('CASE WHEN a>1 THEN 1-rate/log2(a) END')} AS redundancy FROM rate JOIN letters USING(series_id,block)")
def kontoyiannis(spark, sf):
    x = entropy.encode_binary(_returns(spark, sf), "r")
    x = entropy.blocks(x.withColumn("k", F.lit(1)), 8, by=BY, order=ORDER)
    return rounded(entropy.kontoyiannis_entropy(x, "code", by=["series_id", "block"], order=ORDER, window=40), "entropy", "redundancy")


@query(f"WITH {_RET}, b AS (SELECT *, row_number() OVER {_W} AS i, count(*) OVER (PARTITION BY series_id) AS n FROM x), k AS (SELECT series_id, ts, seq, r, (i-n%10-1)//(n//10) AS block FROM b WHERE i>n%10), w AS (SELECT series_id, block, (r>0)::INT AS c, lag((r>0)::INT) OVER (PARTITION BY series_id, block ORDER BY ts, seq) AS a FROM k WHERE r<>0), c AS (SELECT series_id, block, a, c, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY ALL), p AS (SELECT *, n/sum(n) OVER (PARTITION BY series_id, block) AS p FROM c) SELECT series_id, block, {q('-sum(p*log2(p))/2')} AS entropy FROM p GROUP BY 1,2")
def block_entropy(spark, sf):
    x = entropy.blocks(_returns(spark, sf).filter("r is not null"), 10, by=BY, order=ORDER)
    y = entropy.encode_binary(x, "r")
    return rounded(entropy.plugin_entropy(y, "code", 2, by=["series_id", "block"], order=ORDER), "entropy")


@query(f"WITH {_RET} SELECT series_id, seq, code FROM (SELECT series_id, seq, (r*lag(r) OVER {_W}>=0)::INTEGER AS code FROM x) WHERE code IS NOT NULL")
def encode_product(spark, sf):
    x = _returns(spark, sf).filter("r is not null")
    return entropy.encode_product(x, "r", by=BY, order=ORDER).select("series_id", "seq", "code")


@query(f"WITH {_RET}, {_match_rates(f'SELECT * FROM (SELECT series_id, ts, seq, (r*lag(r) OVER {_W}>=0)::INT AS code FROM x) WHERE code IS NOT NULL', 12, 30)}, g AS (SELECT series_id, block, code, count(*) AS k FROM k1 GROUP BY 1,2,3), sh AS (SELECT *, k/sum(k) OVER (PARTITION BY series_id, block) AS p FROM g), pl AS (SELECT series_id, block, -sum(p*log2(p)) AS entropy FROM sh GROUP BY 1,2) SELECT series_id, {q('corr(entropy,rate)', 4)} AS correlation FROM pl JOIN rate USING(series_id,block) GROUP BY 1")
def entropy_correlation(spark, sf):
    """Plug-in against match-length entropy of blocks of a series, and their correlation."""
    x = entropy.encode_product(_returns(spark, sf).filter("r is not null"), "r", by=BY, order=ORDER)
    x = entropy.blocks(x.withColumn("k", F.lit(1)), 12, by=BY, order=ORDER)
    a = entropy.plugin_entropy(x, "code", 1, by=["series_id", "block"], order=ORDER)
    b = entropy.kontoyiannis_entropy(x, "code", by=["series_id", "block"], order=ORDER, window=30).select("series_id", "block", F.col("entropy").alias("rate"))
    return a.join(b, ["series_id", "block"]).groupBy("series_id").agg(r(F.corr("entropy", "rate"), 4).alias("correlation"))


_SIGN = f"{views.TICKS}, d AS (SELECT *, sign(price_c-lag(price_c) OVER {_W})::INTEGER AS s FROM ticks), sg AS (SELECT *, coalesce(last_value(nullif(s,0) IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING),0)::INTEGER AS sign FROM d)"


@query(f"WITH {_SIGN} SELECT series_id, seq, sign FROM sg")
def tick_rule(spark, sf):
    return microstructure.tick_rule(views.ticks(spark, sf), "price", by=BY, order=ORDER).select("series_id", "seq", "sign")


@query(f"WITH {_SIGN}, t AS (SELECT *, CASE WHEN user_id%2=0 THEN 1 ELSE -1 END AS truth FROM sg) SELECT series_id, count(*) AS n, {q('avg(CASE WHEN sign=truth THEN 1.0 ELSE 0 END)')} AS accuracy FROM t WHERE sign<>0 GROUP BY 1")
def tick_rule_accuracy(spark, sf):
    x = microstructure.tick_rule(views.ticks(spark, sf), "price", by=BY, order=ORDER).withColumn("truth", F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1))
    return rounded(microstructure.sign_accuracy(x, "sign", "truth", by=BY), "accuracy")


@query(f"WITH {views.TICKS}, d AS (SELECT series_id, ts, seq, price-lag(price) OVER {_W} AS d FROM ticks), l AS (SELECT *, lag(d) OVER {_W} AS l FROM d), m AS (SELECT series_id, var_samp(d) AS v, covar_samp(d,l) AS c FROM l GROUP BY 1) SELECT series_id, {q('v', 4)} AS variance, {q('c', 4)} AS covariance, {q('sqrt(greatest(-c,0))')} AS half_spread, {q('2*sqrt(greatest(-c,0))')} AS spread, {q('v+2*c', 4)} AS true_variance FROM m")
def roll_model(spark, sf):
    x = microstructure.roll_model(views.ticks(spark, sf), "price", by=BY, order=ORDER)
    return rounded(rounded(x, "variance", "covariance", "true_variance", digits=4), "half_spread", "spread")


_HOURS = f"{views.TICKS}, h AS (SELECT series_id, date_trunc('day',ts) AS time, arg_min(price,(ts,seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price,(ts,seq)) AS close FROM ticks GROUP BY 1,2)"


def _days(spark, sf):
    return bars.time_bars(views.ticks(spark, sf), "day", by=BY, order=ORDER).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(f"WITH {_HOURS}, c AS (SELECT *, ln(close)-lag(ln(close)) OVER (PARTITION BY series_id ORDER BY time) AS r FROM h) SELECT series_id, count(*) AS bars, {q('sqrt(avg(power(ln(high/low),2))/(4*ln(2.0::DOUBLE)))')} AS parkinson, {q('stddev_samp(r)')} AS close_volatility FROM c GROUP BY 1")
def volatility_summary(spark, sf):
    return rounded(microstructure.volatility_summary(_days(spark, sf), by=BY, order=["time"]), "parkinson", "close_volatility")


_K = "(3-2*sqrt(2.0::DOUBLE))"
_CS = f"{_HOURS}, s AS (SELECT *, power(ln(high/low),2) AS r2 FROM h), b AS (SELECT *, CASE WHEN count(*) OVER t=2 THEN sum(r2) OVER t END AS two, CASE WHEN count(*) OVER t=2 THEN power(ln(max(high) OVER t/min(low) OVER t),2) END AS gamma, lag(time) OVER (PARTITION BY series_id ORDER BY time) AS start_time FROM s WINDOW t AS (PARTITION BY series_id ORDER BY time ROWS 1 PRECEDING)), e AS (SELECT *, CASE WHEN count(two) OVER n=3 THEN avg(two) OVER n END AS beta FROM b WINDOW n AS (PARTITION BY series_id ORDER BY time ROWS 2 PRECEDING)), a AS (SELECT *, CASE WHEN beta IS NOT NULL THEN greatest((sqrt(2.0::DOUBLE)-1)*sqrt(beta)/{_K}-sqrt(gamma/{_K}),0) END AS alpha FROM e)"


@query(f"WITH {_CS} SELECT series_id, time, start_time, {q('alpha')} AS alpha, {q('2*(exp(alpha)-1)/(1+exp(alpha))')} AS spread, CASE WHEN beta IS NOT NULL THEN {q(f'greatest((1/sqrt(2.0::DOUBLE)-1)*sqrt(beta)/(sqrt(8/pi())*{_K})+sqrt(gamma/(8/pi()*{_K})),0)')} END AS sigma FROM a")
def corwin_schultz(spark, sf):
    x = microstructure.corwin_schultz(_days(spark, sf), by=BY, order=["time"], n=3)
    return rounded(x.select("series_id", "time", "start_time", "alpha", "spread", "sigma"), "alpha", "spread", "sigma")


_FLOW = f"WITH RECURSIVE {jumps('dollar_c', DOLLARS)}, {_SIGN.split(', d AS', 1)[1].join(['d AS', ''])}, m AS (SELECT c.*, sg.sign, (SELECT count(*) FROM closes k WHERE k.series_id=c.series_id AND k.i<c.i) AS bar_id FROM c JOIN sg ON sg.seq=c.seq), b AS (SELECT series_id, bar_id, arg_max(price,(ts,seq)) AS close, sum(dollar_c)::DOUBLE AS dollar, sum(vol)::DOUBLE AS volume, avg(sign*vol) AS mss, sum(sign*sqrt(dollar_c)) AS rf, sum(sign*vol)::DOUBLE AS sv FROM m GROUP BY 1,2), z AS (SELECT *, ln(close)-lag(ln(close)) OVER w AS lr, close-lag(close) OVER w AS pr FROM b WINDOW w AS (PARTITION BY series_id ORDER BY bar_id))"


def _flow(spark, sf):
    x = microstructure.tick_rule(views.ticks(spark, sf), "price", by=BY, order=ORDER)
    return bars.flow_bars(x, DOLLARS, by=BY, order=ORDER, dollar="dollar_c")


@query(_FLOW + f" SELECT series_id, bar_id, {q('mss')} AS mean_signed_size, {q('rf', 4)} AS root_flow, {q('lr')} AS log_return, {q('pr')} AS price_return FROM z")
def flow_bars(spark, sf):
    x = _flow(spark, sf).select("series_id", "bar_id", "mean_signed_size", r("root_flow", 4).alias("root_flow"), "log_return", "price_return")
    return rounded(x, "mean_signed_size", "log_return", "price_return")


@query(_FLOW + f" SELECT series_id, {q('sum(pr*mss*volume)/sum(CASE WHEN pr IS NOT NULL THEN power(mss*volume,2) END)', 8)} AS kyle, {q('sum(pr*sv)/sum(CASE WHEN pr IS NOT NULL THEN sv*sv END)', 8)} AS kyle_signed, {q('1e9*sum(abs(lr)*dollar)/sum(CASE WHEN lr IS NOT NULL THEN dollar*dollar END)')} AS amihud, {q('1e6*sum(lr*rf)/sum(CASE WHEN lr IS NOT NULL THEN rf*rf END)')} AS hasbrouck FROM z GROUP BY 1")
def price_impact(spark, sf):
    x = microstructure.impact(_flow(spark, sf), by=BY)
    return x.select("series_id", r("kyle", 8).alias("kyle"), r("kyle_signed", 8).alias("kyle_signed"), r(F.col("amihud") * 1e9).alias("amihud"), r(F.col("hasbrouck") * 1e6).alias("hasbrouck"))


@query(f"WITH {_GOOD}, t AS (SELECT *, CASE WHEN bid_sz<10 OR ask_sz<10 THEN 'thin' ELSE 'thick' END AS book FROM ev), g AS (SELECT book, count(*) FILTER (side='A') AS a, count(*) FILTER (side='B') AS b, count(*) FILTER (side='N') AS n FROM t GROUP BY 1) SELECT book, {q('a::DOUBLE/(a+b+n)')} AS \"A\", {q('b::DOUBLE/(a+b+n)')} AS \"B\", {q('n::DOUBLE/(a+b+n)')} AS \"N\" FROM g")
def thin_quotes(spark, sf):
    x = ticks.clean_book(views.quotes(spark, sf)).withColumn("book", F.when((F.col("bid_sz_00") < 10) | (F.col("ask_sz_00") < 10), "thin").otherwise("thick"))
    return rounded(microstructure.share_table(x, "book", "side", ["A", "B", "N"]), "A", "B", "N")


@query(f"WITH {_GOOD}, t AS (SELECT * FROM ev WHERE action='T'), m AS (SELECT symbol, date_trunc('minute',ts) AS minute, count(*) AS n, sum(size)::BIGINT AS s FROM t GROUP BY 1,2) SELECT sequence, l_partkey, l_suppkey, dollar, n AS minute_trades, s AS minute_size FROM t JOIN m ON m.symbol=t.symbol AND m.minute=date_trunc('minute',t.ts)")
def minute_activity(spark, sf):
    x = ticks.trades(ticks.clean_book(views.quotes(spark, sf)))
    return microstructure.minute_activity(x, by=["symbol"], at="ts", sums=["size"]).select(*_BOOK, "minute_trades", "minute_size")
