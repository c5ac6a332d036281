"""Cleaning, scalar, sort and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.normal import cdf, ppf, sql_cdf, sql_ppf
from ..sources import synthetic, ticks, views
from .base import q, query, r, rounded

LI = ["series_id"]


@query(f"WITH {views.LINES} SELECT series_id, ts, {q('sum(price*vol)/sum(vol)', 8)} AS price, sum(vol) AS vol, {q('sum(price*vol)', 4)} AS dollar_vol, count(*) AS trade_count, {q('max(price)', 8)} AS price_high, {q('min(price)', 8)} AS price_low, arg_max(l_partkey, (l_orderkey,l_linenumber,l_partkey,l_suppkey,dollar)) AS last_part FROM ticks_li GROUP BY 1,2")
def tick_agg_vwap(spark, sf):
    x = views.line_ticks(spark, sf).withColumnRenamed("l_partkey", "part").withColumn("l_partkey", F.col("part"))
    out = ticks.by_timestamp(x, by=LI, at="ts", order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "dollar"], quotes=("part",))
    out = rounded(out, "price", "price_high", "price_low", digits=8).withColumn("dollar_vol", r("dollar_vol", 4))
    return out.select("series_id", "ts", "price", "vol", "dollar_vol", "trade_count", "price_high", "price_low", F.col("part").alias("last_part"))


_MAD = f"WITH {views.TICKS}, m AS (SELECT series_id, median(price) AS med FROM ticks GROUP BY 1), d AS (SELECT t.*, abs(price-med) AS dev FROM ticks t JOIN m USING(series_id)), k AS (SELECT series_id, median(dev) AS mad FROM d GROUP BY 1)"


@query(_MAD + " SELECT d.series_id, seq, price FROM d JOIN k USING(series_id) WHERE mad=0 OR 0.6745::DOUBLE*dev/mad<=1.2")
def mad_filter(spark, sf):
    return ticks.mad_filter(views.ticks(spark, sf), "price", by=LI, threshold=1.2).select("series_id", "seq", "price")


@query(_MAD + " SELECT d.series_id, count(*) AS n, sum(CASE WHEN mad<>0 AND 0.6745::DOUBLE*dev/mad>1.2 THEN 1 ELSE 0 END)::BIGINT AS outliers FROM d JOIN k USING(series_id) GROUP BY 1")
def mad_outliers(spark, sf):
    x = ticks.mad_outliers(views.ticks(spark, sf), "price", by=LI, threshold=1.2)
    return x.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("outlier").cast("long")).alias("outliers"))


_GOOD = views.QUOTES + ", good AS (SELECT * FROM quotes WHERE action IN ('A','C','M','R','T') AND side IN ('A','B','N') AND flags & 12 = 0), ev AS (SELECT *, ask_px-bid_px AS spread, (ask_px+bid_px)/2 AS mid FROM good WHERE bid_px>0 AND ask_px>0 AND bid_sz>0 AND ask_sz>0 AND ask_px>=bid_px)"
_BOOK = ["sequence", "l_partkey", "l_suppkey", "dollar"]


def _book(spark, sf):
    return ticks.clean_book(views.quotes(spark, sf))


@query(f"WITH {_GOOD} SELECT series_id, (SELECT count(*) FROM quotes x WHERE x.series_id=g.series_id) AS rows_in, count(*) AS good_rows, (SELECT count(*) FROM ev e WHERE e.series_id=g.series_id) AS events FROM good g GROUP BY series_id")
def book_clean(spark, sf):
    x = views.quotes(spark, sf)
    raw = x.groupBy("series_id").agg(F.count("*").alias("rows_in"))
    good = ticks.quality_book(ticks.typed_book(x))
    g = good.groupBy("series_id").agg(F.count("*").alias("good_rows"), F.sum(ticks.valid_book().cast("long")).alias("events"))
    return raw.join(g, "series_id")


@query(f"WITH {_GOOD} SELECT sequence, l_partkey, l_suppkey, dollar, {q('spread')} AS spread, {q('spread/0.25')} AS spread_ticks, {q('mid', 8)} AS midpoint, {q('(bid_sz-ask_sz)::DOUBLE/(bid_sz+ask_sz)')} AS book_imbalance, {q('(ask_px*bid_sz+bid_px*ask_sz)/(bid_sz+ask_sz)', 8)} AS microprice, {q('(bid_ct-ask_ct)::DOUBLE/(bid_ct+ask_ct)')} AS order_count_imbalance FROM ev")
def book_features(spark, sf):
    x = _book(spark, sf).select(*_BOOK, "spread", "spread_ticks", "midpoint", "book_imbalance", "microprice", "order_count_imbalance")
    return rounded(rounded(x, "spread", "spread_ticks", "book_imbalance", "order_count_imbalance"), "midpoint", "microprice", digits=8)


@query(f"WITH {_GOOD} SELECT sequence, l_partkey, l_suppkey, dollar, CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS trade_sign, (CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE 0 END*size)::BIGINT AS signed_size, {q('price-mid', 8)} AS price_minus_mid, {q('price*size*50', 3)} AS trade_notional FROM ev WHERE action='T' AND price>0 AND size>0")
def trades_signed(spark, sf):
    x = ticks.trades(_book(spark, sf)).select(*_BOOK, "trade_sign", F.col("signed_size").cast("long").alias("signed_size"), "price_minus_mid", "trade_notional")
    return rounded(x, "price_minus_mid", digits=8).withColumn("trade_notional", r("trade_notional", 3))


@query(f"WITH {_GOOD}, s AS (SELECT *, lag(ask_sz) OVER w AS a, lag(ask_ct) OVER w AS b FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts, sequence, l_partkey, l_suppkey, dollar)) SELECT sequence, l_partkey, l_suppkey, dollar FROM s WHERE a IS NULL OR b IS NULL OR ask_sz<>a OR ask_ct<>b")
def quote_changes(spark, sf):
    return ticks.quote_changes(_book(spark, sf), by=["symbol"], order=["ts", *_BOOK], columns=("ask_sz_00", "ask_ct_00")).select(*_BOOK)


@query(f"WITH {_GOOD} SELECT symbol, count(*) AS n, sum(CASE WHEN extract(hour FROM ts_ny)*60+extract(minute FROM ts_ny)>=570 AND extract(hour FROM ts_ny)*60+extract(minute FROM ts_ny)<960 THEN 1 ELSE 0 END)::BIGINT AS regular FROM (SELECT symbol, timezone('America/New_York', timezone('UTC', ts + to_seconds(l_partkey*37%86400))) AS ts_ny FROM ev) GROUP BY 1")
def regular_hours(spark, sf):
    x = _book(spark, sf).withColumn("t", F.timestamp_micros(C.micros(F.col("ts")) + (F.col("l_partkey") * 37 % 86400) * 1_000_000))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(C.regular_hours(F.col("t")).cast("long")).alias("regular"))


_NY = "timezone('America/New_York', timezone('UTC', ts - to_seconds(l_partkey*37%86400)))"
_RTH = f"extract(hour FROM {_NY})*60+extract(minute FROM {_NY})>=570 AND extract(hour FROM {_NY})*60+extract(minute FROM {_NY})<960"


def _late_quotes(spark, sf):
    """Quotes whose event time is up to a day before they were received."""
    x = views.quotes(spark, sf)
    return x.withColumn("ts_event", F.timestamp_micros(C.micros(F.col("ts")) - (F.col("l_partkey") * 37 % 86400) * 1_000_000))


@query(f"WITH {_GOOD} SELECT sequence, l_partkey, l_suppkey, dollar FROM ev WHERE {_RTH}")
def book_regular_hours(spark, sf):
    return ticks.clean_book(_late_quotes(spark, sf), rth_only=True).select(*_BOOK)


@query(f"WITH {_GOOD}, k AS (SELECT symbol, count(*) AS rows_in, count(*) FILTER (flags & 12 <> 0) AS bad_quality FROM quotes GROUP BY 1), g AS (SELECT symbol, count(*) AS n FROM good GROUP BY 1), e AS (SELECT symbol, count(*) AS a, count(*) FILTER ({_RTH}) AS events, count(*) FILTER (action='T' AND price>0 AND size>0 AND {_RTH}) AS trades FROM ev GROUP BY 1) SELECT symbol, rows_in, bad_quality, g.n-e.a AS invalid_book, events, trades FROM k JOIN g USING(symbol) JOIN e USING(symbol)")
def book_counts(spark, sf):
    return ticks.book_counts(_late_quotes(spark, sf), by=["symbol"], rth_only=True)


@query(f"WITH {_GOOD} SELECT sequence, l_partkey, l_suppkey, dollar, epoch_us(ts)*1000-l_partkey*1001 AS ts_send_ns, l_partkey*1001 AS feed_latency_ns FROM ev")
def send_times(spark, sf):
    x = ticks.clean_book(views.quotes(spark, sf).withColumn("ts_in_delta", F.col("l_partkey") * 1001))
    return x.select(*_BOOK, "ts_send_ns", "feed_latency_ns")


@query("SELECT o_orderkey, round(o_totalprice,2) AS price, round(floor(o_totalprice/10)*10,2) AS volume, 0.0::DOUBLE AS bad FROM orders")
def parse_numeric(spark, sf):
    x = views.read(spark, sf, "orders").select("o_orderkey", F.format_number(F.round("o_totalprice", 2), 2).alias("p"), F.concat((F.floor(F.col("o_totalprice") / 10) / 100).cast("string"), F.lit("K")).alias("v"))
    return x.select("o_orderkey", F.round(C.parse_numeric(F.col("p")), 2).alias("price"), F.round(C.parse_numeric(F.col("v")), 2).alias("volume"), C.parse_numeric(F.lit("n/a")).alias("bad"))


@query(f"WITH {views.TICKS}, x AS (SELECT series_id, (vol-50)/17.0::DOUBLE AS z, (vol+0.5::DOUBLE)/100 AS p FROM ticks) SELECT series_id, {q(f'sum({sql_cdf("z")})', 5)} AS cdf_sum, {q(f'sum({sql_ppf("p")})', 5)} AS ppf_sum FROM x GROUP BY 1")
def normal_functions(spark, sf):
    x = views.ticks(spark, sf).select("series_id", ((F.col("vol") - 50) / 17.0).alias("z"), ((F.col("vol") + 0.5) / 100).alias("p"))
    return x.groupBy("series_id").agg(r(F.sum(cdf(F.col("z"))), 5).alias("cdf_sum"), r(F.sum(ppf(F.col("p"))), 5).alias("ppf_sum"))


@query(f"WITH {views.TICKS} SELECT series_id, seq, CASE WHEN year(ts)%2=0 THEN 1 ELSE -1 END AS year_sign, date_trunc('minute',ts) AS minute, greatest(least((price-250)/100,1),-1) AS clipped FROM ticks")
def scalar_mix(spark, sf):
    x = views.ticks(spark, sf)
    return x.select("series_id", "seq", F.when(F.year("ts") % 2 == 0, 1).otherwise(-1).alias("year_sign"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), C.clip((F.col("price") - 250) / 100, -1.0, 1.0).alias("clipped"))


@query(f"WITH {views.TICKS}, x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM ticks WINDOW w AS (PARTITION BY series_id ORDER BY ts, seq)) SELECT series_id, seq FROM x WHERE i > floor(n*0.75)")
def last_quarter(spark, sf):
    w = C.ordered(["series_id"], ["ts", "seq"])
    x = views.ticks(spark, sf).withColumns({"i": F.row_number().over(w), "n": F.count("*").over(C.full(["series_id"]))})
    return x.filter(F.col("i") > F.floor(F.col("n") * F.lit(0.75))).select("series_id", "seq")


@query(f"WITH {views.TICKS} SELECT seq, price FROM ticks ORDER BY price DESC, seq LIMIT 10")
def top_prices(spark, sf):
    return views.ticks(spark, sf).select("seq", "price").orderBy(F.desc("price"), "seq").limit(10)


@query(f"WITH {views.TICKS}, l AS (SELECT user_id FROM ticks WHERE price>=450 UNION SELECT user_id FROM ticks WHERE vol>95), i AS (SELECT user_id FROM ticks WHERE price>=450 INTERSECT SELECT user_id FROM ticks WHERE vol>95), e AS (SELECT user_id FROM ticks WHERE price>=450 EXCEPT SELECT user_id FROM ticks WHERE vol>95) SELECT 'union' AS kind, count(*) AS n FROM l UNION ALL SELECT 'intersect', count(*) FROM i UNION ALL SELECT 'except', count(*) FROM e")
def set_operations(spark, sf):
    x = views.ticks(spark, sf)
    a, b = x.filter("price >= 450").select("user_id"), x.filter("vol > 95").select("user_id")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersect")).unionByName(count(a.subtract(b), "except"))


@query(f"WITH {views.LINES}, x AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, dollar DESC) AS i FROM ticks_li) SELECT series_id, ts, dollar FROM x WHERE i=1")
def dedup_last(spark, sf):
    x = views.line_ticks(spark, sf)
    o = F.struct(*views.LINE_ORDER)
    return x.groupBy("series_id", "ts").agg(F.max_by("dollar", o).alias("dollar"))


@query(f"WITH {views.TICKS}, x AS (SELECT series_id, ntile(7) OVER (PARTITION BY series_id ORDER BY ts, seq) AS chunk FROM ticks) SELECT series_id, chunk, count(*) AS n FROM x GROUP BY 1,2")
def equal_chunks(spark, sf):
    x = views.ticks(spark, sf).withColumn("chunk", F.ntile(7).over(C.ordered(["series_id"], ["ts", "seq"])).cast("long"))
    return x.groupBy("series_id", "chunk").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, '' AS missing FROM events")
def table_report(spark, sf):
    return ticks.table_report(views.read(spark, sf, "events"), "ts", ["event_id", "value"])


@query(f"WITH {views.TICKS} SELECT series_id, seq, price FROM ticks ORDER BY md5('42-'||seq), seq LIMIT 100")
def sample_rows(spark, sf):
    """A seeded sample of 100 ticks: those of least hash."""
    return views.ticks(spark, sf).orderBy(F.md5(F.concat(F.lit("42-"), F.col("seq").cast("string"))), "seq").limit(100).select("series_id", "seq", "price")


@query()
def synthetic_classes(spark, sf):
    x = synthetic.classification(spark, 2000, 3, 2, 2)
    return x.groupBy("bin").agg(F.count("*").alias("n"), *[r(F.avg(c), 4).alias(c) for c in ("I_0", "R_0", "N_0")])
