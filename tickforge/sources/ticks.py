"""Tick and order-book files: reading, cleaning, writing and reporting."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import micros, need, ordered, ratio, regular_hours, true

RAW_TICKS = "day string, time string, price double, bid double, ask double, vol double"
#: Order-book columns, actions, sides, bad flag bits (bad time 8, doubtful book 4), tick size and point value.
BOOK = ("ts_recv", "ts_event", "action", "side", "price", "size", "flags", "sequence", "symbol", "bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "bid_ct_00", "ask_ct_00")
ACTIONS, SIDES, BAD_FLAGS = ("A", "C", "M", "R", "T"), ("A", "B", "N"), 12
TICK, POINT = 0.25, 50.0


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tick CSV: day, time, price, bid, ask, vol; what does not parse is null."""
    return spark.read.schema(RAW_TICKS).csv(path, header=False, mode="PERMISSIVE")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, all strings; with `columns` only those are read."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def concat_sorted(frames: list[DataFrame], order: list[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*order)


def parse_ticks(raw: DataFrame) -> DataFrame:
    """date from day and time (MM/dd/yyyyHH:mm:ss); rows with a null or a volume that is not positive go."""
    x = raw.withColumn("date", F.try_to_timestamp(F.concat("day", "time"), F.lit("MM/dd/yyyyHH:mm:ss")).cast("timestamp_ntz"))
    return x.drop("day", "time").dropna().filter("vol > 0")


def by_timestamp(ticks: DataFrame, *, by: list[str], at: str, order: list[str], price: str = "price", vol: str = "vol", quotes: tuple[str, ...] = ("bid", "ask")) -> DataFrame:
    """One row for each time: volume-weighted price, the last quotes, sums, count, high and low."""
    need(ticks, price, vol, at, *quotes)
    o = F.struct(*order)
    pv = F.col(price) * F.col(vol)
    x = ticks.groupBy(*by, at).agg(*[F.max_by(q, o).alias(q) for q in quotes], F.sum(vol).alias("vol"), F.sum(pv).alias("dollar_vol"), F.count("*").alias("trade_count"), F.max(price).alias("price_high"), F.min(price).alias("price_low"))
    return x.withColumn("price", ratio(F.col("dollar_vol"), F.col("vol")))


def exact_median(df: DataFrame, x: str, *, by: list[str]) -> DataFrame:
    """(series, median) of the values that are not null, exact, with no series' values in one place.

    Approximate quantiles just around the middle give a narrow range; what lies below is counted, and
    only the distinct values within it are put in order with their counts.
    """
    on = lambda a, b: a.join(b, by) if by else a.crossJoin(F.broadcast(b))
    own = df.select(*by, F.col(x).alias("__x")).filter("__x is not null")
    ends = own.groupBy(*by).agg(F.percentile_approx("__x", [0.499, 0.501], 10_000).alias("__e"))
    counted = on(own, ends).withColumns({"__low": F.col("__x") < F.col("__e")[0], "__in": F.col("__x").between(F.col("__e")[0], F.col("__e")[1])})
    whole = counted.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(F.col("__low").cast("long")).alias("__below"))
    values = counted.filter("__in").groupBy(*by, "__x").agg(F.count("*").alias("__many"))
    w = Window.partitionBy(*by).orderBy("__x")
    placed = on(values.withColumn("__upto", F.sum("__many").over(w)), whole).withColumn("__last", F.col("__below") + F.col("__upto"))
    at = lambda place: (F.col("__last") >= place) & (F.col("__last") - F.col("__many") < place)
    a, b = F.expr("(__n + 1) div 2"), F.expr("__n div 2 + 1")
    middle = (F.max(F.when(at(a), F.col("__x"))) + F.max(F.when(at(b), F.col("__x")))) / 2
    return placed.groupBy(*by).agg(middle.alias("median"))


def mad_scores(df: DataFrame, x: str, *, by: list[str]) -> DataFrame:
    """df with score = 0.6745 |x - median| / MAD, exact medians by series; null where the MAD is 0."""
    mid = exact_median(df, x, by=by).withColumnRenamed("median", "__med")
    y = df.join(mid, by) if by else df.crossJoin(F.broadcast(mid))
    y = y.withColumn("__dev", F.abs(F.col(x) - F.col("__med")))
    mad = exact_median(y, "__dev", by=by).withColumnRenamed("median", "__mad")
    y = y.join(mad, by) if by else y.crossJoin(F.broadcast(mad))
    return y.withColumn("score", ratio(F.lit(0.6745) * F.col("__dev"), F.col("__mad"))).drop("__med", "__dev", "__mad")


def mad_filter(df: DataFrame, x: str, *, by: list[str], threshold: float = 3.0) -> DataFrame:
    """Rows within the threshold; series whose MAD is 0 stay whole."""
    return mad_scores(df, x, by=by).filter(F.coalesce(F.col("score") <= threshold, F.lit(True))).drop("score")


def mad_outliers(df: DataFrame, x: str, *, by: list[str], threshold: float = 3.0) -> DataFrame:
    """df with outlier: a score above the threshold."""
    return mad_scores(df, x, by=by).withColumn("outlier", true(F.col("score") > threshold)).drop("score")


def prepare_ticks(spark: SparkSession, source: str, target: str, threshold: float = 3.0) -> dict:
    """Clean tick file `source` into `target`: parsed, one row a time, outliers removed. Returns counts."""
    raw = read_ticks(spark, source).withColumn("__row", F.monotonically_increasing_id())
    good = parse_ticks(raw)
    merged = by_timestamp(good, by=[], at="date", order=["__row"])
    kept = mad_filter(merged, "price", by=[], threshold=threshold)
    write_parquet(kept, target)
    n = spark.read.parquet(target).count()
    n_raw = raw.count()
    n_good, n_merged = good.agg(F.count("*"), F.count_distinct("date")).first()  # merged rows are the distinct times of good ones
    return {"rows_in": n_raw, "rows_dropped": n_raw - n_good, "timestamps": n_merged, "outliers": n_merged - n, "rows_out": n}


# ---- order book


def valid_book(p: str = "_00") -> Column:
    price, size = (f"bid_px{p}", f"ask_px{p}"), (f"bid_sz{p}", f"ask_sz{p}")
    good = F.lit(True)
    for c in (*price, *size):
        good = good & F.col(c).isNotNull() & (F.col(c) > 0)
    return true(good & (F.col(price[1]) >= F.col(price[0])))


def typed_book(df: DataFrame) -> DataFrame:
    """df with the book's types; what does not convert is null, null flags are 0. ValueError names missing columns."""
    need(df, *BOOK)
    longs = {c: F.col(c).try_cast("bigint") for c in ("size", "sequence", "bid_sz_00", "ask_sz_00", "bid_ct_00", "ask_ct_00")}
    doubles = {c: F.col(c).try_cast("double") for c in ("price", "bid_px_00", "ask_px_00")}
    return df.withColumns(longs | doubles | {"flags": F.coalesce(F.col("flags").try_cast("int"), F.lit(0)), "action": F.col("action").cast("string"), "side": F.col("side").cast("string"), "symbol": F.col("symbol").cast("string")})


def quality_book(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Known actions and sides, no bad flag bits, times known, of one symbol if given."""
    out = df.filter(F.col("action").isin(*ACTIONS) & F.col("side").isin(*SIDES) & (F.col("flags").bitwiseAND(BAD_FLAGS) == 0) & F.col("ts_recv").isNotNull() & F.col("ts_event").isNotNull())
    return out if symbol is None else out.filter(F.col("symbol") == symbol)


def book_features(df: DataFrame, tick: float = TICK) -> DataFrame:
    bid, ask, bs, as_, bc, ac = (F.col(c) for c in ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "bid_ct_00", "ask_ct_00"))
    x = df.withColumns({"spread": ask - bid, "spread_ticks": (ask - bid) / tick, "midpoint": (ask + bid) / 2, "book_imbalance": ratio(bs - as_, bs + as_), "microprice": ratio(ask * bs + bid * as_, bs + as_), "order_count_imbalance": ratio(bc - ac, bc + ac)})
    x = x.withColumn("microprice_minus_mid", F.col("microprice") - F.col("midpoint"))
    if "ts_in_delta" in df.columns:
        # Times hold microseconds; the exact send time is in nanoseconds since 1970.
        x = x.withColumns({"ts_send": F.expr("timestampadd(MICROSECOND, -cast(ts_in_delta / 1000 as bigint), ts_recv)"), "ts_send_ns": micros(F.col("ts_recv")) * 1000 - F.col("ts_in_delta").cast("long"), "feed_latency_ns": F.col("ts_in_delta").cast("long")})
    return x


def trades(events: DataFrame, tick: float = TICK, point: float = POINT) -> DataFrame:
    """Trades of positive price and size with sign, signed size, distance from the midpoint and notional."""
    sign = F.when(F.col("side") == "B", 1).when(F.col("side") == "A", -1).otherwise(0)
    x = events.filter((F.col("action") == "T") & (F.col("price") > 0) & (F.col("size") > 0))
    return x.withColumns({"trade_sign": sign, "signed_size": sign * F.col("size"), "price_minus_mid": F.col("price") - F.col("midpoint"), "price_minus_mid_ticks": (F.col("price") - F.col("midpoint")) / tick, "trade_notional": F.col("price") * F.col("size") * point})


QUOTE = ("bid_px_00", "ask_px_00", "bid_sz_00", "ask_sz_00", "bid_ct_00", "ask_ct_00")


def quote_changes(events: DataFrame, *, by: list[str], order: list[str], columns: tuple[str, ...] = QUOTE) -> DataFrame:
    """Rows where a quote column differs from the row before in the series; the first row and nulls count as changes."""
    w = ordered(by, order)
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
    return events.withColumn("__same", same).filter(~F.col("__same")).drop("__same")


def clean_book(df: DataFrame, *, symbol: str | None = None, rth_only: bool = False) -> DataFrame:
    """Valid, enriched book events of good quality; rth_only keeps those whose event time lies in regular hours."""
    x = quality_book(typed_book(df), symbol).filter(valid_book())
    return book_features(x.filter(regular_hours(F.col("ts_event"))) if rth_only else x)


def book_counts(df: DataFrame, *, by: list[str] = (), symbol: str | None = None, rth_only: bool = False) -> DataFrame:
    """rows_in, bad_quality, invalid_book, events and trades of a raw book, in one pass.

    bad_quality counts rows of known action, side, symbol and times with a bad flag bit; invalid_book
    those of good quality without a valid book.
    """
    x = typed_book(df)
    known = true(F.col("action").isin(*ACTIONS) & F.col("side").isin(*SIDES) & F.col("ts_recv").isNotNull() & F.col("ts_event").isNotNull())
    known = known if symbol is None else known & true(F.col("symbol") == symbol)
    bad = F.col("flags").bitwiseAND(BAD_FLAGS) != 0
    event = known & ~bad & valid_book()
    event = event & regular_hours(F.col("ts_event")) if rth_only else event
    trade = event & true((F.col("action") == "T") & (F.col("price") > 0) & (F.col("size") > 0))
    many = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name)
    return x.groupBy(*by).agg(F.count("*").alias("rows_in"), many(known & bad, "bad_quality"), many(known & ~bad & ~valid_book(), "invalid_book"), many(event, "events"), many(trade, "trades"))


def prepare_book(spark: SparkSession, source: str, target: str, *, symbol: str | None = None, rth_only: bool = False, include_quotes: bool = False) -> dict:
    """Book file to target/events, target/trades and target/quotes, each in order of ts_recv, sequence and original row. Returns counts.

    The order is global: sorted ranges of rows, one to a file. The original row is its file and place
    in it. book_counts() tells bad rows apart as well.
    """
    raw = read_parquet(spark, source).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    order, helpers = ("ts_recv", "sequence", "__file", "__row"), ("__file", "__row")
    events = clean_book(raw, symbol=symbol, rth_only=rth_only)
    write_parquet(events.orderBy(*order).drop(*helpers), f"{target}/events")
    write_parquet(trades(events).orderBy(*order).drop(*helpers), f"{target}/trades")
    counts = book_counts(raw, symbol=symbol, rth_only=rth_only).first()
    out = {c: counts[c] for c in ("rows_in", "invalid_book", "events", "trades")}
    if include_quotes:
        write_parquet(quote_changes(events, by=["symbol"], order=list(order)).orderBy(*order).drop(*helpers), f"{target}/quotes")
        out["quotes"] = spark.read.parquet(f"{target}/quotes").count()
    return out


# ---- reports


def table_report(df: DataFrame, at: str, required: list[str] = ()) -> DataFrame:
    """One row: rows, first and last time, and missing columns. Parquet answers from its footers where it can."""
    missing = ",".join(c for c in required if c not in df.columns)
    return df.agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last")).withColumn("missing", F.lit(missing))


def check_files(spark: SparkSession, files: dict[str, tuple[str, str, list[str]]]) -> list[dict]:
    """For each name: (path, time column, required columns); readiness as a list of dicts."""
    out = []
    for name, (path, at, required) in files.items():
        try:
            df = spark.read.parquet(path) if not path.endswith(".csv") else read_csv(spark, path)
            row = table_report(df, at, required).first().asDict()
            out.append({"name": name, "ready": not row["missing"] and row["rows"] > 0, **row})
        except (PySparkException, OSError) as e:  # a missing or broken file is a finding, not a failure
            out.append({"name": name, "ready": False, "error": type(e).__name__})
    return out
