"""Worked examples, invariants and error contracts of the series operators."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.functions import columns as C
from tickforge.functions import normal
from tickforge.operators import align, allocation, backtest, bars, breaks, entropy, fold, fracdiff, labels, learning, microstructure, simulation
from tickforge.operators.align import asof_join, interval_join, sweep
from tickforge.sources import synthetic, ticks
from tickforge.streaming import folds


def series(spark, values, name="x", more=""):
    return spark.createDataFrame([("s", i, *((v,) if not isinstance(v, tuple) else v)) for i, v in enumerate(values)], f"k string, i long, {name} double{more}")


BY, ORDER = ["k"], ["i"]


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


# ---- ingestion


def test_ticks_file_to_clean_table(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("01/05/2024,09:30:00,100,99,101,2\n01/05/2024,09:30:00,101,99.5,101.5,1\n01/05/2024,09:30:01,102,100,103,3\nbad,09:30:02,1,1,1,1\n01/05/2024,09:30:03,50,1,1,0\n")
    for _ in range(2):  # again over its own output
        got = ticks.prepare_ticks(spark, str(raw), str(tmp_path / "out"))
        assert got == {"rows_in": 5, "rows_dropped": 2, "timestamps": 2, "outliers": 0, "rows_out": 2}
    first = spark.read.parquet(str(tmp_path / "out")).orderBy("date").first()
    assert first["price"] == pytest.approx(100 + 1 / 3) and (first["vol"], first["trade_count"], first["bid"], first["price_high"], first["price_low"]) == (3, 2, 99.5, 101, 100)


def book(spark, rows):
    x = [("2024-01-05 15:00:00", "2024-01-05 15:00:00", a, s, p, 2, 0, i, "ES", b, k, 5, 3, 2, 1) for i, (a, s, p, b, k) in enumerate(rows)]
    df = spark.createDataFrame(x, "ts_recv string, ts_event string, action string, side string, price double, size int, flags int, sequence int, symbol string, bid_px_00 double, ask_px_00 double, bid_sz_00 int, ask_sz_00 int, bid_ct_00 int, ask_ct_00 int")
    return df.withColumns({c: F.to_timestamp(c) for c in ("ts_recv", "ts_event")})


def test_book_file_to_events_and_trades(spark, tmp_path):
    source = str(tmp_path / "book")
    book(spark, [("A", "B", 100.0, 100.0, 100.25), ("T", "B", 100.25, 100.0, 100.25), ("T", "A", 99.0, 100.0, 99.0)]).write.parquet(source)
    got = ticks.prepare_book(spark, source, str(tmp_path / "out"), include_quotes=True)
    assert got == {"rows_in": 3, "invalid_book": 1, "events": 2, "trades": 1, "quotes": 1}
    t = spark.read.parquet(str(tmp_path / "out/trades")).first()
    assert (t["trade_sign"], t["signed_size"], t["spread_ticks"], t["trade_notional"]) == (1, 2, 1.0, 100.25 * 2 * 50)
    assert t["microprice"] == pytest.approx((100.25 * 5 + 100 * 3) / 8)


def test_book_needs_its_columns(spark):
    with pytest.raises(ValueError, match="missing columns: ts_event"):
        ticks.typed_book(book(spark, []).drop("ts_event"))


def test_reports(spark, tmp_path):
    df = series(spark, [1.0, 2.0])
    ticks.write_parquet(df, str(tmp_path / "a"))
    ticks.write_csv(df, str(tmp_path / "c"))
    assert ticks.read_csv(spark, str(tmp_path / "c"), ["x"]).columns == ["x"]
    got = ticks.check_files(spark, {"a": (str(tmp_path / "a"), "i", ["x", "y"]), "none": (str(tmp_path / "none"), "i", [])})
    assert got[0]["missing"] == "y" and not got[0]["ready"] and got[0]["rows"] == 2 and not got[1]["ready"]
    assert [r["i"] for r in ticks.concat_sorted([df, df], ["i"]).collect()] == [0, 0, 1, 1]


def test_mad_without_spread_keeps_all(spark):
    df = series(spark, [5.0, 5.0, 5.0, 900.0])
    assert ticks.mad_filter(df, "x", by=BY).count() == 4
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 100.0])
    assert sorted(column(ticks.mad_filter(df, "x", by=BY), "x")) == [1, 2, 3, 4]


def test_regular_hours_follow_daylight_saving(spark):
    df = spark.createDataFrame([("2024-01-05 14:30:00",), ("2024-01-05 14:29:59",), ("2024-07-05 13:30:00",), ("2024-07-05 20:00:00",)], "t string").withColumn("t", F.to_timestamp("t"))
    assert [r[0] for r in df.select(C.regular_hours(F.col("t"))).collect()] == [True, False, True, False]


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("4,123.45",), ("12.3M",), ("1.5K",), ("2B",), ("-",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.parse_numeric(F.col("t"))).collect()] == [4123.45, 12.3e6, 1500.0, 2e9, 0.0, 0.0, 0.0]


def test_normal_functions(spark):
    x = spark.createDataFrame([(v,) for v in (-8.0, -1.96, 0.0, 0.5, 3.0)], "x double")
    for r in x.select("x", normal.cdf(F.col("x")).alias("a"), normal.exact_cdf(F.col("x")).alias("e")).collect():
        assert r["a"] == pytest.approx(r["e"], abs=2e-7) and r["e"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)))
    p = spark.createDataFrame([(v,) for v in (1e-6, 0.01, 0.3, 0.5, 0.99)], "p double")
    for r in p.select(normal.ppf(F.col("p")).alias("a"), normal.exact_ppf(F.col("p")).alias("e")).collect():
        assert r["a"] == pytest.approx(r["e"], abs=1e-8)
    assert p.limit(1).select(normal.ppf(F.lit(0.0))).first()[0] is None


# ---- bars and folds


def test_greedy_reset_is_no_division(spark):
    df = series(spark, [90.0] * 5)
    got = bars.threshold_bars(df, "x", 100, by=BY, order=ORDER).orderBy("i").collect()
    assert [(r["i"], r["bar_id"]) for r in got] == [(1, 0), (3, 1)]
    kept = bars.dollar_bars(df.withColumn("p", F.lit(1.0)), 100, by=BY, order=ORDER, price="p", dollar="x").orderBy("bar_id").collect()
    assert [r["ticks"] for r in kept] == [2, 2, 1]  # the partial bar stays here
    assert bars.threshold_bars(df, "x", 0, by=BY, order=ORDER).count() == 5
    with pytest.raises(ValueError):
        bars.dollar_bars(df, 0, by=BY, order=ORDER, price="x", dollar="x")
    with pytest.raises(ValueError, match="missing"):
        bars.dollar_bars(df, 5, by=BY, order=ORDER)


def loop_bars(values, size):
    total, out = 0, []
    for i, v in enumerate(values):
        total += v
        if total >= size:
            out.append(i)
            total = 0
    return out


def test_threshold_in_blocks_equals_a_loop():
    rng = np.random.default_rng(1)
    v = rng.integers(1, 50, 1000)
    step, got = fold.Threshold("x", 120), []
    for a in range(0, 1000, 37):
        out = step(pd.DataFrame({"x": v[a : a + 37], "i": np.arange(a, min(a + 37, 1000))}))
        got += out.loc[out["closes"], "i"].tolist()
    assert got == loop_bars(v, 120)


def test_fold_crosses_arrow_batches(spark):
    n = 25_000
    df = spark.range(n).selectExpr("if(id % 2 = 0, 'a', 'b') k", "id i", "cast(id % 7 + 1 as double) x")
    got = [r["i"] for r in bars.threshold_bars(df, "x", 1000, by=BY, order=ORDER).filter("k = 'a'").orderBy("i").collect()]
    v = [i % 7 + 1 for i in range(0, n, 2)]
    assert got == [2 * i for i in loop_bars(v, 1000)]


def test_cusum_resets_one_side_and_skips():
    h = [1.0, None, 1.0, 1.0, 0.0, 1.0, 1.0]
    x = [0.6, 9.0, 0.6, -0.7, -9.0, -0.5, float("nan")]
    out = fold.Cusum("x", "h")(pd.DataFrame({"x": x, "h": h}))
    assert out["event"].tolist() == [0, 0, 1, 0, 0, -1, 0]


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_equals_pandas(adjust):
    x = pd.Series(np.random.default_rng(2).normal(size=200))
    step = fold.Ewm("x", 9, adjust=adjust, least=3, name="m", deviation="s")
    got = pd.concat([step(pd.DataFrame({"x": x[a : a + 31]})) for a in range(0, 200, 31)])
    own = x.ewm(span=9, adjust=adjust, min_periods=3)
    np.testing.assert_allclose(got["m"], own.mean(), rtol=1e-12)
    np.testing.assert_allclose(got["s"], own.std(), rtol=1e-9)


def test_imbalance_bars_close_on_large_imbalance():
    rng = np.random.default_rng(3)
    price = 100 + np.cumsum(rng.normal(0.05, 1, 2000))
    step = fold.ImbalanceBars("p", "d", 20)
    out = pd.concat([step(pd.DataFrame({"p": price[a : a + 77], "d": rng.integers(1, 9, len(price[a : a + 77])) * 1.0})) for a in range(0, 2000, 77)])
    assert 5 < out["closes"].sum() < 400 and not out["closes"].iloc[:20].any()


def test_weeks_without_rows_count_zero(spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", "2024-01-22"]
    df = spark.createDataFrame([("s", d) for d in days], "k string, d string").withColumn("t", F.to_timestamp("d"))
    got = bars.week_counts(df, by=BY, ts="t").orderBy("week").collect()
    assert [(str(r["week"]), r["n"]) for r in got] == [("2024-01-07", 3), ("2024-01-14", 1), ("2024-01-21", 0), ("2024-01-28", 1)]
    got = df.select(C.business_day(F.col("t")).alias("d")).distinct().orderBy("d").collect()
    assert [str(r["d"]) for r in got] == ["2024-01-05", "2024-01-08", "2024-01-22"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [("s" if i % 3 else "t", i, float(i * 37 % 11 + 1)) for i in range(300)]
    schema = "k string, i long, x double"
    for n, a in enumerate(range(0, 300, 100)):
        spark.createDataFrame(rows[a : a + 100], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    for n in range(3):
        for f in (tmp_path / f"in/{n}").glob("*.parquet"):
            (tmp_path / "flat").mkdir(exist_ok=True)
            f.rename(tmp_path / f"flat/{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    out = folds.stream_fold(stream, BY, ORDER, lambda: fold.Threshold("x", 40), f"{schema}, bar_id long, closes boolean")
    q = out.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("folded").collect()}
    want = {tuple(r) for r in bars.threshold_ids(spark.createDataFrame(rows, schema), "x", 40, by=BY, order=ORDER).collect()}
    assert got == want


def test_stream_time_bars_and_sessions(spark, tmp_path):
    rows = [("s", i, 1_700_000_000 + s, float(p)) for i, (s, p) in enumerate([(0, 5), (10, 7), (59, 6), (61, 9), (4000, 1)])]
    spark.createDataFrame(rows, "k string, i long, s long, p double").selectExpr("k", "i", "timestamp_seconds(s) t", "p").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, i long, t timestamp, p double").parquet(str(tmp_path / "in"))
    bars_ = folds.time_bars(stream, by=BY, at="t", order=["t", "i"], length="10 minutes", late="1 minute", price="p")
    calls = folds.sessions(stream, by=BY, at="t", gap="5 minutes", late="1 minute")
    for name, df in (("bars_out", bars_), ("calls_out", calls)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    b = spark.table("bars_out").collect()
    assert sum(r["ticks"] for r in b) == 4 and max(r["high"] for r in b) == 9
    assert [r["n"] for r in spark.table("calls_out").collect()] == [4]


# ---- joins


def test_asof_directions(spark):
    left = spark.createDataFrame([("s", t) for t in (1, 5, 9)], "k string, t long")
    right = spark.createDataFrame([("s", 5, "a", 0), ("s", 5, "b", 1), ("s", 8, "c", 0), ("z", 1, "q", 0)], "k string, u long, v string, o long")
    ask = lambda **o: {r["t"]: r["v"] for r in asof_join(left, right, by=BY, left_on="t", right_on="u", values=["v"], tie=["o"], **o).collect()}
    assert ask() == {1: None, 5: "b", 9: "c"}
    assert ask(strict=True) == {1: None, 5: None, 9: "c"}
    assert ask(direction="forward") == {1: "a", 5: "a", 9: None}
    assert ask(direction="forward", strict=True) == {1: "a", 5: "c", 9: None}
    assert ask(offset=4) == {1: "b", 5: "c", 9: "c"}
    for direction in ("backward", "forward"):
        for strict in (True, False):
            for width in (1, 2, 3, 100):
                assert ask(direction=direction, strict=strict, width=width) == ask(direction=direction, strict=strict)


def test_intervals_and_sweeps_agree(spark):
    p = spark.range(0, 60).selectExpr("'s' k", "id t")
    iv = spark.range(0, 40).selectExpr("'s' k", "id e", "id * 7 % 50 a", "id * 7 % 50 + id % 9 z", "cast(id as double) w")
    for closed in ("both", "left"):
        j = interval_join(p, iv, by=BY, at="t", start="a", end="z", width=4, closed=closed)
        want = {r["t"]: (r["n"], r["w"]) for r in j.groupBy("t").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
        got = sweep(p, iv, by=BY, at="t", start="a", end="z", sums={"n": F.lit(1), "w": F.col("w")}, closed=closed)
        assert {r["t"]: (r["n"], r["w"]) for r in got.collect() if r["n"]} == want
        cut = sweep(p, iv, by=BY, at="t", start="a", end="z", sums={"n": F.lit(1), "w": F.col("w")}, closed=closed, width=7)
        assert {r["t"]: (r["n"], r["w"]) for r in cut.collect() if r["n"]} == want


# ---- labels


def test_barriers_by_hand(spark):
    path = [100.0, 101.0, 98.2, 103.0, 97.0, 100.0]
    b = spark.createDataFrame([("s", i, p) for i, p in enumerate(path)], "k string, at long, price double")
    e = spark.createDataFrame([("s", 0, 5, 0.01, 1.0), ("s", 2, 3, 0.04, -1.0), ("s", 3, None, 0.5, 1.0)], "k string, at long, t1 long, target double, side double")
    go = lambda ev, **o: {r["at"]: (r["t_end"], r["barrier"]) for r in labels.barrier_events(b, ev, by=BY, at="at", price="price", width=2, **o).collect()}
    assert go(e, profit=2.0, loss=1.5) == {0: (2, "sl"), 2: (3, "t1")}
    assert go(e, profit=2.0, loss=0.0) == {0: (3, "pt"), 2: (3, "t1")}
    # Without sides both barriers use the first multiple; a vertical barrier at the same time wins.
    assert go(e.drop("side"), profit=2.0, loss=99.0) == {0: (3, "pt"), 2: (3, "t1")}


def test_first_place_beyond_a_bound():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 17, 100):
        p, low, side, bound = rng.normal(100, 5, n), rng.integers(0, n + 1, 300), rng.choice([-1.0, 1.0], 300), rng.normal(0.04, 0.06, 300)
        p[rng.random(n) < 0.1] = np.nan
        high = np.minimum(n, low + rng.integers(0, n + 1, 300))
        beyond = lambda v, i: (v / 100 - 1) * side[i] > bound[i]
        want = [next((k for k in range(low[i], high[i]) if beyond(p[k], i)), -1) for i in range(300)]
        assert labels.PathTree(p).first(low, high, beyond).tolist() == want


def test_barrier_paths_make_no_pairs(spark):
    """5,000 events over paths of 5,000 bars, 25 million pairs, of which none is a row of the plan; times with bars of two prices."""
    b = spark.range(5000).selectExpr("'s' k", "id at", "100 + id % 2 / 10.0D price").unionByName(spark.createDataFrame([("s", 4999, 200.0), ("s", 7, 50.0), ("s", 8, None)], "k string, at long, price double"))
    e = spark.range(5000).selectExpr("'s' k", "id at", "cast(4999 as long) t1", "0.1D target")
    out = labels.barrier_events(b, e, by=BY, at="at", price="price", profit=2.0, loss=2.0, width=100_000)
    assert "CoGroup" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "<= __stop" not in plan
    got = {r["at"]: (r["pt"], r["sl"], r["t_end"], r["barrier"]) for r in out.collect()}
    assert len(got) == 5000 and got[0] == (4999, 7, 7, "sl") and got[7] == (7, 7, 7, "sl") and got[8] == (4999, None, 4999, "t1") and got[4999] == (4999, 4999, 4999, "t1")


def test_labels_of_every_bar(spark):
    b = spark.createDataFrame([("s", 0, 1.0), ("s", 0, 2.0), ("s", 1, 4.0), ("s", 1, 4.0)], "k string, at long, price double")
    t = spark.createDataFrame([("s", 0, 1, "pt")], "k string, at long, t_end long, barrier string")
    label = lambda **o: sorted(r["ret"] for r in labels.label_events(t, b, by=BY, at="at", price="price", **o).collect())
    assert label(every=True) == [1.0, 1.0, 3.0, 3.0] and len(label()) == 1


def test_rare_labels_go_from_the_rarest(spark):
    df = spark.createDataFrame([("s", v) for v, n in ((0, 60), (1, 36), (-1, 3), (9, 1)) for _ in range(n)], "k string, bin int")
    keep = lambda least: {r["bin"] for r in labels.drop_rare_labels(df, by=BY, least=least).collect()}
    assert keep(0.05) == {0, 1} and keep(0.02) == {0, 1, -1} and keep(0.9) == {0, 1}


def test_draws_by_hand(spark):
    """Events over bars 0-2, 2-3 and 4-5 with the second one picked, as a worked textbook case."""
    bars_ = spark.range(6).selectExpr("'s' k", "id bar")
    ev = spark.createDataFrame([("s", 0, 0, 2), ("s", 1, 2, 3), ("s", 2, 4, 5)], "k string, event long, t0 long, t1 long")
    ind = labels.indicator(bars_, ev, by=BY, at="bar", width=2)
    draw = lambda picked: [r["probability"] for r in labels.draw_probabilities(ind, spark.createDataFrame([("s", p) for p in picked], "k string, event long"), by=BY, bar="bar", event="event").orderBy("event").collect()]
    assert draw([1]) == pytest.approx([5 / 14, 3 / 14, 6 / 14])
    u = [(1 + 1 + 1 / 3) / 3, (1 / 3 + 1 / 3) / 2, 1.0]
    assert draw([1, 1]) == pytest.approx([x / sum(u) for x in u])


def test_overlap_invariants(spark):
    bars_ = spark.range(50).selectExpr("'s' k", "id at")
    ev = spark.range(30).selectExpr("'s' k", "id e", "id * 3 % 47 t0", "if(id = 5, null, least(id * 3 % 47 + id % 6, 49)) t1")
    c = labels.concurrency(bars_, ev, by=BY).collect()
    spans = [(r["t0"], 49 if r["t1"] is None else r["t1"]) for r in ev.collect()]
    assert all(r["n_events"] == sum(a <= r["at"] <= z for a, z in spans) for r in c)
    n = {r["at"]: r["n_events"] for r in c}
    for r in labels.uniqueness(bars_, ev, by=BY).collect():
        z = 49 if r["t1"] is None else r["t1"]
        assert r["uniqueness"] == pytest.approx(np.mean([1 / n[t] for t in range(r["t0"], z + 1)]))
        assert 0 < r["uniqueness"] <= 1


def test_indicator_sums_without_entries(spark):
    """The entries' own sums, with times of several bars, spans without bars, null ends, an event of two spans and one picked twice."""
    bars_ = spark.createDataFrame([("s", t) for t in range(0, 60, 2) for _ in range(1 + t % 3)] + [("t", 5)], "k string, bar long")
    ev = spark.createDataFrame([("s", i % 28, i * 7 % 55 - 2, i * 7 % 55 + i % 9) for i in range(30)] + [("s", 40, 3, 3), ("s", 41, 80, 90), ("s", 42, 9, 4), ("t", 0, 5, 5), ("u", 0, 1, 9), ("s", 43, 2, None)], "k string, event long, t0 long, t1 long")
    picked = spark.createDataFrame([("s", e) for e in (0, 3, 3, 6, 9, 12, 15, 18, 21, 40, 41, 42)] + [("t", 0)], "k string, event long")
    ind = labels.indicator(bars_, ev, by=BY, at="bar", width=4)
    want = sorted(tuple(r) for r in ind.groupBy("k", "event").agg(F.count("*"), F.min("bar")).collect())
    u = sorted((r["k"], r["event"], round(r["uniqueness"], 9)) for r in labels.subset_uniqueness(ind, picked, by=BY, bar="bar", event="event").collect())
    for width in (None, 7):
        got = labels.indicator_sums(bars_, ev, by=BY, event="event", at="bar", width=width)
        assert sorted(tuple(r) for r in got.select("k", "event", "bars", "first").collect()) == want
        got = labels.span_uniqueness(bars_, ev, picked, by=BY, event="event", at="bar", width=width)
        assert sorted((r["k"], r["event"], round(r["uniqueness"], 9)) for r in got.collect()) == u


def test_indicator_queries_make_no_entries(spark, tmp_path):
    """6,000 bars at 600 times and as many spans of all of them: 36 million entries of the matrix, none of them made."""
    rows = [(i, 1_000_000 * (i % 600), 1, "view", 5.0, '{"k": 7}') for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    from tickforge.plans import registry

    for name in ("indicator_matrix", "subset_uniqueness"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        assert "explode(sequence" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = registry.QUERIES["indicator_matrix"](spark, str(tmp_path)).collect()
    assert all(r["bars"] == 6000 - 10 * (r["event"] % 600) and r["first"] == 1_000_000 * (r["event"] % 600) for r in got) and len(got) == 6000


def test_sequential_draws_prefer_unique_events(spark):
    spans = spark.createDataFrame([("s", e, 0, 9) for e in range(9)] + [("s", 99, 20, 29)], "k string, e long, a long, z long")
    got = [r["e"] for r in labels.sequential_bootstrap(spans, by=BY, event="e", first="a", last="z", draws=200, seed=4).collect()]
    assert got.count(99) > 2 * 200 / 10


def test_sequential_draws_by_hand():
    """Pairs of draws come as often as uniqueness among the spans drawn before says."""
    a, z, n = np.array([5, 7, 9, 5, 11]), np.array([7, 8, 10, 7, 16]), 20_000
    d = labels.SpanDraws(a, z)
    got = pd.Series([tuple(d.draw(2, np.random.default_rng(i)).tolist()) for i in range(n)]).value_counts()

    def chances(drawn):
        u = np.array([np.mean([1 / (1 + sum(a[d] <= t <= z[d] for d in drawn)) for t in range(x, y + 1)]) for x, y in zip(a, z, strict=True)])
        return u / u.sum()

    for i, p in enumerate(chances([])):
        for j, q in enumerate(chances([i])):
            assert got.get((i, j), 0) / n == pytest.approx(p * q, abs=5 * math.sqrt(p * q / n))


def test_sequential_draws_of_a_long_series(spark):
    """120,000 draws among 120,000 events within a minute: no draw looks at all events."""
    spans = spark.range(120_000).selectExpr("'s' k", "id e", "id % 744 a", "id % 744 + 1 + id % 24 z")
    began = time.monotonic()
    got = labels.sequential_bootstrap(spans, by=BY, event="e", first="a", last="z").toPandas()
    assert time.monotonic() - began < 60 and len(got) == 120_000 and got["e"].between(0, 119_999).all()


def test_purged_folds_do_not_overlap(spark):
    ev = spark.range(100).selectExpr("'s' k", "id", "id * 10 t0", "id * 10 + 35 t1")
    rows = learning.purged_folds(ev, 5, by=BY, start="t0", end="t1", embargo=0.02).collect()
    for f in range(5):
        test = [r for r in rows if r["fold"] == f and r["role"] == "test"]
        train = [r for r in rows if r["fold"] == f and r["role"] == "train"]
        assert len(test) == 20
        low, high = min(r["t0"] for r in test), max(r["t1"] for r in test)
        assert all(r["t1"] <= low or r["t0"] >= high for r in train)
        assert not {r["id"] for r in train} & {r["id"] for r in test}


# ---- differencing and breaks


def test_kernel_orientations(spark):
    df = series(spark, [1.0, 4.0, 9.0, 16.0, 25.0])
    assert fracdiff.fixed_weights(1.0, 0.5) == [1.0, -1.0, 0.0]
    for wide in (64, 1):
        got = [column(fracdiff.fixed_width(df, "x", 1.0, by=BY, order=ORDER, tau=0.5, kernel=k, wide=wide), "diff") for k in ("newest", "oldest")]
        assert got == [[None, None, 5, 7, 9], [None, None, -3, -5, -7]]
    with pytest.raises(ValueError):
        fracdiff.fixed_weights(-1.0, 1e-3)


def test_features_of_one_time_all_stay(spark):
    f = spark.createDataFrame([("s", 1, 0.5), ("s", 1, 0.5), ("s", 1, 0.7), ("s", 2, 1.0), ("s", 3, None)], "k string, at long, x double")
    e = spark.createDataFrame([("s", 1), ("s", 1), ("s", 3)], "k string, at long")
    assert sorted((r["at"], r["x"]) for r in fracdiff.features_at(f, e, by=BY, at="at").collect()) == [(1, 0.5), (1, 0.5), (1, 0.7)]


def test_expanding_difference(spark):
    x = np.random.default_rng(5).normal(size=60).cumsum() + 50
    got = fracdiff.expanding(series(spark, [float(v) for v in x]), "x", 0.4, by=BY, order=ORDER, tau=0.2).orderBy("i").collect()
    w = fracdiff.binomial_weights(0.4, 60)
    share = np.cumsum(np.abs(w[::-1])) / np.abs(w).sum()
    assert len(got) == 60 - int((share > 0.2).sum())
    for r in got:
        assert r["diff"] == pytest.approx(sum(w[k] * x[r["i"] - k] for k in range(r["i"] + 1)))


def test_unit_roots():
    rng = np.random.default_rng(6)
    walk = rng.normal(size=800).cumsum()
    assert fracdiff.adf(walk)[0] > fracdiff.critical_value(0.05, 800)
    assert fracdiff.adf(np.diff(walk))[0] < fracdiff.critical_value(0.01, 800)
    assert fracdiff.critical_value(0.05, 10**9) == pytest.approx(-2.86154)


def test_recursive_residuals_equal_refits():
    rng = np.random.default_rng(7)
    X = np.column_stack([np.ones(40), rng.normal(size=40)])
    y = X @ [1.0, 2.0] + rng.normal(size=40)
    start, r = breaks.recursive_residuals(y, X)
    for t in range(start, 40):
        b = np.linalg.lstsq(X[:t], y[:t], rcond=None)[0]
        want = (y[t] - X[t] @ b) / math.sqrt(1 + X[t] @ np.linalg.inv(X[:t].T @ X[:t]) @ X[t])
        assert r[t - start] == pytest.approx(want, abs=1e-8)
    with pytest.raises(ValueError):
        breaks.recursive_residuals(y, X, 1)


@pytest.mark.parametrize(("lags", "intercept"), [(0, False), (1, True), (2, True)])
def test_supremum_adf_equals_brute_force(spark, lags, intercept):
    y = np.random.default_rng(8).normal(size=45).cumsum() + 20
    got = {r["place"]: r for r in breaks.supremum_adf(series(spark, [float(v) for v in y]), "x", by=BY, order=ORDER, least=12, lags=lags, intercept=intercept).collect()}
    z, X, k, first = breaks.adf_design(y, lags, intercept)
    for end in range(11, len(z)):
        stats = []
        for s in range(0, end - 10):
            A, b = X[s : end + 1], z[s : end + 1]
            beta, *_ = np.linalg.lstsq(A, b, rcond=None)
            e = b - A @ beta
            stats.append(beta[k] / math.sqrt(e @ e / (len(b) - A.shape[1]) * np.linalg.inv(A.T @ A)[k, k]))
        r = got[end + first]
        assert (r["sadf"], r["inf_adf"], r["n_windows"]) == (pytest.approx(max(stats), rel=1e-6), pytest.approx(min(stats), rel=1e-6), len(stats))
        assert r["start"] == first + int(np.argmax(stats)) and r["qadf"] == pytest.approx(np.quantile(stats, 0.95), rel=1e-6)


def test_break_test_arguments(spark):
    df = series(spark, [1.0, 2.0])
    with pytest.raises(TypeError):
        breaks.supremum_adf(df, "x", by=BY, order=ORDER, least=5, lags=True)
    for bad in ({"least": 1}, {"least": 9, "q": 2}, {"least": 9, "v": 0.9}, {"least": 9, "lags": -1}):
        with pytest.raises(ValueError):
            breaks.supremum_adf(df, "x", by=BY, order=ORDER, **bad)
    for bad in ({"least": 9, "phi": 2}, {"least": 9, "trends": ("cubic",)}, {"least": 2}):
        with pytest.raises(ValueError):
            breaks.martingale_test(df, "x", by=BY, order=ORDER, **bad)
    with pytest.raises(ValueError):
        breaks.level_cusum(df, "x", by=BY, order=ORDER, b=0)
    with pytest.raises(ValueError):
        breaks.break_dates(df, "x", by=BY, order=ORDER, trim=0.5)
    with pytest.raises(ValueError):
        breaks.residual_cusum(df, "x", ["i"], by=BY, order="i", level=0.5)


def test_explosive_series_are_found(spark):
    y = [100.0 + i % 3 for i in range(60)] + [100 * 1.05**i for i in range(1, 40)]
    got = breaks.break_dates(series(spark, y), "x", by=BY, order=ORDER).filter("selected").collect()
    assert len(got) == 1 and 45 <= got[0]["place"] <= 75


# ---- entropy and microstructure


def test_match_lengths_and_rates():
    rng = np.random.default_rng(9)
    assert entropy.match_length(np.array([0, 1, 0, 1, 0, 1]), 2, 2) == 3
    fair, _ = entropy.kontoyiannis(rng.integers(0, 2, 600), 200)
    flat, r = entropy.kontoyiannis(np.array([0, 1] * 200), 100)
    assert 0.8 < fair < 1.25 and flat < 0.2 and r > 0.8
    with pytest.raises(ValueError):
        entropy.kontoyiannis(np.array([1]))


def test_equal_risk_entropy(spark):
    df = spark.createDataFrame([("a", 0.1)] * 10 + [("b", (11 - i) / 55) for i in range(1, 11)], "k string, p double")
    got = {r["k"]: r for r in entropy.share_entropy(df, "p", by=BY).collect()}
    assert got["a"]["entropy"] == pytest.approx(math.log(10)) and got["b"]["effective"] < 10
    for bad in (lambda: entropy.encode_quantile(df, "p", 1, by=BY), lambda: entropy.encode_sigma(df, "p", 0, by=BY), lambda: entropy.words_of(df, "p", 0, by=BY, order=["p"])):
        with pytest.raises(ValueError):
            bad()


def test_tick_rule_carries_signs(spark):
    assert column(microstructure.tick_rule(series(spark, [5.0, 5.0, 6.0, 6.0, 4.0, 4.0]), "x", by=BY, order=ORDER), "sign") == [0, 0, 1, 1, -1, -1]


def test_roll_spread_of_bounces(spark):
    rng = np.random.default_rng(10)
    p = 100 + rng.choice([-0.5, 0.5], 4000)
    got = microstructure.roll_model(series(spark, [float(v) for v in p]), "x", by=BY, order=ORDER).first()
    assert got["spread"] == pytest.approx(1.0, abs=0.1)


# ---- bets, statistics, allocation


def test_sharpe_probabilities_by_hand(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    sr = F.lit(0.036 / 0.079)
    assert f(backtest.probabilistic_sharpe(sr, F.lit(0.0), F.lit(24), F.lit(0.0), F.lit(3.0))) == pytest.approx(0.982, abs=2e-3)
    assert f(backtest.probabilistic_sharpe(sr, F.lit(0.0), F.lit(24), F.lit(-2.448), F.lit(10.164))) == pytest.approx(0.913, abs=2e-3)
    assert f(backtest.sharpe_symmetric(F.lit(0.6), F.lit(52))) == pytest.approx(1.47, abs=5e-3)
    p = backtest.implied_precision(F.lit(2.0), F.lit(52.0), F.lit(2.0), F.lit(-2.0))
    assert f(p) == pytest.approx(f(backtest.precision_symmetric(F.lit(2.0), F.lit(52.0))))
    assert backtest.size_curve(10, 0.95) == pytest.approx(10.8, abs=0.01)


def test_drawdowns_by_hand(spark):
    x = [100.0, 120.0, 90.0, 130.0, 125.0]
    df = spark.createDataFrame([("s", f"2024-01-0{i + 1}", v) for i, v in enumerate(x)], "k string, d string, x double").withColumn("i", F.to_date("d"))
    got = backtest.drawdowns(df, "x", by=BY, order=ORDER).orderBy("start").collect()
    assert [(r["hwm"], r["drawdown"]) for r in got] == [(120, 0.25), (130, pytest.approx(5 / 130))]
    assert [r["years"] for r in got] == [pytest.approx(2 / 365), pytest.approx(1 / 365)]


def test_concentration_of_two_is_null(spark):
    assert backtest.concentration(series(spark, [1.0, 2.0]), "x", by=BY).first()["hhi"] is None
    assert backtest.concentration(series(spark, [1.0] * 5), "x", by=BY).first()["hhi"] == pytest.approx(0)


def random_market(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(3 * n, n))
    return rng.normal(0.05, 0.1, n), a.T @ a / (3 * n)


@pytest.mark.parametrize("n", [2, 3, 6, 12])
@pytest.mark.parametrize("upper", [1.0, 0.5])
def test_critical_line_is_optimal(n, upper):
    for seed in range(4):
        mean, cov = random_market(n, seed)
        line = allocation.CriticalLine(mean, cov, 0.0, upper)
        for lam, w in line.points[1:]:
            assert w.sum() == pytest.approx(1, abs=1e-7) and (w >= -1e-9).all() and (w <= upper + 2e-9).all()
            # Karush-Kuhn-Tucker: no shift of weight between two assets lowers w'Cw / 2 - lam m'w.
            slope = cov @ w - lam * mean
            if not (w < upper - 1e-7).any():
                continue
            assert slope[w > 1e-7].max() <= slope[w < upper - 1e-7].min() + 1e-6 * max(1, lam)
        if upper == 1.0 and (mean > 0).any():
            ratio = lambda w: w @ mean / math.sqrt(w @ cov @ w)
            assert ratio(line.max_sharpe()) == pytest.approx(ratio(allocation.max_sharpe_long(mean, cov)), abs=1e-5)
        frontier = line.frontier(20)
        assert all(a[0] >= b[0] - 1e-9 for a, b in zip(frontier, frontier[1:], strict=False))


def test_bounds_must_allow_weights():
    with pytest.raises(ValueError):
        allocation.CriticalLine(np.ones(2), np.eye(2), 0.0, 0.4)


def test_risk_parity(spark):
    cov = np.diag([1.0, 4.0, 9.0])
    w = allocation.risk_parity(cov, np.eye(3))
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    # Two blocks: leaves of one block stay together.
    corr = np.array([[1, 0.1, 0.9, 0.1], [0.1, 1, 0.1, 0.9], [0.9, 0.1, 1, 0.1], [0.1, 0.9, 0.1, 1]])
    order = allocation.leaf_order(np.sqrt((1 - corr) / 2))
    assert {frozenset(order[:2]), frozenset(order[2:])} == {frozenset({0, 2}), frozenset({1, 3})}
    with pytest.raises(ValueError):
        allocation.risk_parity(np.eye(1), np.eye(1))
    r = synthetic.correlated_returns(spark, 60, 3, 2)
    for kind in ("inverse_variance", "equal_weight", "mean_variance", "hierarchical", "min_volatility", "max_sharpe"):
        assert sum(x["weight"] for x in allocation.allocate(r, kind, asset="asset", at="t").collect()) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        allocation.allocate(r, "other", asset="asset", at="t")


def test_rescaled_spectrum():
    c = allocation.rescale_spectrum(np.diag([100.0, 1.0, 0.01]), 50)
    v = np.linalg.eigvalsh(c)
    assert v.max() / v.min() == pytest.approx(50) and np.trace(c) == pytest.approx(101.01)


# ---- simulation


def test_ou_fit_finds_its_half_life(spark):
    rng, y = np.random.default_rng(11), [10.0]
    for _ in range(5000):
        y.append(y[-1] + 0.1 * (10 - y[-1]) + rng.normal())
    r = simulation.ou_fit(series(spark, y), "x", by=BY, order=ORDER).first()
    assert r["kappa"] == pytest.approx(0.1, abs=0.02) and r["theta"] == pytest.approx(10, abs=0.5) and r["sigma"] == pytest.approx(1, abs=0.05)


def test_rule_grid(spark):
    got = simulation.rule_grid(spark, [1.0, 1e9], [1.0, 1e9], forecast=0.0, sigma=1.0, half_life=5, paths=3000, longest=50, block=1000).collect()
    by = {(r["profit"], r["loss"]): r for r in got}
    assert by[1e9, 1e9]["n"] == 0 and by[1e9, 1e9]["sharpe"] == 0
    assert by[1.0, 1e9]["mean"] > 1 and by[1e9, 1.0]["mean"] < -1 and abs(by[1.0, 1.0]["mean"]) < 0.15


def test_moments_there_and_back():
    raw = list(simulation.mixture_moments((-2.0, 1.0), (2.0, 1.0), 0.1))
    central = [simulation.central_moment(raw, k) for k in range(1, 6)]
    assert central[0] == pytest.approx(0)
    assert simulation.raw_moment(central, raw[0]) == pytest.approx(raw)


@pytest.mark.parametrize("variant", [1, 2])
def test_mixture_fit_keeps_the_moments(variant):
    raw = simulation.mixture_moments((-2.0, 1.0), (2.0, 1.0), 0.1)
    got = simulation.fit_mixture(list(raw), 1.0, 0.1, epsilon=1e-5, variant=variant)
    assert got is not None and got[0] < 1e-6 and got[1] == pytest.approx((-2, 1, 2, 1, 0.1), abs=1e-3)


# ---- learning


def test_importance_finds_informative_columns(spark):
    data = synthetic.classification(spark, 600, 2, 1, 2).cache()
    names = ["I_0", "I_1", "R_0", "N_0", "N_1"]
    a = learning.assembled(data, names, "bin", "w")
    model = learning.forest(trees=10, depth=4).fit(a)
    mdi = {f: m for f, m, _ in learning.impurity_importance(model, names)}
    assert sum(mdi.values()) == pytest.approx(1) and mdi["I_1"] > mdi["N_0"]
    assigned = learning.purged_folds(data.select("id", "t0", "t1"), 3, by=[], start="t0", end="t1")
    mda = {f: m for f, m, _ in learning.permutation_importance(learning.forest(trees=5, depth=3), data, ["I_1", "N_1"], "bin", assigned, "id", metric="accuracy")}
    assert mda["I_1"] > mda["N_1"]
    sfi = {f: m for f, m, _ in learning.single_importance(learning.forest(trees=5, depth=3), data, ["I_1", "N_1"], "bin", assigned, "id")}
    assert sfi["I_1"] > sfi["N_1"]
    best = learning.search(lambda trees, depth: learning.forest(trees=trees, depth=depth), {"trees": [3], "depth": [1, 4]}, a, assigned, "id", draws=1)
    assert len(best) == 1 and 0.5 < best[0][1] <= 1
    with pytest.raises(ValueError):
        learning.score(model, a, "other")


def test_orthogonal_features(spark):
    data = synthetic.classification(spark, 400, 2, 2, 1)
    names = ["I_0", "I_1", "R_0", "R_1", "N_0"]
    out, values = learning.orthogonal_features(data, names, 0.95)
    assert len(values) < 5 and values == sorted(values, reverse=True)
    r = out.agg(F.corr("pc_1", "pc_2"), F.var_samp("pc_1")).first()
    assert abs(r[0]) < 1e-6 and r[1] == pytest.approx(values[0], rel=1e-6)


def test_bagging_with_sequential_draws(spark):
    data = learning.assembled(synthetic.classification(spark, 300, 2, 0, 1), ["I_0", "I_1"], "bin")
    draws = spark.range(3).withColumnRenamed("id", "bag").crossJoin(spark.range(300)).filter((F.col("id") + F.col("bag")) % 3 > 0).select("bag", "id")
    models = learning.bootstrap_bagging(data, draws, "id", 3)
    voted = learning.majority(models, data)
    assert learning.accuracy(voted, "__label", "prediction", by=[]).first()[0] > 0.8
    assert learning.out_of_bag(data, draws, "id", models) > 0.7


def test_log_uniform():
    v = learning.log_uniform_draws(4000, 1e-2, 1e2, 1)
    assert 1e-2 <= min(v) and max(v) <= 1e2 and sum(x < 1 for x in v) == pytest.approx(2000, abs=150)


# ---- helpers


def test_lookup_needs_every_row(spark):
    from tickforge.operators.align import indexed, lookup

    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert {r["v"] for r in lookup(a, b, on=["k"], values=["v"]).collect()} == {"x", "y"}
    with pytest.raises(Exception, match="no row for"):
        lookup(a, b.limit(1), on=["k"], values=["v"]).collect()
    got = indexed(spark.range(0, 1000, 1, 7)).collect()
    assert sorted(r["place"] for r in got) == list(range(1000))


def test_atoms_in_balanced_groups(spark):
    from tickforge.operators import parallel

    assert parallel.linear_parts(10, 3) == [0, 4, 7, 10] and parallel.linear_parts(2, 5) == [0, 1, 2]
    bounds = parallel.nested_parts(1000, 4)
    cost = [sum(range(a + 1, z + 1)) for a, z in zip(bounds, bounds[1:], strict=False)]
    assert max(cost) < 1.02 * min(cost)
    heavy = parallel.nested_parts(1000, 4, heavy_first=True)
    assert heavy == [1000 - b for b in reversed(bounds)]
    out = parallel.map_atoms(spark.range(50), lambda p: pd.DataFrame({"n": [len(p)], "low": [p["id"].min()]}), "n long, low long", order=["id"], groups=4, nested=True)
    assert sum(r["n"] for r in out.collect()) == 50 and out.count() == 4


def test_directional_index_counts_the_larger_move(spark):
    df = spark.createDataFrame([("s", i, h, lo) for i, (h, lo) in enumerate([(10.0, 9.0), (11.0, 9.5), (11.5, 8.0), (11.4, 8.1)])], "k string, i long, high double, low double")
    got = column(fracdiff.directional_index(df, 2, by=BY, order=ORDER), "rsi")
    up, down = pd.Series([0, 1, 0, 0]).ewm(span=2, min_periods=2).mean(), pd.Series([0, 0, 1.5, 0]).ewm(span=2, min_periods=2).mean()
    want = (100 * up / (up + down)).round()
    assert got[0] is None and got[1:] == want[1:].tolist()


def test_command_line(spark, tmp_path, capsys):
    from tickforge.__main__ import main

    raw = tmp_path / "raw.csv"
    raw.write_text("01/05/2024,09:30:00,100,99,101,2\n")
    main(["ticks", str(raw), str(tmp_path / "out")])
    assert '"rows_out": 1' in capsys.readouterr().out
    main(["check", f"clean={tmp_path / 'out'}:date:price,vol"])
    assert '"ready": true' in capsys.readouterr().out


def test_match_lengths_of_whole_blocks(spark):
    """Vectorised match lengths against the plain loop; the registered queries read every row of their blocks."""
    from tickforge.plans import micro

    rng = np.random.default_rng(3)
    for m, n, letters in ((2, 1, 2), (9, 4, 2), (80, 40, 1), (300, 30, 2), (301, 40, 3)):
        s = rng.integers(0, letters, m)
        assert entropy.window_matches(s, n).tolist() == [entropy.match_length(s, i, n) for i in range(n, m - n + 1)]

    def rate(s, window):
        n = min(window, len(s) // 2)
        lengths = [entropy.match_length(s, i, n) for i in range(n, len(s) - n + 1)]
        return sum(math.log2(n + 1) / k for k in lengths) / len(lengths)

    def cut(codes, n):
        codes = codes.to_numpy()
        return codes[len(codes) % n :].reshape(n, -1)

    sf = "/root/testdata/sf0.01"
    x = entropy.encode_binary(micro._returns(spark, sf), "r").toPandas().sort_values(micro.ORDER)
    got = {(r["series_id"], r["block"]): r["entropy"] for r in micro.kontoyiannis(spark, sf).collect()}
    want = {(k, b): rate(s, 40) for k, g in x.groupby("series_id") for b, s in enumerate(cut(g["code"], 8))}
    assert max(len(g) // 8 for _, g in x.groupby("series_id")) > 120
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)

    y = entropy.encode_product(micro._returns(spark, sf).filter("r is not null"), "r", by=micro.BY, order=micro.ORDER).toPandas().sort_values(micro.ORDER)
    share = lambda s: -sum(p * math.log2(p) for p in np.bincount(s) / len(s) if p)
    for r in micro.entropy_correlation(spark, sf).collect():
        parts = cut(y[y["series_id"] == r["series_id"]]["code"], 12)
        assert abs(r["correlation"] - np.corrcoef([share(s) for s in parts], [rate(s, 30) for s in parts])[0, 1]) < 1e-3


def test_interval_sums_equal_the_join(spark):
    """Sums over the points in each interval, ends in or out, whole series or stretches, ties, empty and outside intervals."""
    import random

    rng = random.Random(4)
    points = [(s, rng.randrange(300), rng.randrange(50)) for s in "ab" for _ in range(200)]
    spans = [(rng.choice("abc"), i, t := rng.randrange(-20, 320), t + rng.randrange(0, 90)) for i in range(150)]
    p = spark.createDataFrame(points, "s string, k long, v long")
    x = spark.createDataFrame(spans, "s string, id long, a long, z long")
    for closed in ("both", "left"):
        want = {}
        for s, i, a, z in spans:
            held = [v for t, k, v in points if t == s and a <= k and (k <= z if closed == "both" else k < z)]
            want[i] = (len(held), sum(held)) if held else (None, None)
        for width in (None, 40):
            out = align.interval_sums(p, x, by=["s"], at="k", start="a", end="z", sums={"n": F.lit(1), "total": F.col("v")}, closed=closed, width=width)
            assert {r["id"]: (r["n"], r["total"]) for r in out.collect()} == want


def test_stretches_change_nothing(spark):
    bars = spark.range(400).selectExpr("'s' s", "id * 7 at")
    events = spark.range(150).selectExpr("'s' s", "id", "id * 11 t0", "id * 11 + 90 + id % 50 t1")
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for f in (labels.concurrency, labels.uniqueness):
        assert rows(f(bars, events, by=["s"])) == rows(f(bars, events, by=["s"], width=300))


def test_folds_of_one_table(spark):
    for n, k in ((103, 5), (4, 7), (40, 4)):
        x = spark.range(n).selectExpr("id", "(id * 37) % 101 + id / 1000 at")
        got = [r["fold"] for r in learning.folds(x, k, by=[], order=["at"]).orderBy("at").collect()]
        want = [f for f in range(k) for _ in range(n // k + (f < n % k))]
        assert got == want


def test_book_order_and_counts(spark, tmp_path):
    """Regular hours go by the event's time, ties keep the file's order, files are in order as a whole."""
    import datetime as dt

    at = lambda h, m, s=0: dt.datetime(2023, 11, 1, h, m, s, tzinfo=dt.timezone.utc)
    row = lambda recv, event, seq, bid, flags=0, action="A": (recv, event, action, "B", 100.0, 1, flags, seq, "X", bid, bid + 1, 5, 5, 1, 1)
    rows = [row(at(13, 31), at(13, 29), 1, 50.0), row(at(14, 0), at(14, 0), 5, 60.0), row(at(14, 0), at(14, 0), 5, 61.0), row(at(13, 45), at(13, 45), 9, 62.0), row(at(20, 1), at(19, 59), 10, 63.0), row(at(14, 1), at(14, 1), 11, 64.0, 8), row(at(14, 2), at(14, 2), 12, -1.0)]
    names = "ts_recv ts_event action side price size flags sequence symbol bid_px_00 ask_px_00 bid_sz_00 ask_sz_00 bid_ct_00 ask_ct_00".split()
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    raw = spark.createDataFrame(rows, names)
    raw.coalesce(1).write.parquet(source)
    got = ticks.prepare_book(spark, source, target, rth_only=True, include_quotes=True)
    assert got == {"rows_in": 7, "invalid_book": 1, "events": 4, "trades": 0, "quotes": 4}
    assert ticks.book_counts(raw, rth_only=True).first()["bad_quality"] == 1
    files = sorted((tmp_path / "out" / "events").glob("*.parquet"))
    bids = [r["bid_px_00"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert bids == [62.0, 60.0, 61.0, 63.0]
    assert ticks.check_files(spark, {"gone": (str(tmp_path / "none"), "ts_recv", [])}) == [{"name": "gone", "ready": False, "error": "AnalysisException"}]


def test_importance_finds_what_matters(spark):
    x = synthetic.classification(spark, 300, 2, 1, 1, seed=3).persist()
    got = learning.compare_importance(learning.forest(trees=5, depth=3), x, ["I_1", "N_0"], "bin", ("impurity", "single"), key="id", start="t0", end="t1", k=2).collect()
    for method in ("impurity", "single"):
        own = {r["feature"]: r["mean"] for r in got if r["method"] == method}
        assert own["I_1"] > own["N_0"]
    with pytest.raises(ValueError):
        learning.feature_importance("other", learning.forest(trees=1), x, ["I_1"], "bin", key="id", start="t0", end="t1", k=2)


def test_exact_median(spark):
    import random

    rng = random.Random(9)
    rows = [(s, rng.choice([rng.randrange(5), rng.random() * 1e6, None])) for s in "aab" for _ in range(rng.randrange(900, 1100))] + [("c", 4.0), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame([(s, None if v is None else float(v)) for s, v in rows], "s string, v double")
    want = {s: float(np.median([v for t, v in rows if t == s and v is not None])) for s in "abcd"}
    assert {r["s"]: r["median"] for r in ticks.exact_median(df, "v", by=["s"]).collect()} == pytest.approx(want)
    assert ticks.exact_median(df, "v", by=[]).first()["median"] == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


def test_level_cusum_across_blocks(spark, monkeypatch):
    """Blocks of pairs give what all pairs give, the first of equals included."""
    monkeypatch.setattr(breaks, "PAIRED", 7)
    y = [0.0, 1.0, 1.0, 3.0, 2.0] + [float((i * 7) % 11) for i in range(40)]
    got = column(breaks.level_cusum(series(spark, y), "x", by=BY, order=ORDER), "reference")
    stat = column(breaks.level_cusum(series(spark, y), "x", by=BY, order=ORDER), "statistic")
    for i in range(1, len(y)):
        sigma = math.sqrt(np.mean(np.diff(y[: i + 1]) ** 2))
        if sigma > 0:
            all_ = [(y[i] - y[j]) / (sigma * math.sqrt(i - j)) for j in range(i)]
            assert stat[i] == pytest.approx(max(all_)) and got[i] == int(np.argmax(all_))


def test_slope_tests(spark):
    """p-values against known ones of Student's distribution, and a whole regression."""
    from tickforge.functions import stats

    for t, free, p in ((2.0, 10, 0.07338803477074), (1.0, 1, 0.5), (2.5, 7, 0.04099221858575), (3.1, 25, 0.00474253144799)):
        assert stats.student_p(t, free) == pytest.approx(p, rel=1e-9) and stats.student_p(-t, free) == stats.student_p(t, free)
    assert stats.student_p(0.0, 5) == 1.0 and math.isnan(stats.student_p(math.nan, 5))
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    y = [2.1, 3.9, 6.2, 7.8, 10.1, 11.7]
    row = stats.regression_tests(spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double"), "y", "x", by=[]).first()
    fit = np.polyfit(x, y, 1)
    rest = np.asarray(y) - np.polyval(fit, x)
    se = math.sqrt((rest @ rest) / 4 / np.sum((np.asarray(x) - 3.5) ** 2))
    assert row["n"] == 6 and row["t"] == pytest.approx(fit[0] / se) and row["p_value"] == pytest.approx(stats.student_p(fit[0] / se, 4))
