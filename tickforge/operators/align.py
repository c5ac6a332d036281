"""As-of joins, interval joins, sweeps and calendars over ordered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_on: str, right_on: str, values: list[str], direction: str = "backward", strict: bool = False, offset: int = 0, tie: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Each left row with `values` of the last right row at or before left_on + offset (backward), or the first at or after it (forward).

    Keys are longs (say microseconds). One shuffle by series: both sides are stacked and a running
    last or first value carries right rows to left ones, so nothing is compared pairwise. strict
    leaves out equal keys. `tie` orders right rows of equal key. With `width`, a series is cut into
    stretches of that many key units, each a task's own: only the last right row of each stretch is
    carried on to later ones, so that one long series spreads over the cluster.
    """
    back = direction == "backward"
    marks = right.select(*by, F.col(right_on).cast("long").alias("__k"), F.struct(*[F.col(c) for c in (tie or [])], F.lit(0).alias("__z")).alias("__t"), F.struct(*values).alias("__v"), F.lit(None).cast(left.schema).alias("__row"))
    asks = left.select(*by, (F.col(left_on) + F.lit(offset)).cast("long").alias("__k"), F.lit(None).cast(marks.schema["__t"].dataType).alias("__t"), F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.struct(*left.columns).alias("__row"))
    # At equal keys a mark counts before the ask unless strict; forward reads the order from the end.
    both = marks.unionByName(asks).withColumn("__ask", F.col("__row").isNotNull())
    ask_first = F.when(F.col("__ask"), 0).otherwise(1) if strict == back else F.when(F.col("__ask"), 1).otherwise(0)
    order = [F.col("__k"), ask_first, F.col("__t")]
    group = list(by)
    if width is not None:
        both = both.withColumn("__b", F.floor(F.col("__k") / width).cast("long"))
        group.append("__b")
        last = F.when(~F.col("__ask"), F.struct("__k", "__t"))
        tail = F.max_by("__v", last) if back else F.min_by("__v", last)
        ends = both.groupBy(*group).agg(tail.alias("__v"))  # asks alone give null
        near = Window.partitionBy(*by).orderBy(F.col("__b").asc() if back else F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("__c", F.last("__v", ignorenulls=True).over(near)).select(*group, "__c")
        both = both.join(carried, group)
    w = Window.partitionBy(*group).orderBy(*(order if back else [o.desc() for o in order])).rowsBetween(Window.unboundedPreceding, 0)
    here = F.last("__v", ignorenulls=True).over(w)
    found = both.withColumn("__v", here if width is None else F.coalesce(here, F.col("__c"))).filter("__ask")
    return found.select("__row.*", *[F.col(f"__v.{c}").alias(c) for c in values])


def lookup(left: DataFrame, right: DataFrame, *, on: list[str], values: list[str]) -> DataFrame:
    """left with `values` of its row in right; the job fails if a row has none."""
    r = right.select(*on, *values, F.lit(True).alias("__found"))
    x = left.join(r, on, "left")
    missing = F.raise_error(F.concat(F.lit("no row for "), F.to_json(F.struct(*on))))
    return x.filter(F.when(F.col("__found"), F.lit(True)).otherwise(missing.cast("boolean"))).drop("__found")


def indexed(df: DataFrame, name: str = "place") -> DataFrame:
    """df with its rows numbered 0 .. n - 1 in their order over partitions, without moving them.

    One row a partition is counted first, so df must give the same partitions twice.
    """
    x = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    at, rows = 0, []
    for p, n in sorted((r[0], r[1]) for r in x.groupBy(part.alias("p")).count().collect()):
        rows.append((p, at))
        at += n
    offsets = df.sparkSession.createDataFrame(rows, "__p long, __at long")
    return x.join(F.broadcast(offsets), part == F.col("__p")).withColumn(name, F.col("__at") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__at")


def fill_forward(df: DataFrame, column: str, *, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def interval_join(points: DataFrame, intervals: DataFrame, *, by: list[str], at: str, start: str, end: str, width: int, closed: str = "both") -> DataFrame:
    """Pairs of a point and an interval of its series that holds it: start <= at <= end ("both") or at < end ("left").

    Keys are longs. An interval is copied to each bucket of `width` that it touches and meets the
    points of that bucket by equality, so the plan is a hash or merge join on (series, bucket).
    Choose width near the usual length of an interval.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / width).cast("long"))
    i = intervals.filter(F.col(end) >= F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed == "both" else (F.col(at) < F.col(end)))
    return p.join(i, [*by, "__b"]).filter(inside).drop("__b")


def sweep(points: DataFrame, intervals: DataFrame, *, by: list[str], at: str, start: str, end: str, sums: dict[str, Column], closed: str = "both", width: int | None = None) -> DataFrame:
    """points with, for each name in `sums`, the sum of that expression over the intervals that hold the point.

    Starts add and ends take away; one running sum by series gives every count without a join. With
    `width`, series are cut into stretches of that many key units and each stretch's total is added
    to later ones, so that one long series spreads over the cluster.
    """
    names = list(sums)
    blank = [F.lit(None).cast(points.schema).alias("__row")]
    rise = intervals.select(*by, F.col(start).cast("long").alias("__k"), F.lit(0).alias("__o"), *[sums[n].cast("double").alias(n) for n in names], *blank)
    # Closed intervals end after their last point, half-open ones before the point at their end.
    fall = intervals.select(*by, F.col(end).cast("long").alias("__k"), F.lit(2 if closed == "both" else -1).alias("__o"), *[(-sums[n].cast("double")).alias(n) for n in names], *blank)
    here = points.select(*by, F.col(at).cast("long").alias("__k"), F.lit(1).alias("__o"), *[F.lit(0.0).alias(n) for n in names], F.struct(*points.columns).alias("__row"))
    out, group = rise.unionByName(fall).unionByName(here), list(by)
    if width is not None:
        out = out.withColumn("__b", F.floor(F.col("__k") / width).cast("long"))
        group.append("__b")
        before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        totals = out.groupBy(*group).agg(*[F.sum(n).alias(f"__{n}") for n in names])
        out = out.join(totals.select(*group, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0.0)).alias(f"__{n}") for n in names]), group)
    w = Window.partitionBy(*group).orderBy("__k", "__o")  # rows of equal order share a sum
    for n in names:
        so_far = F.sum(n).over(w)
        out = out.withColumn(n, so_far if width is None else so_far + F.col(f"__{n}"))
    return out.filter(F.col("__row").isNotNull()).select("__row.*", *names)


def running_sums(points: DataFrame, *, by: list[str], at: str, sums: dict[str, Column], width: int | None = None) -> DataFrame:
    """points with, for each name in `sums`, the sum of that expression over the series' points up to this time.

    With `width`, a series is cut into stretches of that many key units, each a task's own; every
    stretch gets the total of those before it.
    """
    names = list(sums)
    if width is None:
        w = Window.partitionBy(*by).orderBy(at)
        return points.withColumns({n: F.sum(sums[n]).over(w) for n in names})
    x = points.withColumn("__b", F.floor(F.col(at) / width).cast("long"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*by, "__b").agg(*[F.sum(sums[n]).alias(f"__{n}") for n in names])
    x = x.join(totals.select(*by, "__b", *[F.sum(f"__{n}").over(before).alias(f"__{n}") for n in names]), [*by, "__b"])
    w = Window.partitionBy(*by, "__b").orderBy(at)
    whole = {n: F.sum(sums[n]).over(w) + F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in names}
    return x.withColumns(whole).drop("__b", *[f"__{n}" for n in names])


def interval_sums(points: DataFrame, intervals: DataFrame, *, by: list[str], at: str, start: str, end: str, sums: dict[str, Column], closed: str = "both", width: int | None = None) -> DataFrame:
    """intervals with, for each name in `sums`, the sum of that expression over the points that they hold; null where none.

    A sum over an interval is the difference of two running sums, so nothing is joined but two reads
    of the points' running sums, whatever the number of points in an interval.
    """
    names = list(sums)
    marks = running_sums(points, by=by, at=at, sums={**sums, "__points": F.lit(1)}, width=width).select(*by, F.col(at).alias("__at"), *names, "__points").dropDuplicates([*by, "__at"])
    read = {**{n: f"__to_{n}" for n in names}, "__points": "__to_points"}
    to = asof_join(intervals, marks.withColumnsRenamed(read), by=by, left_on=end, right_on="__at", values=list(read.values()), strict=closed == "left", width=width)
    both = asof_join(to, marks, by=by, left_on=start, right_on="__at", values=[*names, "__points"], strict=True, width=width)
    held = F.coalesce("__to_points", F.lit(0)) > F.coalesce("__points", F.lit(0))
    out = {n: F.when(held, F.col(f"__to_{n}") - F.coalesce(F.col(n), F.lit(0))) for n in names}
    return both.withColumns(out).drop("__points", "__to_points", *[f"__to_{n}" for n in names])


def densify(counts: DataFrame, *, by: list[str], period: str, step: str, fill: dict[str, object]) -> DataFrame:
    """counts with a row for every period between a series' first and last one; new rows take `fill`."""
    ends = counts.groupBy(*by).agg(F.min(period).alias("__a"), F.max(period).alias("__z"))
    grid = ends.select(*by, F.explode(F.sequence("__a", "__z", F.expr(f"interval {step}"))).alias(period))
    out = grid.join(counts, [*by, period], "left")
    return out.fillna(fill)
