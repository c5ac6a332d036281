"""Column helpers shared by operators: ordering, null rules, scalars the engine lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def need(df: DataFrame, *columns: str) -> DataFrame:
    """df, or ValueError naming the columns that it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def ordered(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def running(by: list[str], order: list[str]) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing(by: list[str], order: list[str], n: int) -> WindowSpec:
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def full(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def true(condition: Column) -> Column:
    """A condition that counts null as false."""
    return F.coalesce(condition, F.lit(False))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x held to [low, high]; null stays null (greatest and least alone would skip it)."""
    out = x
    if low is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(high)))
    return out


def finite(x: Column) -> Column:
    """x, null where it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def full_window(value: Column, x: str, w: WindowSpec, n: int) -> Column:
    """value where the window holds n values of x, else null."""
    return F.when(F.count(x).over(w) == n, value)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, as long."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_numeric(text: Column, invalid: float | None = 0.0) -> Column:
    """Numbers with thousands separators and a K, M, B or T suffix; what does not parse is `invalid`."""
    flat = F.upper(F.regexp_replace(F.trim(text), ",", ""))
    scale = F.lit(1.0)
    for suffix, size in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        scale = F.when(flat.endswith(suffix), size).otherwise(scale)
    body = F.when(F.right(flat, F.lit(1)).isin("K", "M", "B", "T"), F.substring(flat, F.lit(1), F.length(flat) - 1)).otherwise(flat)
    value = F.try_multiply(body.try_cast("double"), scale)
    return value if invalid is None else F.coalesce(value, F.lit(invalid))


def parse_count(text: Column) -> Column:
    """parse_numeric() cut to a whole number."""
    return parse_numeric(text).cast("long")


def local_minutes(ts: Column, zone: str = "America/New_York") -> Column:
    """Minutes since local midnight of a UTC timestamp."""
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def regular_hours(ts: Column, zone: str = "America/New_York", start: int = 570, end: int = 960) -> Column:
    """Whether a UTC timestamp lies in local [start, end) minutes."""
    m = local_minutes(ts, zone)
    return true((m >= start) & (m < end))


def week_label(ts: Column) -> Column:
    """The Sunday that ends the week of ts."""
    return F.date_add(F.date_trunc("week", ts).cast("date"), 6)


def business_day(ts: Column) -> Column:
    """The date of ts; Saturdays and Sundays count to the Friday before."""
    day = ts.cast("date")
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
