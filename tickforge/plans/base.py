"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
    """Registers a query and its SQL. Columns in `dates` come out as ISO text on both sides, which every client shows alike."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({d: F.col(d).cast("string") for d in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql is not None:
            own = re.sub(r'(?<!["\w])at(?!["\w])', '"at"', sql)  # AT is a keyword in some dialects
            text = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({own})" if dates else own
        return f

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero; a small shift keeps exact halves from going either way."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(float(f"2.71e-{digits + 3}")), digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def q(x: str, digits: int = 6) -> str:
    """r() as SQL."""
    return f"round(({x})::DOUBLE+2.71e-{digits + 3}::DOUBLE,{digits})+0.0::DOUBLE"
