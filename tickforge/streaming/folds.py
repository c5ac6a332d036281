"""The batch folds over streams, time bars with a watermark, and sessions of events."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_fold(df: DataFrame, by: list[str], order: list[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame | None]], schema: str) -> DataFrame:
    """ordered_fold() over a stream: each micro-batch continues every series' step from its saved state.

    Rows of a series are sorted within a micro-batch; later ones must not be earlier in order, so feed
    it from an ordered source. The step's state, a few numbers, is pickled between batches.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(list(batches)).sort_values(order)
        out = step(rows)
        state.update((pickle.dumps(step),))
        if out is not None and len(out):
            yield out

    return df.groupBy(*by).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def time_bars(df: DataFrame, *, by: list[str], at: str, order: list[str], length: str, late: str, price: str, sums: list[str] = (), slide: str | None = None) -> DataFrame:
    """Open, high, low, close and sums by window of event time; rows later than `late` are dropped once a window is done."""
    o = F.struct(*order)
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return df.withWatermark(at, late).groupBy(*by, w.alias("window")).agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), F.count("*").alias("ticks"), *[F.sum(c).alias(c) for c in sums])


def sessions(df: DataFrame, *, by: list[str], at: str, gap: str, late: str) -> DataFrame:
    """Runs of rows with no pause of `gap` or more: their start, end and size."""
    return df.withWatermark(at, late).groupBy(*by, F.session_window(at, gap).alias("session")).agg(F.count("*").alias("n"))
