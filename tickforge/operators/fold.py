"""Ordered fold: path-dependent operators in one pass over each series, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, by: list[str], order: list[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame | None]], schema: str) -> DataFrame:
    """Run a step over the rows of each series in order.

    make() gives a fresh step for each series; the step gets the series' rows in consecutive blocks,
    keeps its state between them, and returns rows of `schema`. Series are spread by key and each
    task streams its sorted partition, so memory does not depend on a series' length. order must be
    unique within a series.
    """
    spread = df.repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            keys = list(zip(*[pdf[c] for c in by], strict=True))
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if step is None or keys[a] != key:
                    key, step = keys[a], make()
                if (out := step(pdf.iloc[a:b])) is not None and len(out):
                    yield out

    return spread.mapInPandas(run, schema)


class Chain:
    """Steps one after another over the same rows, so that several folds share one pass."""

    def __init__(self, *steps):
        self.steps = steps

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        for step in self.steps:
            pdf = step(pdf)
        return pdf


class Threshold:
    """Greedy threshold: the running sum of a column marks the row at which it reaches `size`, and starts again at zero.

    Adds bar_id (bars closed before the row) and closes (whether the row ends one). A size of zero
    or less closes at each row.
    """

    def __init__(self, column: str, size: float):
        self.column, self.size, self.carry, self.bars = column, size, 0, 0

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[self.column].to_numpy()
        total, n = np.cumsum(x), len(x)
        closes, start, base = np.zeros(n, bool), 0, -self.carry
        if self.size <= 0:
            closes[:] = True
        while self.size > 0 and start < n:
            at = int(np.searchsorted(total[start:], base + self.size, side="left")) + start
            if at >= n:
                break
            closes[at] = True
            base, start = total[at], at + 1
        bar = self.bars + np.concatenate([[0], np.cumsum(closes)[:-1]])
        self.carry = total[-1] - base if start < n else 0
        self.bars += int(closes.sum())
        return pdf.assign(bar_id=bar.astype(np.int64), closes=closes)


class Cusum:
    """Two-sided CUSUM filter over column x: events where a side passes its threshold h, that side starting again.

    The upper side is looked at first; rows with a null or non-positive h, or a null x, are skipped
    and add nothing.
    """

    def __init__(self, x: str, h: str):
        self.x, self.h, self.up, self.down = x, h, 0.0, 0.0

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        up, down = self.up, self.down
        for x, h in zip(pdf[self.x].tolist(), pdf[self.h].tolist(), strict=True):
            if x is None or x != x or h is None or h != h or h <= 0:
                out.append(0)
                continue
            up, down = max(0.0, up + x), min(0.0, down + x)
            if up > h:
                up = 0.0
                out.append(1)
            elif down < -h:
                down = 0.0
                out.append(-1)
            else:
                out.append(0)
        self.up, self.down = up, down
        return pdf.assign(event=np.array(out, np.int64))


class Ewm:
    """Exponentially weighted mean and, if asked for, standard deviation of column x.

    adjust weighs by (1 - alpha)**age and divides by the weights' sum; otherwise the first value
    starts the mean. Results stay null until least values were seen. The deviation is the unbiased
    one for reliability weights. Nulls get null and leave the state alone (no decay).
    """

    def __init__(self, x: str, span: float, adjust: bool = True, least: int = 1, name: str = "ewm", deviation: str | None = None):
        self.x, self.keep, self.adjust, self.least, self.name, self.deviation = x, 1 - 2.0 / (span + 1.0), adjust, least, name, deviation
        self.n, self.w, self.w2, self.mean, self.m2 = 0, 0.0, 0.0, 0.0, 0.0

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        means, stds = [], []
        for x in pdf[self.x].tolist():
            if x is None or x != x:
                means.append(None)
                stds.append(None)
                continue
            self.n += 1
            if self.adjust or self.n == 1:
                self.w, self.w2, self.m2 = self.w * self.keep, self.w2 * self.keep**2, self.m2 * self.keep
                add = 1.0
            else:
                self.w, self.w2, self.m2 = self.keep, self.w2 * self.keep**2, self.m2 * self.keep
                add = 1 - self.keep
            self.w, self.w2 = self.w + add, self.w2 + add * add
            d = x - self.mean
            self.mean += d * add / self.w
            self.m2 += add * d * (x - self.mean)
            means.append(self.mean if self.n >= self.least else None)
            free = self.w - self.w2 / self.w
            stds.append((max(self.m2, 0.0) / free) ** 0.5 if self.n >= max(2, self.least) and free > 0 else None)
        out = pdf.assign(**{self.name: np.array(means, float)})
        return out.assign(**{self.deviation: np.array(stds, float)}) if self.deviation else out


class Recursion:
    """y = rho * y_before + x."""

    def __init__(self, x: str, rho: float, name: str = "y"):
        self.x, self.rho, self.name, self.y = x, rho, name, 0.0

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in pdf[self.x].tolist():
            self.y = self.rho * self.y + x
            out.append(self.y)
        return pdf.assign(**{self.name: np.array(out, float)})


class ImbalanceBars:
    """Dollar imbalance bars with expectations that adapt.

    From the second row on, b is the sign of the price change if it exceeds 1e-5, else the one
    before (at first +1). The bar's imbalance is the sum of b * dollar; it closes where its size
    reaches E[ticks] * |E[b dollar]|. Both expectations are exponentially weighted means without
    adjustment: of the last bar lengths (clipped), and of the last imbalances; the first comes from
    the first `first` imbalances. Kept in memory: those last values only.
    """

    def __init__(self, price: str, dollar: str, first: int = 100, bars: int = 3, clip: tuple[float, float] | None = None):
        self.price, self.dollar, self.first, self.bars = price, dollar, first, bars
        self.clip = clip or (max(1.0, first / 2), 10.0 * first)
        self.before, self.sign, self.theta, self.ticks = None, 1.0, 0.0, 0
        self.expected_ticks, self.expected, self.lengths = float(first), None, []
        self.seen: list[float] = []
        self.most = int(round(bars * self.clip[1])) + 1

    @staticmethod
    def last(values: list[float], span: float) -> float:
        keep = 1 - 2.0 / (max(1, round(span)) + 1.0)
        out = values[0]
        for v in values[1:]:
            out = keep * out + (1 - keep) * v
        return out

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        closes = []
        for price, dollar in zip(pdf[self.price].tolist(), pdf[self.dollar].tolist(), strict=True):
            if self.before is None:
                self.before = price
                closes.append(False)
                continue
            change, self.before = price - self.before, price
            if abs(change) > 1e-5:
                self.sign = 1.0 if change > 0 else -1.0
            imbalance = self.sign * dollar
            self.theta, self.ticks = self.theta + imbalance, self.ticks + 1
            self.seen.append(imbalance)
            if len(self.seen) > max(self.most, self.first):
                del self.seen[0]
            if self.expected is None and len(self.seen) >= self.first:
                self.expected = self.last(self.seen[-self.first :], self.first)
            if self.expected is None or abs(self.expected) < 1e-12 or abs(self.theta) < self.expected_ticks * abs(self.expected):
                closes.append(False)
                continue
            closes.append(True)
            self.lengths = [*self.lengths, self.ticks][-self.bars :]
            self.theta, self.ticks = 0.0, 0
            self.expected_ticks = min(max(self.last(self.lengths, len(self.lengths)), self.clip[0]), self.clip[1])
            span = max(1, round(self.bars * self.expected_ticks))
            self.expected = self.last(self.seen[-span:], span)
        return pdf.assign(closes=np.array(closes, bool))
