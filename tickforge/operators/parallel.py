"""Python functions over groups of atoms (rows), the groups balanced by size or by cost."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import indexed


def linear_parts(n: int, k: int) -> list[int]:
    """Bounds of at most k groups of n atoms, sizes differing by one at most."""
    k = max(1, min(k, n))
    return [math.ceil(n * i / k) for i in range(k + 1)]


def nested_parts(n: int, k: int, heavy_first: bool = False) -> list[int]:
    """Bounds of at most k groups of equal cost if atom i costs i + 1 (or n - i with heavy_first).

    The first r atoms cost r (r + 1) / 2, so bound j is where that is j / k of the whole.
    """
    k = max(1, min(k, n))
    bounds = [round((math.sqrt(1 + 4 * n * (n + 1) * j / k) - 1) / 2) for j in range(k + 1)]
    return [n - b for b in reversed(bounds)] if heavy_first else bounds


def map_atoms(atoms: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, order: list[str], groups: int, nested: bool = False, heavy_first: bool = False) -> DataFrame:
    """fn over `groups` runs of atoms in order; nested balances work that grows along (or, heavy_first, falls along) the order.

    Atoms are sorted and numbered without gathering them; each group is one task's DataFrame.
    """
    x = indexed(atoms.orderBy(*order), "__place")
    n = atoms.count()
    bounds = nested_parts(n, groups, heavy_first) if nested else linear_parts(n, groups)
    group = sum((F.when(F.col("__place") >= b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
    return x.withColumn("__group", group).groupBy("__group").applyInPandas(lambda pdf: fn(pdf.sort_values("__place").drop(columns=["__place", "__group"])), schema)
