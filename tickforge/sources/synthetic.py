"""Seeded synthetic tables: each value is a function of its row and the seed, whatever the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *columns: Column | str) -> Column:
    """A value in (0, 1) by hash."""
    return (F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *columns: Column | str) -> Column:
    """A standard normal value by Box-Muller."""
    return F.sqrt(-2 * F.ln(uniform(2 * seed, *columns))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *columns))


def classification(spark: SparkSession, n: int, informative: int, redundant: int, noise: int, seed: int = 0) -> DataFrame:
    """id, t0, t1, I_*, R_* (an informative one plus a little noise), N_*, bin and w; bin depends on informative columns alone."""
    x = spark.range(n)
    x = x.withColumns({f"I_{i}": normal(seed * 1000 + i, "id") for i in range(informative)} | {f"N_{i}": normal(seed * 1000 + 500 + i, "id") for i in range(noise)})
    x = x.withColumns({f"R_{i}": F.col(f"I_{i % informative}") + 0.1 * normal(seed * 1000 + 800 + i, "id") for i in range(redundant)})
    score = sum((F.col(f"I_{i}") * (1 + i % 2) for i in range(informative)), F.lit(0.0))
    start = F.timestamp_micros(F.lit(1_577_836_800_000_000) + F.col("id") * 60_000_000)
    return x.withColumns({"bin": (score + 0.3 * normal(seed * 1000 + 900, "id") > 0).cast("int"), "w": F.lit(1.0 / n), "t0": start, "t1": start})


def correlated_returns(spark: SparkSession, n: int, base: int, extra: int, sigma: float = 0.25, seed: int = 0) -> DataFrame:
    """(t, asset, ret): `base` independent assets and `extra` copies of them with noise, with now and then a shared shock."""
    t = spark.range(n).withColumnRenamed("id", "t")
    x = t.withColumn("asset", F.explode(F.sequence(F.lit(0), F.lit(base + extra - 1))))
    own = F.when(F.col("asset") < base, F.col("asset")).otherwise(F.pmod(F.col("asset"), F.lit(base)))
    common = 0.01 * normal(seed + 1, "t", own)
    return x.select("t", F.concat(F.lit("a"), "asset").alias("asset"), (common + F.when(F.col("asset") >= base, 0.01 * sigma * normal(seed + 2, "t", "asset")).otherwise(0.0)).alias("ret"))


def mixture(spark: SparkSession, n: int, mu: tuple[float, float], sigma: tuple[float, float], p: float, seed: int = 0) -> DataFrame:
    first = uniform(seed + 77, "id") < p
    z = normal(seed + 78, "id")
    return spark.range(n).select("id", F.when(first, mu[0] + sigma[0] * z).otherwise(mu[1] + sigma[1] * z).alias("ret"))


def gaussian(spark: SparkSession, n: int, mu: float = 0.0, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (mu + sigma * normal(seed, "id")).alias("x"))


def sine(spark: SparkSession, n: int, period: float, amplitude: float = 1.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (amplitude * F.sin(2 * math.pi * F.col("id") / period) + noise * normal(seed, "id")).alias("x"))
