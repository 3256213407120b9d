"""Generated series: rows of (series_id, pos, value) from ``range``, with seeds where values are random."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERNS = ("uniform", "linear", "sine", "steps", "cents", "small_sine", "mixed", "runs", "scientific")


def pattern(spark: SparkSession, kind: str, n: int, seed: int = 42) -> DataFrame:
    """One of PATTERNS, ``n`` values.

    uniform: -1000 to 1000; linear: 0.01 i; sine: 1000 sin(0.01 i); steps: ten steps of
    100; cents: 0 to 99.99 in hundredths; small_sine: 100 sin(0.01 i); mixed: uniform
    -100 to 100 and 50 sin(0.1 i) in turn; runs: 30 % zero, 20 % one, 20 % small
    integers, the rest random; scientific: normal, uniform and sine in turn.
    """
    i, u = F.col("pos"), F.rand(seed)
    value = {
        "uniform": u * 2000 - 1000,
        "linear": i * 0.01,
        "sine": 1000 * F.sin(i * 0.01),
        "steps": F.floor(i * 10 / n) * 100.0,
        "cents": F.floor(u * 10000) / 100,
        "small_sine": 100 * F.sin(i * 0.01),
        "mixed": F.when(i % 2 == 0, u * 200 - 100).otherwise(50 * F.sin(i * 0.1)),
        "runs": F.when(u < 0.3, 0.0).when(u < 0.5, 1.0).when(u < 0.7, F.floor(F.rand(seed + 1) * 10)).otherwise(F.rand(seed + 2) * 1000),
        "scientific": F.when(i % 3 == 0, F.randn(seed)).when(i % 3 == 1, u).otherwise(F.sin(i * 0.01)),
    }[kind]
    return spark.range(n).select(F.lit(kind).alias("series_id"), F.col("id").alias("pos")).withColumn("value", value.cast("double"))


def packed_integers(spark: SparkSession, n: int, bit_width: int, base: int = 0, exceptions: float = 0.0, seed: int = 42) -> DataFrame:
    """(series_id, pos, value): integers of a bit width above a base, a share of them out of its range."""
    top = float(2**bit_width)
    regular = F.floor(F.rand(seed) * top) + base
    value = F.when(F.rand(seed + 1) < exceptions, regular + top * 16).otherwise(regular)
    return spark.range(n).select(F.lit(f"bits{bit_width}").alias("series_id"), F.col("id").alias("pos"), value.cast("double").alias("value"))
