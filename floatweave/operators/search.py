"""Questions to compressed series, with blocks ruled out by their least and greatest value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compress import decompress


def exists_value(values: DataFrame, x: float) -> DataFrame:
    """(series_id, found) over plain values."""
    return values.groupBy("series_id").agg(F.coalesce(F.bool_or(F.col("value") == x), F.lit(False)).alias("found"))


def exists_packed(packed: DataFrame, x: float, codec: str = "planes", block: int | None = None) -> DataFrame:
    """(series_id, found, decoded): only blocks whose range holds ``x`` are decoded.

    ``packed`` should be a stored table: the range then is checked in the scan, and the payload is
    read of those blocks alone; the count of blocks reads no payload at all."""
    holds = (F.col("min_value") <= x) & (F.col("max_value") >= x)
    hit = decompress(packed.filter(holds), codec, block).filter(F.col("value") == x).select("series_id").distinct().withColumn("found", F.lit(True))
    opened = packed.select("series_id", "min_value", "max_value").groupBy("series_id").agg(F.count(F.when(holds, 1)).alias("decoded"))
    return opened.join(hit, "series_id", "left").select("series_id", F.coalesce("found", F.lit(False)).alias("found"), "decoded")


def all_equal(rows: DataFrame, columns: list[str], x: float, lane: Column | None = None) -> DataFrame:
    """(found): whether a row, or with ``lane`` a whole lane of rows, has ``x`` in every column."""
    every = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) == x) for c in columns])
    if lane is None:
        return rows.agg(F.coalesce(F.bool_or(every), F.lit(False)).alias("found"))
    return rows.groupBy(lane.alias("lane")).agg(F.bool_and(every).alias("whole")).agg(F.coalesce(F.bool_or("whole"), F.lit(False)).alias("found"))


def arithmetic(values: DataFrame, repeats: int = 10) -> DataFrame:
    """A chain of integer steps that ends in zero, as a load on the projection path."""
    x = F.col("value").cast("long")
    for _ in range(repeats):
        x = F.shiftright(F.shiftleft(x * 3, 3) + 3, 3).bitwiseAND(F.lit(0).cast("long"))
    return values.select("series_id", "pos", x.alias("value"))
