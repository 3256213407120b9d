"""Profiles of numeric columns: ranges, outliers, digits, redundant columns, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decimals


def column_profile(values: DataFrame) -> DataFrame:
    """One row a series: range, mean, population deviation, outliers beyond two deviations
    (1 to 255), a factor from the average decimal places of six-digit text, the width
    class of the range, and whether the column is worth cutting."""
    text = F.format_string("%.6f", "value")
    places = F.length(F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", ""))
    base = values.withColumn("places", F.when(places > 0, places))
    first = base.groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("deviation"), F.floor(F.avg("places")).alias("avg_places"),
    )
    # a second pass against the one-row-a-series table, which the optimizer broadcasts or joins by size
    beyond = values.join(first.select("series_id", "mean", "deviation"), "series_id").groupBy("series_id").agg(F.count(F.when(F.abs(F.col("value") - F.col("mean")) > 2 * F.col("deviation"), 1)).alias("outliers"))
    span = F.col("max_value") - F.col("min_value")
    return first.join(beyond, "series_id").select(
        "series_id", "n", "min_value", "max_value", F.round(span, 6).alias("value_range"), F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"),
        F.least(F.lit(255), F.greatest(F.lit(1), F.col("outliers"))).cast("long").alias("outliers"),
        F.when(F.col("avg_places").isNotNull(), F.least(F.lit(20), F.greatest(F.lit(8), F.col("avg_places") + 2))).cast("long").alias("factor"),
        F.when(span > 1000000, 12).when(span > 1000, 11).otherwise(10).cast("long").alias("exponent_bits"),
        F.when(span > 1000000, 32).when(span > 1000, 24).otherwise(16).cast("long").alias("bit_width"),
        ((span > F.col("mean") * 0.1) & (F.col("n") > 1000)).alias("suits_cutting"),
    )


def digit_statistics(texts: DataFrame, group: str, text: str) -> DataFrame:
    """Per group: numbers, average and most decimal places and significant digits of numbers written as text."""
    places, digits = decimals.text_decimal_places(F.col(text)), decimals.text_significant_digits(F.col(text))
    own = texts.select(F.col(group).alias(group), places.alias("p"), digits.alias("d"))
    return own.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("avg_places"), F.max("p").cast("long").alias("max_places"), F.round(F.avg("d"), 6).alias("avg_digits"), F.max("d").cast("long").alias("max_digits")
    )


def similarity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, share): for each pair of columns the share of rows with equal values, from one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = rows.agg(*(F.avg(F.coalesce((F.col(a) == F.col(b)).cast("double"), F.lit(0.0))).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    made = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"s{k}"), 6).alias("share")) for k, (a, b) in enumerate(pairs))))
    return one.select(made.alias("p")).select("p.*")


def redundant_columns(rows: DataFrame, columns: list[str], limit: float = 0.9) -> list[str]:
    """The columns to drop: each that equals an earlier, kept one in more than ``limit`` of the rows."""
    share = {(r["a"], r["b"]): r["share"] for r in similarity(rows, columns).collect()}  # a row for each pair of columns
    kept: list[str] = []
    for c in columns:
        if not any(share[k, c] > limit for k in kept):
            kept.append(c)
    return [c for c in columns if c not in kept]


def column_kinds(rows: DataFrame, columns: list[str], distinct: int = 10) -> DataFrame:
    """(column, n, whole, distinct_values, kept): a column is kept if it has fractions and more distinct values than ``distinct``."""
    parts = [[F.count(c).alias(f"n{k}"), F.count(F.when(F.col(c) % 1 == 0, 1)).alias(f"w{k}"), F.count_distinct(c).alias(f"d{k}")] for k, c in enumerate(columns)]
    one = rows.agg(*(x for p in parts for x in p))
    made = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), F.col(f"w{k}").alias("whole"), F.col(f"d{k}").alias("distinct_values")) for k, c in enumerate(columns))))
    return one.select(made.alias("c")).select("c.*").withColumn("kept", (F.col("whole") < F.col("n")) & (F.col("distinct_values") > distinct))


def clean(rows: DataFrame, columns: list[str], limit: float = 0.9, distinct: int = 10) -> DataFrame:
    """Columns with fractions and many values, without rows that are all null and without redundant columns."""
    kept = [r["column"] for r in column_kinds(rows, columns, distinct).filter("kept").collect()]
    rows = rows.select(*kept).dropna("all")
    gone = redundant_columns(rows, kept, limit)
    return rows.drop(*gone)
