"""Series from tables: an explicit position for every value."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; only a local master may do without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="floatweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


TASK_ROWS = 1 << 19  # what a task sorts or gathers at most, but for a larger block


def tasks_of(df: DataFrame) -> int | None:
    """A number of tasks that grows with the rows of ``df``, as a session's own does not; None for
    a single task's rows, which need none, and for streams, whose rows are not known."""
    if df.isStreaming or (rows := df.count()) <= TASK_ROWS:
        return None
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // TASK_ROWS), min(own, -(-8 * rows // TASK_ROWS)))


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """``df`` by ``key``, in as many tasks as its rows need: windows and groups by ``key`` take no other
    exchange. Those drop a constant from their keys, so it is none here."""

    def constant(c: str) -> bool:
        made = df.select(c)._jdf.queryExecution().optimizedPlan().expressions()
        return made.size() == 1 and made.head().children().size() == 1 and made.head().children().head().foldable()

    n = tasks_of(df)
    return df if n is None else df.repartition(n, *(c for c in key if not constant(c)))


def with_positions(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """Number the rows from 0 in the order of ``order``, without a one-task window.

    The rows are dealt out by range and sorted, written once, and each partition
    adds the count of those before it. Only the counts reach the driver.
    """
    spark = df.sparkSession
    path = scratch(spark, "ordered")
    n = tasks_of(df)
    ranged = (df.repartitionByRange(*order) if n is None else df.repartitionByRange(n, *order)).sortWithinPartitions(*order)
    ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    held = spark.read.parquet(path)
    before, base = 0, []
    for r in held.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():
        base.append((r["__part"], before))
        before += r["n"]
    counts = F.broadcast(spark.createDataFrame(base, "__part int, __base long"))  # a row for each task
    return held.join(counts, "__part").withColumn(name, F.col("__base") + F.col("__row")).drop("__part", "__row", "__base")


def series(df: DataFrame, value: str, order: list[str], series_id: str | None = None) -> DataFrame:
    """(series_id, pos, value) of one column; nulls are dropped before positions are given."""
    own = df.filter(F.col(value).isNotNull()).select(*order, F.col(value).cast("double").alias("__value"))
    numbered = with_positions(own, *order)
    return numbered.select(F.lit(series_id or value).alias("series_id"), "pos", F.col("__value").alias("value"))


def many_series(df: DataFrame, values: list[str], order: list[str]) -> DataFrame:
    """(series_id, pos, value) of several columns of one table, from one pass over its rows."""
    own = with_positions(df.select(*order, *(F.col(v).cast("double").alias(f"__{v}") for v in values)), *order)
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("series_id"), F.col(f"__{v}").alias("value")) for v in values)))
    return own.select("pos", pairs.alias("s")).select("s.series_id", "pos", "s.value").filter("value is not null")


def unpivot_columns(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """All columns after each other as one series: positions run through the first column, then the second."""
    own = with_positions(df.select(*order, *values), *order, name="row")
    n = own.count()
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(v).cast("double").alias("value")) for k, v in enumerate(values))))
    return own.select("row", parts.alias("s")).select(F.lit("all").alias("series_id"), (F.col("s.k") * n + F.col("row")).cast("long").alias("pos"), F.col("s.value").alias("value"))
