"""Helpers that the operators share: durable intermediate tables and Arrow plumbing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local master (single-machine tests) may do without: then a temporary
    folder is chosen and recorded in the session. On a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="floatweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def tasks_for(df: DataFrame) -> int:
    """A number of shuffle tasks that grows with the input: as many as the session names, and
    one for each split of the scan at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage
    ends there, and a lost executor costs nothing that was stashed."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As ``stash``, with the path, for callers that delete the table later."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash_bucketed(df: DataFrame, name: str, key: str, buckets: int, codec: str = "zstd") -> tuple[DataFrame, Callable[[], None]]:
    """As ``stash``, dealt into ``buckets`` by ``key``, so that a join on ``key`` moves the other
    side alone; and a function that drops the table and its files."""
    spark = df.sparkSession
    table, path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", new_path(spark, name)
    df.write.option("compression", codec).option("path", path).bucketBy(buckets, key).saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE {table}")
        discard(spark, path)

    return spark.table(table), drop


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stashed table through Hadoop's file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def settle(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark deletes the shuffle files of steps
    whose results are stashed; else they stay on the executors' disks until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def marked_keys(keys: DataFrame, key: str, per_key: int = 16, most: int = 1 << 26) -> tuple[DataFrame, int]:
    """(word, bits), a bitmap of the longs in ``key``, and its number of slots.

    A Bloom filter of one hash, made and asked by DataFrame operations: ``may_hold`` joins it
    to a table, which so parts into rows that certainly have no partner and rows that may.
    It has some ``per_key`` slots a key, and at most ``most`` slots, that is a row for each 64: its
    broadcast is bounded whatever the data; beyond that more rows are sent the exact way.
    """
    n = keys.count()
    slots = min(most, max(1 << 12, 1 << (per_key * n).bit_length()))
    at = F.pmod(F.col(key), F.lit(slots))
    one = keys.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    return stash(one.groupBy("word").agg(F.bit_or("bit").alias("bits")), "marked-keys"), slots


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def may_hold(df: DataFrame, key: str, bitmap: DataFrame, slots: int, name: str = "marked") -> DataFrame:
    """Add the boolean ``name``: false only where ``key`` is none of the bitmap's keys."""
    word, bits = free_name(df, "bitmap_word"), free_name(df, "bitmap_bits")
    at = F.pmod(F.col(key), F.lit(slots))
    words = F.broadcast(bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    joined = df.join(words, F.shiftright(at, 6).cast("int") == F.col(word), "left")
    bit = F.call_function("shiftright", F.coalesce(bits, F.lit(0).cast("long")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return joined.withColumn(name, bit == 1).drop(word, bits)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that stand for a row: its id, its text and all else in it."""
    plain = {"boolean", "byte", "short", "integer", "long", "float", "double", "string", "binary", "date", "timestamp"}
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = [F.col(f"`{c}`") if docs.schema[c].dataType.typeName() in plain else F.to_json(F.struct(F.col(f"`{c}`"))) for c in rest]
    return F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col), *rest), F.xxhash64(F.lit(2), F.col(text_col), F.col(id_col), *rest)
