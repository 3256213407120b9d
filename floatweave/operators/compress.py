"""Compressing series into tables of blocks, and restoring them.

The blocks of a series are independent: (series_id, block_id, n, min_value,
max_value, payload). Values are gathered a block at a time in the JVM and cross
to Python in Arrow batches of whole blocks; nothing holds a series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import find, registry
from ..sources.series import dealt

KEY = ("series_id", "block_id")
NO_NAN = ("gorilla", "chimp128", "chimp128_f32", "elf", "elf_f32", "elf_star", "elf_star_f32")  # NaN ends their streams


def blocks(values: DataFrame, size: int) -> DataFrame:
    """(series_id, block_id, values): arrays in the order of ``pos``."""
    own = dealt(values.withColumn("block_id", F.floor(F.col("pos") / size)), *KEY)
    rows = own.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("rows"))
    return rows.select(*KEY, F.transform("rows", lambda r: r["value"]).alias("values"))


def compress(values: DataFrame, codec: str = "planes", block: int | None = None) -> DataFrame:
    """The blocks of ``values`` (series_id, pos, value) under a codec of the registry, or ``planes_unsigned``."""
    size = block or find(codec).block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = find(codec)
        kind = np.float64 if one.dtype == "f8" else np.float32
        for batch in batches:
            n, lo, hi, made = [], [], [], []
            for item in batch.column(2):
                v = item.values.to_numpy().astype(kind)
                n.append(len(v))
                good = v[~np.isnan(v)]
                lo.append(float(good.min()) if len(good) else None)
                hi.append(float(good.max()) if len(good) else None)
                made.append(one.encode(v))
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["series_id", "block_id", "n", "min_value", "max_value", "payload"])

    return blocks(values, size).mapInArrow(run, "series_id string, block_id long, n long, min_value double, max_value double, payload binary")


def decompress(packed: DataFrame, codec: str = "planes", block: int | None = None) -> DataFrame:
    """(series_id, pos, value) of a table of blocks."""
    size = block or find(codec).block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = find(codec)
        for batch in batches:
            for k in range(batch.num_rows):
                series, number, n, payload = (batch.column(c)[k].as_py() for c in range(4))
                v = one.decode(payload, n)
                cols = [pa.array([series] * len(v), pa.string()), pa.array(np.arange(len(v)) + number * size, pa.int64()), pa.array(v.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, ["series_id", "pos", "value"])

    return packed.select(*KEY, "n", "payload").mapInArrow(run, "series_id string, pos long, value double")


def without_nan(values: DataFrame) -> DataFrame:
    """``values`` without NaN: the positions of what is left stay.
    Codecs that end a stream with NaN take these."""
    return values.filter(~F.isnan("value"))


def index(packed: DataFrame, group: int = 4096) -> DataFrame:
    """(series_id, block_id, n, bytes, offset): where each block lies in its series' stream."""
    from ..plans.chunks import offsets

    sized = packed.select(*KEY, "n", F.octet_length("payload").cast("long").alias("bytes"))
    return offsets(sized.withColumnRenamed("block_id", "chunk_id"), group).withColumnRenamed("chunk_id", "block_id")


def stream(packed: DataFrame, shard_blocks: int = 16384) -> DataFrame:
    """(series_id, shard, n, bytes, blob): the blocks of each series one after the other, in blobs of
    at most ``shard_blocks`` blocks, since a value of a row is bounded and a series is not."""
    own = packed.withColumn("shard", F.floor(F.col("block_id") / shard_blocks))
    order = F.array_sort(F.collect_list(F.struct("block_id", "payload")))
    joined = own.groupBy("series_id", "shard").agg(F.sum("n").alias("n"), order.alias("parts"))
    # hex text joins in one step, where byte strings would be copied anew for each part
    blob = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["payload"])), ""))
    return joined.select("series_id", "shard", "n", blob.alias("blob")).withColumn("bytes", F.octet_length("blob"))


def split_stream(blobs: DataFrame, chunk: int = 1025, shard_blocks: int = 16384) -> DataFrame:
    """Blocks of one chunk each from blobs of the bit-plane codec: sizes are read from chunk to chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for series, shard, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                at, parts, counts = 0, [], []
                while at < len(blob):
                    size = int.from_bytes(blob[at : at + 8], "little") // 8
                    if size <= 0:
                        raise ValueError("a chunk without a size")
                    parts.append(blob[at : at + size])
                    counts.append(min(chunk, n - chunk * len(counts)))
                    at += size
                cols = [pa.array([series] * len(parts), pa.string()), pa.array(range(shard * shard_blocks, shard * shard_blocks + len(parts)), pa.int64()), pa.array(counts, pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["series_id", "block_id", "n", "payload"])

    return blobs.select("series_id", "shard", "n", "blob").mapInArrow(run, "series_id string, block_id long, n long, payload binary")


def verify(original: DataFrame, restored: DataFrame) -> DataFrame:
    """(n, matching, missing): values compared by their bits at each position."""
    from ..functions.bits import double_bits

    a = original.select("series_id", "pos", F.col("value").alias("x"))
    b = restored.select("series_id", "pos", F.col("value").alias("y"))
    same = F.col("x").isNotNull() & F.col("y").isNotNull() & (double_bits(F.col("x")) == double_bits(F.col("y")))
    both = a.join(b, ["series_id", "pos"], "full").select(same.alias("same"), (F.col("x").isNull() | F.col("y").isNull()).alias("gone"))
    return both.agg(F.count("*").alias("n"), F.count(F.when(F.col("same"), 1)).alias("matching"), F.count(F.when(F.col("gone"), 1)).alias("missing"))


def codec_table(values: DataFrame, codecs: list[str] | None = None, gather: int = 131072) -> DataFrame:
    """(codec, series_id, n_values, bytes, ratio) under each codec.

    Values are gathered once, ``gather`` at a time; each codec cuts them into its own blocks there.
    Codecs that take no NaN see the values without; 32-bit ones see floats."""
    names = codecs or sorted(registry())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = registry()
        for batch in batches:
            rows = []
            for series, item in zip(batch.column(0).to_pylist(), batch.column(2)):
                own = item.values.to_numpy()
                for name in names:
                    one = every[name]
                    v = own.astype(np.float64 if one.dtype == "f8" else np.float32)
                    if name in NO_NAN:
                        v = v[~np.isnan(v)]
                    size = sum(len(one.encode(v[k : k + one.block])) for k in range(0, len(v), one.block))
                    rows.append((name, series, len(v), size, v.itemsize))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["codec", "series_id", "n", "bytes", "width"])

    sizes = blocks(values, gather).mapInArrow(run, "codec string, series_id string, n long, bytes long, width long")
    total = sizes.groupBy("codec", "series_id").agg(F.sum("n").alias("n_values"), F.sum("bytes").alias("bytes"), F.max("width").alias("width"))
    return total.select("codec", "series_id", "n_values", "bytes", F.round(F.col("bytes") / (F.col("n_values") * F.col("width")), 6).alias("ratio"))


def timings(values: DataFrame, codec: str = "planes", runs: int = 3) -> DataFrame:
    """(codec, step, runs, seconds, mb_per_s): mean time of compressing and of restoring ``values``, written
    to nowhere, over ``runs`` runs after one that is not counted; and a row for the ratio of the two."""
    import time

    spark = values.sparkSession
    size = values.count() * (8 if registry()[codec].dtype == "f8" else 4) / 2**20

    def mean(df: DataFrame) -> float:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return sum(took[1:]) / runs

    packed = compress(values, codec)
    both = [("compress", mean(packed)), ("round_trip", mean(decompress(packed, codec)))]
    rows = [(codec, step, runs, s, size / s if s else None) for step, s in both]
    rows.append((codec, "round_trip_over_compress", runs, both[1][1] / both[0][1], None))
    return spark.createDataFrame(rows, "codec string, step string, runs int, seconds double, mb_per_s double")
