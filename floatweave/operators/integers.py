"""Runs, differences, frames of reference and decimal scaling as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, decimals
from ..sources.series import dealt

MAX_E, SAMPLES, VECTOR, GROUP, STEP = 18, 32, 1024, 100, 12  # fixed values of the decimal scaling


def _order(extra: tuple[str, ...] = ()) -> Window:
    return Window.partitionBy("series_id", *extra).orderBy("pos")


def in_blocks(values: DataFrame, size: int) -> DataFrame:
    return values.withColumn("block_id", F.floor(F.col("pos") / size))


def runs(values: DataFrame, block: int = 4096) -> DataFrame:
    """(series_id, block_id, run, start, value, length) of the runs within blocks."""
    own = dealt(in_blocks(values, block), "series_id", "block_id")
    w = _order(("block_id",))
    new = F.coalesce((F.col("value") != F.lag("value").over(w)).cast("long"), F.lit(1).cast("long"))
    own = own.withColumn("new", new).withColumn("run", F.sum("new").over(w) - 1)
    return own.groupBy("series_id", "block_id", "run").agg(F.min("pos").alias("start"), F.first("value").alias("value"), F.count("*").alias("length"))


def expand_runs(found: DataFrame) -> DataFrame:
    """The values of ``runs``."""
    return found.select("series_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"), "value")


def differences(integers: DataFrame, block: int = 1025) -> DataFrame:
    """(series_id, block_id, pos, first, zz): the first value of each block, zigzag differences after it."""
    own = dealt(in_blocks(integers, block), "series_id", "block_id")
    w = _order(("block_id",))
    return own.withColumn("before", F.lag("q").over(w)).select(
        "series_id", "block_id", "pos", F.when(F.col("before").isNull(), F.col("q")).alias("first"), bits.zigzag(F.col("q") - F.col("before")).alias("zz")
    )


def running_sum(found: DataFrame) -> DataFrame:
    """The integers of ``differences``."""
    w = _order(("block_id",)).rowsBetween(Window.unboundedPreceding, 0)
    return found.select("series_id", "pos", F.sum(F.coalesce("first", bits.unzigzag(F.col("zz")))).over(w).alias("q"))


def frames(integers: DataFrame, block: int = 1024) -> DataFrame:
    """(series_id, block_id, n, base, bit_width, bytes): frame of reference and packed size of each block."""
    own = in_blocks(integers, block).groupBy("series_id", "block_id").agg(F.count("*").alias("n"), F.min("q").alias("base"), F.max("q").alias("top"))
    width = F.when(F.col("top") == F.col("base"), 0).otherwise(bits.bit_width(F.col("top") - F.col("base"))).cast("long")
    return own.select("series_id", "block_id", "n", "base", width.alias("bit_width"), F.ceil(F.col("n") * width / 8).cast("long").alias("bytes"))


def grid_sizes(values: DataFrame, cube: int = 4096) -> DataFrame:
    """(series_id, cube_id, bytes) of the block-transform codec in one dimension: a word for each
    64 values, and a word for each bit set in their OR. Values beyond whole cubes are left out."""
    own = values.withColumn("cube_id", F.floor(F.col("pos") / cube)).withColumn("x", bits.rotate_left_1(bits.double_bits(F.col("value"))))
    own = dealt(own, "series_id", "cube_id")
    w = Window.partitionBy("series_id", "cube_id").orderBy("pos")
    own = own.withColumn("before", F.lag("x").over(w))
    step = F.when(F.col("before").isNull(), F.col("x")).otherwise(bits.wrapping_subtract(F.col("x"), F.col("before")))
    own = own.withColumn("y", bits.complement_negative(step)).groupBy("series_id", "cube_id", F.floor(F.col("pos") % cube / 64).alias("g")).agg(F.bit_or("y").alias("head"), F.count("*").alias("n"))
    sized = own.groupBy("series_id", "cube_id").agg(F.sum("n").alias("n"), F.sum(F.lit(8) + 8 * F.bit_count("head")).alias("bytes"))
    return sized.filter(F.col("n") == cube).select("series_id", "cube_id", F.col("bytes").cast("long"))


def sub_chunk_sizes(values: DataFrame, block: int = 16384) -> DataFrame:
    """(series_id, block_id, bytes) of the sub-chunk codec in one dimension, for blocks of whole
    sub-chunks: half a byte a value and the bytes of its difference to the sub-chunk before."""
    own = in_blocks(values.withColumn("x", bits.double_bits(F.col("value"))), block)
    own = own.withColumn("s", F.floor(F.col("pos") / 32))
    last = own.filter((F.col("pos") % 32 == 31) & ((F.col("pos") + 1) % block != 0)).select("series_id", (F.col("s") + 1).alias("s"), F.col("x").alias("before"))
    own = own.join(last, ["series_id", "s"], "left")
    d = bits.wrapping_subtract(F.col("x"), F.coalesce("before", F.lit(0).cast("long")))
    own = own.withColumn("d", d).withColumn("size", F.when(F.col("d") == -(2**63), F.col("d")).otherwise(F.abs(F.when(F.col("d") == -(2**63), 0).otherwise(F.col("d")))))
    used = F.when(F.col("size") == 0, 0).otherwise(F.ceil(bits.bit_width(F.col("size")) / 8))
    own = own.withColumn("used", F.when(used == 2, 3).otherwise(used))
    sized = own.groupBy("series_id", "block_id").agg(F.count("*").alias("n"), F.sum("used").alias("used"))
    return sized.filter(F.col("n") % 32 == 0).select("series_id", "block_id", (F.col("used") + F.col("n") / 2).cast("long").alias("bytes"))


def xor_histogram(values: DataFrame, block: int = 65536) -> DataFrame:
    """(series_id, lead, trail, n): leading and trailing zeros of each value XORed with the one before.

    Windows are as long as a block; the last value of each block is handed to the next one."""
    own = in_blocks(values.select("series_id", "pos", bits.double_bits(F.col("value")).alias("x")), block)
    border = own.filter(F.col("pos") % block == block - 1).select("series_id", (F.col("pos") + 1).alias("pos"), (F.col("block_id") + 1).alias("block_id"), F.col("x").alias("handed"))
    both = own.withColumn("handed", F.lit(None).cast("long")).unionByName(border.withColumn("x", F.lit(None).cast("long")).select("series_id", "pos", "x", "block_id", "handed"))
    w = Window.partitionBy("series_id", "block_id").orderBy("pos", F.col("handed").isNull())
    both = both.withColumn("d", F.col("x").bitwiseXOR(F.lag(F.coalesce("x", "handed")).over(w))).filter("d is not null")
    return both.groupBy("series_id", bits.leading_zeros(F.col("d")).cast("long").alias("lead"), bits.trailing_zeros(F.col("d")).cast("long").alias("trail")).agg(F.count("*").alias("n"))


def scaled(v: Column, e: Column, f: Column) -> tuple[Column, Column]:
    """(integer, whether it gives the value back) under the pair (e, f)."""
    up = F.array(*(F.lit(float(f"1e{k}")) for k in range(MAX_E + 1)))
    down = F.array(*(F.lit(float(f"1e-{k}")) for k in range(MAX_E + 1)))
    t = v * F.element_at(up, e + 1) * F.element_at(down, f + 1)
    q = F.when(F.abs(t) < 9.2e18, decimals.nearest_even(t))
    back = q * F.element_at(up, f + 1) * F.element_at(down, e + 1)
    # the codec keeps the sign of a zero
    return q, F.coalesce((back == v) & ~decimals.is_negative_zero(v), F.lit(False))


def pair_search(values: DataFrame) -> DataFrame:
    """(series_id, group_id, vector_id, e, f, bits): the best pair of each sampled vector.

    Of every twelfth whole vector of a row group 32 values at equal distances are
    tried under all 190 pairs: a bounded fan-out of a fixed sampling rate.
    """
    own = values.withColumn("vector_id", F.floor(F.col("pos") / VECTOR)).withColumn("group_id", F.floor(F.col("pos") / (VECTOR * GROUP)))
    own = own.filter((F.col("vector_id") % GROUP % STEP == 0) & (F.col("pos") % (VECTOR // SAMPLES) == 0))
    own = own.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(MAX_E)))).withColumn("f", F.explode(F.sequence(F.lit(0), F.col("e"))))
    q, ok = scaled(F.col("value"), F.col("e"), F.col("f"))
    own = own.withColumn("q", q).withColumn("ok", ok)
    sized = own.groupBy("series_id", "group_id", "vector_id", "e", "f").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("fit"), F.min(F.when(F.col("ok"), F.col("q"))).alias("lo"), F.max(F.when(F.col("ok"), F.col("q"))).alias("hi")
    )
    width = F.when(F.col("hi") == F.col("lo"), 0).when(F.col("hi") - F.col("lo") < F.lit(9.2233720368547e18), F.length(F.bin((F.col("hi") - F.col("lo")).cast("long")))).otherwise(64)
    sized = sized.filter((F.col("n") == SAMPLES) & (F.col("fit") >= 2)).withColumn("bits", (F.col("n") * width + (F.col("n") - F.col("fit")) * 80).cast("long"))
    best = F.min(F.struct("bits", (-F.col("e")).alias("e"), (-F.col("f")).alias("f"))).alias("b")
    return sized.groupBy("series_id", "group_id", "vector_id").agg(best).select("series_id", "group_id", "vector_id", (-F.col("b.e")).cast("long").alias("e"), (-F.col("b.f")).cast("long").alias("f"), F.col("b.bits").alias("bits"))


def left_parts(values: DataFrame, right_bits: int = 48, keep: int = 8) -> DataFrame:
    """(series_id, left, n, rank): the most frequent upper parts of the values' bits, at most ``keep``."""
    left = F.shiftrightunsigned(bits.double_bits(F.col("value")), right_bits)
    counted = values.groupBy("series_id", left.alias("left")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("series_id").orderBy(F.desc("n"), "left")
    return counted.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= keep)
