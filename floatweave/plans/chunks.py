"""Chunked analysis of series: one base value and up to 1024 differences a chunk.

Everything is an expression over windows and groups that share the key
(series_id, chunk_id): one exchange serves the maxima, the differences and the
aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, decimals
from ..sources.series import dealt

# fixed values of the format
CHUNK = 1025
HEADER_BYTES, HEADER_BYTES_32 = 27, 15
KEY = ("series_id", "chunk_id")


def chunked(values: DataFrame, size: int = CHUNK) -> DataFrame:
    """Add chunk_id and the place ``j`` within the chunk."""
    return values.withColumn("chunk_id", F.floor(F.col("pos") / size)).withColumn("j", (F.col("pos") % size).cast("int"))


def quantized(values: DataFrame, alpha_mode: str = "exact", per_value_beta: bool = False, single: bool = False, signed_zeros: bool = True) -> DataFrame:
    """Add alpha, beta, is_raw of the chunk, and the integer ``q`` of each value.

    alpha_mode ``brute`` takes the simple search for decimal places. A chunk whose
    digits don't fit 15 places is raw: ``q`` are then the value's bits, sign last.
    ``single`` is the 32-bit format: float arithmetic, 6 places, 32-bit integers.
    Without ``signed_zeros`` a negative zero is a decimal, and a chunk's integers drop its sign.
    """
    v = F.col("value").cast("float") if single else F.col("value")
    own = dealt(chunked(values), *KEY).withColumn("sp", decimals.start_position(v.cast("double")))
    tried, checked, limit = (decimals.tried_places_32, decimals.checked_places_32, decimals.MAX_DIGITS_32) if single else (decimals.tried_places, decimals.checked_places, decimals.MAX_DIGITS)
    if alpha_mode == "exact":  # in two steps, so that the search is evaluated once
        own = own.withColumn("tried", tried(v)).withColumn("a", checked(v, F.col("tried"), signed_zeros)).drop("tried")
    else:
        own = own.withColumn("a", decimals.brute_decimal_places(v))
    w = Window.partitionBy(*KEY)
    sp = F.coalesce(F.max("sp").over(w), F.lit(-99))
    own = own.withColumn("alpha", F.max("a").over(w))
    beta = F.max(F.col("a") + F.coalesce(F.col("sp"), F.lit(-99)) + 1).over(w) if per_value_beta else sp + F.col("alpha") + 1
    own = own.withColumn("beta", beta)
    own = own.withColumn("is_raw", (F.col("alpha") > limit) | (F.col("beta") > limit))
    if single:
        b = bits.float_bits(v)
        raw = F.shiftleft(b, 1).bitwiseXOR(F.shiftright(b, 31)).cast("long")
        scaled = decimals.scaled_32(v, F.col("alpha"))
    else:
        raw = bits.sign_last(bits.double_bits(v))
        scaled = decimals.half_away(v * decimals.power_of_ten(F.least(F.col("alpha"), F.lit(16))))
    return own.withColumn("q", F.when(F.col("is_raw"), raw).otherwise(F.when(~F.col("is_raw"), scaled).cast("long")))


def deltas(values: DataFrame, **how) -> DataFrame:
    """Add the zigzag difference ``zz`` to the value before in the chunk; null for its first."""
    order = Window.partitionBy(*KEY).orderBy("pos")
    own = quantized(values, **how).withColumn("before", F.lag("q").over(order))
    if how.get("single"):
        return own.withColumn("zz", bits.zigzag(bits.wrap_32(F.col("q") - F.col("before"))))
    step = F.when(F.col("is_raw"), bits.wrapping_subtract(F.col("q"), F.col("before"))).otherwise(F.when(~F.col("is_raw"), F.col("q")) - F.when(~F.col("is_raw"), F.col("before")))
    return own.withColumn("zz", F.when(F.col("before").isNotNull(), bits.zigzag(step)))


def chunk_table(values: DataFrame, **how) -> DataFrame:
    """One row a chunk: n, alpha, beta, is_raw, first_value, bit_count, and ``bytes8``, the
    OR of every eight differences, of which all plane sizes follow."""
    own = deltas(values, **how)
    eight = own.groupBy(*KEY, F.floor((F.col("j") - 1) / 8).alias("g")).agg(
        F.count("*").alias("n"), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"), F.first("is_raw").alias("is_raw"),
        F.max(F.when(F.col("j") == 0, F.col("q"))).alias("first_value"), F.bit_or("zz").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    )
    return eight.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.max("alpha").alias("alpha"), F.max("beta").alias("beta"), F.first("is_raw").alias("is_raw"),
        F.max("first_value").alias("first_value"), bits.bit_width(F.coalesce(F.bit_or("m"), F.lit(0).cast("long"))).cast("int").alias("bit_count"),
        F.collect_list("m").alias("bytes8"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"),
    )


def plane_bytes(policy: str = "adaptive") -> Column:
    """array<long>: the bytes of each bit plane, lowest bit first. A plane is stored as a
    bitmap of its non-zero bytes and those bytes where that is shorter."""
    nb = F.size("bytes8")
    bitmap = F.ceil(nb / F.lit(8))
    planes = F.expr("transform(sequence(0, bit_count - 1), i -> cast(size(filter(bytes8, m -> (shiftrightunsigned(m, i) & 1L) = 1L)) as long))")
    sparse = lambda b: b + bitmap
    if policy == "dense":
        return F.transform(planes, lambda b: nb.cast("long"))
    if policy == "sparse":
        return F.transform(planes, lambda b: sparse(b).cast("long"))
    return F.transform(planes, lambda b: F.when(sparse(b) < nb, sparse(b)).otherwise(nb).cast("long"))


def chunk_sizes(values: DataFrame, policy: str = "adaptive", **how) -> DataFrame:
    """The chunk table with ``bytes``, the exact encoded size of each chunk."""
    own = chunk_table(values, **how)
    return own.withColumn("bytes", F.aggregate(plane_bytes(policy), F.lit(HEADER_BYTES_32 if how.get("single") else HEADER_BYTES).cast("long"), lambda s, b: s + b))


def plane_sparsity(values: DataFrame, **how) -> DataFrame:
    """(series_id, chunk_id, plane, nonzero_bytes, n_bytes, is_sparse): plane 0 holds the highest bit."""
    own = chunk_table(values, **how).filter("n > 1")
    own = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bit_count") - 1)))
    used = F.expr("cast(size(filter(bytes8, m -> (shiftrightunsigned(m, i) & 1L) = 1L)) as long)")
    nb = F.size("bytes8")
    return own.select(*KEY, (F.col("bit_count") - 1 - F.col("i")).alias("plane"), used.alias("nonzero_bytes"), nb.cast("long").alias("n_bytes"), ((used + F.ceil(nb / F.lit(8))) < nb).alias("is_sparse"))


def offsets(sizes: DataFrame, group: int = 4096) -> DataFrame:
    """Add the byte ``offset`` of each chunk in its series' stream: running sums within groups of
    chunks, and over the groups' totals, so no task holds all chunks of a series."""
    own = sizes.withColumn("__group", F.floor(F.col("chunk_id") / group))
    before = Window.partitionBy("series_id").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    total = own.groupBy("series_id", "__group").agg(F.sum("bytes").alias("__bytes")).withColumn("__base", F.coalesce(F.sum("__bytes").over(before), F.lit(0))).drop("__bytes")
    w = Window.partitionBy("series_id", "__group").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__within", F.coalesce(F.sum("bytes").over(w), F.lit(0))).join(total, ["series_id", "__group"])
    return own.withColumn("offset", (F.col("__base") + F.col("__within")).cast("long")).drop("__group", "__base", "__within")


def ratios(sizes: DataFrame, width: int = 8) -> DataFrame:
    """(series_id, n_values, n_chunks, bytes, ratio): compressed over original size."""
    total = sizes.groupBy("series_id").agg(F.sum("n").cast("long").alias("n_values"), F.count("*").alias("n_chunks"), F.sum("bytes").cast("long").alias("bytes"))
    return total.withColumn("ratio", F.round(F.col("bytes") / (F.col("n_values") * width), 6))
