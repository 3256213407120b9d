"""Numbers from text and CSV files: catalogues, columns, whole files, tokens, and splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what stands for a missing number
NULL_TOKENS = ("NULL", "null", "NaN", "nan", "NA", "na", "inf", "INF", "-inf", "-INF", "#N/A", "#ERROR", "?", "-")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
EDGES = "[](){}\"'<>"


def cell(text: Column) -> Column:
    """A cell without blanks and quotes at its ends."""
    return F.regexp_replace(text, "^[\\s\"']+|[\\s\"']+$", "")


def strict_number(text: Column) -> Column:
    """The number that a whole cell is, null for tokens of missing numbers and anything else."""
    c = cell(text)
    v = F.when(c.rlike(NUMBER) & ~c.isin(*NULL_TOKENS), c.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def prefix_number(text: Column) -> Column:
    """The finite number that a cell starts with, null if it starts with none."""
    found = F.regexp_extract(text, PREFIX, 1)
    v = F.when(found != "", found.try_cast("double"))
    return F.when(F.abs(v) != float("inf"), v)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): lines with their files; ``at`` orders the lines of a file."""
    read = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return read.withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("row"))).select("file", "at", F.col("value").alias("line"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(column_id, file, place, name) of every header cell of the CSV files under ``path``, with running ids."""
    first = _lines(spark, path).groupBy("file").agg(F.min(F.struct("at", "line")).alias("f")).select("file", F.posexplode(F.split("f.line", ",")).alias("place", "name"))
    named = first.select("file", "place", cell(F.col("name")).alias("name")).orderBy("file", "place")
    from .series import with_positions

    return with_positions(named, "file", "place", name="column_id").select("column_id", "file", F.col("place").cast("long").alias("place"), "name")


def csv_column(spark: SparkSession, path: str, name: str, sep: str = ",") -> DataFrame:
    """(series_id, pos, value) of one column by its header name, file by file in the order of their
    paths; cells that are no number are left out."""
    from .series import with_positions

    rows = spark.read.option("header", "true").option("sep", sep).csv(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    own = rows.select(*place, strict_number(F.col(f"`{name}`")).alias("value")).filter("value is not null")
    return with_positions(own, "file", "block", "at").select(F.lit(name).alias("series_id"), "pos", "value")


def csv_flat(spark: SparkSession, path: str, sep: str = ",", figures: int | None = None, as_float: bool = False) -> DataFrame:
    """(series_id, pos, value): all finite cells, column after column, each file by file in the order
    of their paths. Rows may have different lengths; a header vanishes, as it is no number.
    ``figures`` cuts to significant digits (at least one)."""
    from ..functions.decimals import significant_figures
    from .series import with_positions

    cells = _lines(spark, path).select("file", "at", F.posexplode(F.split("line", f"[{sep}]")).alias("place", "text"))
    own = cells.select("place", "file", F.col("at.block").alias("block"), F.col("at.row").alias("row"), prefix_number(F.col("text")).alias("value")).filter("value is not null")
    if figures is not None:
        own = own.withColumn("value", significant_figures(F.col("value"), figures))
    if as_float:
        own = own.withColumn("value", F.col("value").cast("float").cast("double"))
    return with_positions(own, "place", "file", "block", "row").select(F.lit("all").alias("series_id"), "pos", "value")


def skipped_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, cells, skipped): how many cells of each file ``csv_flat`` takes for no number."""
    cells = _lines(spark, path).select("file", F.explode(F.split("line", f"[{sep}]")).alias("text"))
    return cells.groupBy("file").agg(F.count("*").alias("cells"), F.count(F.when(prefix_number(F.col("text")).isNull(), 1)).alias("skipped"))


def flatten_rows(spark: SparkSession, path: str, out: str, sep: str = ",") -> DataFrame:
    """All finite cells row after row, written as CSV with the one column ``floats``; and (pos, floats)."""
    from .series import with_positions

    cells = _lines(spark, path).select("file", F.col("at.block").alias("block"), F.col("at.row").alias("row"), F.posexplode(F.split("line", f"[{sep}]")).alias("place", "text"))
    own = cells.select("file", "block", "row", "place", strict_number(F.col("text")).alias("floats")).filter("floats is not null")
    flat = with_positions(own, "file", "block", "row", "place").select("pos", "floats")
    flat.repartitionByRange("pos").sortWithinPartitions("pos").select("floats").write.mode("overwrite").option("header", "true").csv(out)
    return flat


def number_tokens(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """(*keep, token): tokens between commas, semicolons and blanks that are numbers."""
    tokens = texts.select(*keep, F.explode(F.split(F.col(text), "[,\\s;]+")).alias("token"))
    tokens = tokens.withColumn("token", F.btrim(F.col("token"), F.lit(EDGES)))
    return tokens.filter(F.col("token").rlike(NUMBER) & ~F.lower("token").isin("nan", "inf"))


def valid_cells(lines: Column, sep: str = ",") -> Column:
    """How many cells of a line are finite numbers."""
    return F.size(F.filter(F.split(lines, f"[{sep}]"), lambda c: F.coalesce(c.try_cast("double").isNotNull() & ~F.isnan(c.try_cast("double")) & (F.abs(c.try_cast("double")) != float("inf")), F.lit(False))))


def rows_for_size(megabytes: float, columns: int, total: int) -> int:
    """Rows of ``columns`` doubles that fill a size, no more than there are."""
    return min(total, int(megabytes * 2**20 / (columns * 8) + 0.5))


#: sizes of the splitter in megabytes where none are given
DEFAULT_SIZES = (30, 60, 90, 120, 150, 180, 210, 240, 270, 300)


def sizes_between(first: float, last: float, step: float) -> list[float]:
    """first, first + step, ... up to last."""
    if step <= 0 or last < first:
        raise ValueError("sizes rise by a positive step")
    return [first + k * step for k in range(int((last - first) / step + 1e-9) + 1)]


def split_by_size(rows: DataFrame, order: list[str], columns: list[str], sizes: list[float] | None, path: str) -> list[str]:
    """Write the first rows of ``rows`` as CSV folders, one for each size in megabytes; headers are kept."""
    from .series import with_positions

    numbered, made = with_positions(rows.select(*dict.fromkeys([*order, *columns])), *order, name="__pos"), []
    total = numbered.count()
    for size in sizes or DEFAULT_SIZES:
        out = f"{path}/size_{size:g}mb"
        numbered.filter(F.col("__pos") < rows_for_size(size, len(columns), total)).orderBy("__pos").select(*columns).write.mode("overwrite").option("header", "true").csv(out)
        made.append(out)
    return made


_KINDS = {"double": "<f8", "float": "<f4", "long": "<i8", "int": "<i4", "short": "<i2"}


def to_binary(rows: DataFrame, column: str, order: list[str], path: str, kind: str = "double") -> None:
    """Write one column as little-endian binary values, or as strings that each end in a newline, in
    blocks ordered by position (Parquet: ``block_id``, ``data``)."""
    from .series import with_positions

    if kind == "string":
        own = with_positions(rows.select(*dict.fromkeys([*order, column])), *order).withColumn("block_id", F.floor(F.col("pos") / 131072))
        parts = own.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("\n")).alias("s")))).alias("parts"))
        parts.select("block_id", F.encode(F.array_join(F.transform("parts", lambda p: p["s"]), ""), "UTF-8").alias("data")).write.parquet(path)
        return
    import pyarrow as pa

    from ..operators.compress import blocks
    from .series import series

    def run(batches):
        for batch in batches:
            data = [v.values.to_numpy().astype(_KINDS[kind]).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["block_id", "data"])

    blocks(series(rows, column, order), 131072).select("block_id", "values").mapInArrow(run, "block_id long, data binary").write.parquet(path)


def from_binary(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(series_id, pos, value) of binary files of values; each file is a series named by its path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("dims"), "content")
    return files.mapInArrow(_values_of(1), "series_id string, pos long, value double")


def _values_of(keep: int):
    """(name, kind, dims, content) to (series_id[, dims], pos, value), some values at a time; raises where dims don't fit the file."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for name, kind, dims, data in zip(*(c.to_pylist() for c in batch.columns)):
                flat = np.frombuffer(data, np.dtype(_KINDS[kind]))
                extent = [int(d) for d in re.split("[ x,]+", dims.strip())] if dims else [len(flat)]
                if int(np.prod(extent)) != len(flat):
                    raise ValueError(f"{name} holds {len(flat)} values, not {dims}")
                for at in range(0, len(flat), 1 << 17):
                    v = flat[at : at + (1 << 17)].astype(np.float64)
                    cols = [pa.array([name] * len(v), pa.string()), pa.array([extent] * len(v), pa.list_(pa.int64())), pa.array(np.arange(at, at + len(v)), pa.int64()), pa.array(v)]
                    if keep == 1:
                        del cols[1]
                    yield pa.RecordBatch.from_arrays(cols, ["series_id", "dims", "pos", "value"] if keep == 2 else ["series_id", "pos", "value"])

    return run


def described(spark: SparkSession, descriptor: str, folder: str) -> DataFrame:
    """(series_id, dims, pos, value) of the binary files that a descriptor lists, one a line:
    file;type;dims, where the type is double or float and dims are extents, slowest first."""
    listed = spark.read.option("sep", ";").schema("name string, kind string, dims string").csv(descriptor)
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = listed.select(F.trim("name").alias("name"), F.lower(F.trim("kind")).alias("kind"), "dims").join(files, "name")
    return rows.select("name", "kind", "dims", "content").mapInArrow(_values_of(2), "series_id string, dims array<long>, pos long, value double")
