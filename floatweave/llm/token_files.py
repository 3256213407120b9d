"""Token files: ids of whole texts, range-coded, in ascending order of doc_id.

A token file set is a folder with two Parquet containers, since only Spark's
writers reach every store: ``table`` (symbol, freq), the one frequency table,
and ``segments``, a row for a run of whole documents: shard and segment number,
the document ids and lengths, and ``data``, whose blocks (``rans``) each decode
alone. Shards are ranges of doc_id in ascending order, segments within a shard
are too, so ``start`` follows from the lengths.

Writing: the texts are dealt out by range and sorted; a task tokenises its
range and packs runs of about ``segment_tokens`` ids, stashed once, with the
counts of its ids; their sum over all tasks gives the table, and a second pass
codes each run by itself.

Cases: a null or empty text has the end id alone; null ids sort first; rows of
one id are ordered by a hash of their text; repeated rows each get their ids;
extra columns are ignored; an empty table gives an empty file set. A text longer
than a run makes a run of its own, and a task tokenises some millions of
characters at a time, or one text if it is longer.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import discard, stash_at, tasks_for
from .pretokens import ByteLevelEncoder, load_tokenizer

_RUN = "shard long, seg long, first long, docs array<long>, lens array<long>, ids binary, symbols array<int>, counts array<long>"
_SEGMENT = "shard long, seg long, first long, n_tokens long, docs array<long>, lens array<long>, data binary"
_held: dict[tuple[str, str], ByteLevelEncoder] = {}


def _dtype(path: str) -> str:
    return "<u2" if load_tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _runs(path: str, end_id: int, segment_tokens: int, size: int, part_chars: int = 6_000_000):
    """Sorted (doc_id, text) to runs of whole documents. The task's last run carries the counts
    of all its symbols, so the frequency table takes no pass of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _dtype(path)
        if (path, dtype) not in _held:
            _held[path, dtype] = ByteLevelEncoder(path, dtype)
        enc = _held[path, dtype]
        shard, seg, first = TaskContext.get().partitionId(), 0, 0
        docs, lens, parts = [], [], []
        held = 0
        total = np.zeros(size, np.int64)

        def row(last: bool = False):
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            at = np.flatnonzero(total) if last else total[:0]
            cols = [[shard], [seg], [first], [docs], [lens], [b"".join(parts)], [at], [total[at]]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "seg", "first", "docs", "lens", "ids", "symbols", "counts"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (chars < part_chars or to == at) and to - at < 4096:
                    chars += len(texts[to])
                    to += 1
                ids, n = enc.encode(texts[at:to])
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                total += np.bincount(ids, minlength=size)
                ends += np.arange(1, len(ends) + 1)
                n += 1
                done = 0
                while done < len(n):  # as many documents as fill the run
                    base = ends[done - 1] if done else 0
                    upto = min(len(n), int(np.searchsorted(ends, base + segment_tokens - held)) + 1)
                    docs += names[at + done : at + upto]
                    lens += n[done:upto].tolist()
                    parts.append(ids[base : ends[upto - 1]].tobytes())
                    held += int(ends[upto - 1] - base)
                    done = upto
                    if held >= segment_tokens:
                        yield row()
                        seg, first = seg + 1, first + held
                        docs, lens, parts, held = [], [], [], 0
                at = to
        if docs or total.any():
            yield row(last=True)

    return run


def _code(dtype: str, freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                ids = np.frombuffer(one.column(5)[0].as_buffer(), dtype)
                blocks = rans.encode(ids, table)
                data = struct.pack(f"<4sI{len(blocks)}I", b"RANS", len(blocks), *map(len, blocks)) + b"".join(blocks)
                cols = [*one.columns[:3], pa.array([len(ids)], pa.int64()), one.column(3), one.column(4), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "seg", "first", "n_tokens", "docs", "lens", "data"])

    return run


def blocks_of(data: bytes) -> list[bytes]:
    """The blocks of a segment's data."""
    magic, n = struct.unpack_from("<4sI", data)
    if magic != b"RANS":
        raise ValueError("not a token segment")
    ends = np.cumsum([8 + 4 * n, *struct.unpack_from(f"<{n}I", data, 8)])
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 4 * rans.BLOCK) -> None:
    """Write the ids of ``docs``, each followed by ``end_id``, as a token file set at ``path``."""
    spark, dtype = docs.sparkSession, _dtype(tokenizer)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = src.repartitionByRange(tasks_for(src), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    size = max(load_tokenizer(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1)
    runs, held = stash_at(src.mapInArrow(_runs(tokenizer, end_id, segment_tokens, size), _RUN), "token-runs")
    counted = runs.select(F.explode(F.arrays_zip("symbols", "counts")).alias("c")).groupBy("c.symbols").agg(F.sum("c.counts").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in counted.collect():  # a row for each symbol of the vocabulary at most
        counts[row["symbols"]] = row["n"]
    freq = rans.scale(counts)
    at = np.flatnonzero(freq)
    table = spark.createDataFrame(list(zip(at.tolist(), freq[at].tolist())), "symbol long, freq long")
    table.coalesce(1).write.parquet(f"{path}/table")
    runs = runs.filter(F.size("docs") > 0).drop("symbols", "counts")
    runs.mapInArrow(_code(dtype, freq), _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")
    discard(spark, held)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of a token file set. Raises on a failed checksum."""
    table = spark.read.schema("symbol long, freq long").parquet(f"{path}/table").collect()  # the vocabulary at most
    freq = np.zeros(1 + max([0, *(r["symbol"] for r in table)]), np.int64)
    for r in table:
        freq[r["symbol"]] = r["freq"]
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each shard, that is task
    base, start = {}, 0
    for r in totals:
        base[r["shard"]], start = start, start + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Table(freq)
        for batch in batches:
            for r in range(batch.num_rows):
                shard, first, docs, lens, data = (batch.column(k)[r] for k in range(5))
                ids = np.concatenate([*rans.decode(blocks_of(data.as_py()), coder), np.empty(0, np.uint32)]).astype("<u4")
                n = lens.values.to_numpy()
                ends = np.cumsum([0, *n])
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
                cols = [docs.values, pa.array(ends[:-1] + (base[shard.as_py()] + first.as_py()), pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return segments.select("shard", "first", "docs", "lens", "data").mapInArrow(run, schema)
