"""Embedding near-duplicates by collision-counting projections.

Vectors of one label link when their cosine is at least ``cosine``. Each unit
vector is projected on many random lines. Tables of ``per_table`` lines cut into
cells deal the vectors out, so that a task sees those that may be near; there,
every one of ``lines`` other projections is sorted, each vector opens a window
of ``half_width`` around its own value, and the vectors in it collide with it.
Pairs that collide on at least the calibrated number of lines are verified by
their cosine in double precision. The number is the largest that a pair exactly
at the threshold reaches with probability ``recall``, from the binomial law of
its collisions; the tables' number keeps the chance to meet at ``recall`` too.

A pair that meets in several tables counts in the first. A task returns a
number of links for each vector and a spanning forest, never the pairs. Equal
vectors are grouped first; a cell with more than ``tile`` vectors is dealt out
again as pairs of tiles, so no task gathers it.

Cases: a null label, and a vector that is null, empty, zero or holds a null or
non-finite component, links with nothing and is its own component; vectors of
different lengths don't link; null ids are kept and name a component only if it
has no other (kept is then null); repeated rows are different vectors and link;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .components import connected_components

LINES, WIDTH, SEED = 64, 1.5, 20240


def lines_per_table(vectors: int) -> int:
    """Six lines of a table, and one more for each doubling beyond 65,536 vectors: a line halves
    the cells, so their size stays while the vectors multiply."""
    return 6 + max(0, math.ceil(math.log2(max(1, vectors) / 65536)))


def _same_cell(d: float, width: float) -> float:
    """The probability that values of distance N(0, d^2) share a cell of ``width`` at a random offset."""
    t = width / d
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def calibrate(cosine: float, recall: float = 0.995, half_width: float = 0.75, per_table: int = 6) -> tuple[int, int]:
    """(tables, least number of collisions) for pairs at the threshold."""
    d = math.sqrt(2 - 2 * cosine)
    meet = _same_cell(d, WIDTH) ** per_table
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    p = math.erf(half_width / d / math.sqrt(2))
    tail, least = 0.0, LINES
    while True:
        tail += math.comb(LINES, least) * p**least * (1 - p) ** (LINES - least)
        if tail >= 1 - (1 - recall) / 5 or not least:
            return tables, least
        least -= 1


@lru_cache(maxsize=16)
def _directions(dim: int, tables: int, per_table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    cells = rng.standard_normal((dim, tables * per_table))
    return cells, rng.uniform(0, WIDTH, tables * per_table), rng.standard_normal((dim, LINES))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _cells(unit: np.ndarray, tables: int, per_table: int) -> np.ndarray:
    """A 64-bit key of each vector's cells in each table."""
    lines, offset, _ = _directions(unit.shape[1], tables, per_table)
    cell = np.floor((unit @ lines + offset) / WIDTH).astype(np.int64).reshape(len(unit), tables, per_table)
    key = np.full(cell.shape[:2], unit.shape[1], np.uint64)
    for k in range(per_table):
        key = (key ^ cell[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _deal(tables: int, per_table: int, with_vectors: bool):
    """(uid, label, n, vec) to (label, t, key[, uid, n, vec]), vec as the bytes of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size).tolist():
                for on in np.array_split(np.flatnonzero(size == dim), max(1, int((size == dim).sum()) // 1024)):
                    rows = np.stack([flat[ends[k] : ends[k] + dim] for k in on.tolist()])
                    keys = _cells(_unit(rows.astype(np.float64)), tables, per_table)
                    label = batch.column(1).to_numpy()[on]
                    cols = [np.repeat(label, tables), np.tile(np.arange(tables, dtype=np.int32), len(on)), keys.ravel()]
                    out, names = [pa.array(c) for c in cols], ["label", "t", "key", "uid", "n", "vec"]
                    if with_vectors:
                        out += [pa.array(np.repeat(batch.column(0).to_numpy()[on], tables)), pa.array(np.repeat(batch.column(2).to_numpy()[on], tables))]
                        raw = [r.tobytes() for r in rows]
                        out.append(pa.array([r for r in raw for _ in range(tables)], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names[: len(out)])

    return run


def _collisions(value: np.ndarray, half_width: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, collisions of each query of a strip with each vector), strip by strip.

    Each line is sorted once, and a query's window on it is a range of ranks. The lines stand one
    after the other in one array, so a single search finds the windows of all of them.
    """
    n, lines = value.shape
    order = np.argsort(value, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    far = 4 * (np.abs(value).max() + half_width) * np.arange(lines)
    ranked = (np.take_along_axis(value, order, axis=0) + far).T.ravel()
    first = n * np.arange(lines)
    rank = rank.astype(np.int32)
    for at in range(0, n, 256):  # strips bound the counts kept
        own = value[at : at + 256] + far
        lo = (np.searchsorted(ranked, own - half_width, "left") - first).astype(np.int32)
        hi = (np.searchsorted(ranked, own + half_width, "right") - first).astype(np.int32)
        count = np.zeros((len(own), n), np.uint8)
        for j in range(0, lines, 8 if n <= 64 else 1):
            own_lines = slice(j, j + (8 if n <= 64 else 1))
            inside = (rank[None, :, own_lines] >= lo[:, None, own_lines]) & (rank[None, :, own_lines] < hi[:, None, own_lines])
            count += inside.sum(2, dtype=np.uint8)
        yield at, count


def _group_links(t: int, tiles: tuple[int, int], uid: np.ndarray, n: np.ndarray, tile_of: np.ndarray, rows: np.ndarray, cosine: float, tables: int, per_table: int, least: int, half_width: float):
    """(links of each vector, edges of a spanning forest) within one cell or pair of tiles."""
    unit = _unit(rows.astype(np.float64))
    links, parent, edges, keys = np.zeros(len(uid), np.int64), np.arange(len(uid)), [], None

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, count in _collisions(unit @ _directions(rows.shape[1], tables, per_table)[2], half_width):
        x, y = np.nonzero(count >= least)
        x = x + at
        ok = uid[x] < uid[y]
        if tiles[0] != tiles[1]:
            ok &= tile_of[x] != tile_of[y]
        x, y = x[ok], y[ok]
        ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        keys = _cells(unit, tables, per_table) if keys is None else keys
        first = (keys[x] == keys[y]).argmax(1) == t  # counted in the first table where the two meet
        x, y = x[first], y[first]
        np.add.at(links, x, n[y])
        np.add.at(links, y, n[x])
        for a, b in zip(x.tolist(), y.tolist()):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((a, b))
    return links, edges


def _count(dtype: str, cosine: float, tables: int, per_table: int, least: int, half_width: float):
    """Sorted (label, t, key, i, j, uid, n, tile, vec) to (a, b, n): links of a (b null) and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        out: list[tuple] = []

        def close():
            if len(held) > 1:
                uid, n, tile_of = (np.array([h[k] for h in held], np.int64) for k in range(3))
                rows = np.stack([np.frombuffer(h[3], dtype) for h in held])
                links, edges = _group_links(now[1], now[3:5], uid, n, tile_of, rows, cosine, tables, per_table, least, half_width)
                out.extend((int(uid[k]), None, int(links[k])) for k in np.flatnonzero(links))
                out.extend((int(uid[a]), int(uid[b]), 0) for a, b in edges)
            held.clear()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["a", "b", "n"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if row[:5] != now:
                    close()
                    now = row[:5]
                held.append(row[5:])
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def vector_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, recall: float = 0.995, half_width: float = 0.75, tile: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``."""
    # single precision travels as it is; all else as doubles
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    kind = "array<float>" if single else "array<double>"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast(kind).alias("vec"))
    valid = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    # equal vectors have equal hashes of 128 bits, by which they are grouped and found again
    src = src.withColumn("ok", valid).withColumns({"h1": F.xxhash64("vec", F.lit(1)), "h2": F.xxhash64(F.lit(2), "vec")})
    same = ["label", "h1", "h2"]
    groups = src.filter("ok").groupBy(*same).agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    groups = stash(groups.withColumn("uid", F.monotonically_increasing_id()), "vector-groups")
    per_table = lines_per_table(groups.count())
    tables, least = calibrate(cosine, recall, half_width, per_table)
    given = groups.select("uid", "label", "n", "vec")
    cell = ["label", "t", "key"]
    big = given.mapInArrow(_deal(tables, per_table, False), "label long, t int, key long").groupBy(*cell).agg(F.count("*").alias("size")).filter(F.col("size") > tile)
    big = stash(big.select(*cell, F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "big-cells")
    dealt = given.mapInArrow(_deal(tables, per_table, True), "label long, t int, key long, uid long, n long, vec binary").join(big, cell, "left")
    dealt = dealt.withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*cell, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "uid", "n", "tile", "vec")
    order = [*cell, "i", "j"]
    found = stash(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(_count("<f4" if single else "<f8", cosine, tables, per_table, least, half_width), "a long, b long, n long"), "vector-links")
    links = stash(found.groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("links")), "vector-degrees")
    parts = stash(connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "uid"), "vector-parts")
    small = groups.select("uid", *same, "n", "first")
    least_id = stash(parts.join(small.select("uid", "first"), "uid").groupBy("component").agg(F.min("first").alias("least")), "vector-least")
    named = stash(parts.join(least_id, "component").select("uid", "least"), "vector-named")
    table = small.join(links, "uid", "left").join(named, "uid", "left")
    table = stash(table.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce(F.least("least", "first"), "least", "first").alias("component_id")), "vector-table")
    joined = src.drop("vec").join(table.withColumn("ok", F.lit(True)), ["ok", *same], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
