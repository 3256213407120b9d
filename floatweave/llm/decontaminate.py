"""Benchmark decontamination by greedy string tiling.

1. A seed is a run of ``min_words`` words, by hash; a shorter item is one seed whole.
   A bounded bitmap of the benchmark's seeds goes to the tasks, and of each document
   only the seeds that it may hold, and the words under them, are kept.
2. Those seeds are joined to the benchmark's: the pairs (document, item) that share one.
3. Each pair is tiled: the longest matches of unmarked words are marked first, by
   running Karp-Rabin with a falling search length, so a passage whose sentences were
   put in another order is covered as well as an intact one. An item leaks where its
   marked words are at least ``coverage`` of it.

Both tables may be of any size: nothing of the benchmark but the bitmap is sent to
every task, and a seed that many documents share is an ordinary skewed join key.

Words are what white space parts, lower-cased, without signs at their ends.
Cases: null and empty texts and items hold nothing; an item of fewer than
``min_words`` words leaks where it occurs whole; null ids are kept; repeated rows of
either table each get their rows; a very long text is searched whole; extra columns
are ignored; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, marked_keys, may_hold, row_key, stash

_EDGE = re.compile(r"^\W+|\W+$")
_BASE, _MASK = 1_000_003, (1 << 61) - 1


def normal(word: str) -> str:
    return _EDGE.sub("", word)


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").lower().split()) if w]


class Words:
    """The 64-bit numbers of words, never 0, in a bounded memory."""

    def __init__(self, limit: int = 400_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").lower().split()
        got = [self.known.get(w) for w in words]
        if None in got:
            if len(self.known) > self.limit:
                self.known.clear()
            for k, v in enumerate(got):
                if v is None:
                    w = normal(words[k])
                    got[k] = self.known[words[k]] = (xxhash.xxh64_intdigest(w) >> 1) + 1 if w else 0  # 0: no word at all
        ids = np.array(got, np.int64)
        return ids[ids != 0]


def seeds_at(ids: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on."""
    m = len(ids) - n + 1
    h = np.full(max(m, 0), n, np.uint64)
    for k in range(n if m > 0 else 0):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[k : m + k].view(np.uint64)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _windows(ids: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of each run of ``s`` unmarked words, the hash rolling along."""
    top = pow(_BASE, s - 1, _MASK)
    h = n = 0
    for k, (x, ok) in enumerate(zip(ids, free)):
        if not ok:
            h = n = 0
            continue
        if n == s:
            h = (h - ids[k - s] * top) % _MASK
            n -= 1
        h = (h * _BASE + x) % _MASK
        n += 1
        if n == s:
            yield h, k - s + 1


def tile(item: list[int], text: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first, none overlapping."""
    free_i, free_t = [True] * len(item), [x != 0 for x in text]
    tiles, s = [], max(min_words, min(len(item), 20))
    while True:
        table: dict[int, list[int]] = {}
        for h, t in _windows(text, free_t, s):
            table.setdefault(h, []).append(t)
        found, longest = [], 0
        for h, p in _windows(item, free_i, s):
            for t in table.get(h, ()):
                if p and t and item[p - 1] == text[t - 1] and free_i[p - 1] and free_t[t - 1]:
                    continue  # the end of a longer match
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and free_i[p + k] and free_t[t + k]:
                    k += 1
                if k >= s:
                    found.append((k, p, t))
                    longest = max(longest, k)
        if longest > 2 * s:  # look for the long ones first
            s = longest
            continue
        for k, p, t in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_i[p : p + k]) and all(free_t[t : t + k]):
                tiles.append((p, t, k))
                free_i[p : p + k] = [False] * k
                free_t[t : t + k] = [False] * k
        # a match that lost its place to a longer one may have a free part of at least s words
        if any(not (all(free_i[p : p + k]) and all(free_t[t : t + k])) and _free_part(free_i, free_t, p, t, k, s) for k, p, t in found):
            continue
        if s == min_words:
            return tiles
        s = max(min_words, s // 2)


def _free_part(free_i: list[bool], free_t: list[bool], p: int, t: int, k: int, s: int) -> bool:
    run = 0
    for d in range(k):
        run = run + 1 if free_i[p + d] and free_t[t + d] else 0
        if run >= s:
            return True
    return False


def _items(min_words: int):
    """(item, item_id, text) to (item, item_id, ids, seeds, n): a row for each item with words; n is the words of a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
        for batch in batches:
            rows = []
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = words(text)
                if n := min(min_words, len(ids)):
                    rows.append((item, item_id, ids, np.unique(seeds_at(ids, n)), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["item", "item_id", "ids", "seeds", "n"])

    return run


def _hits(lengths: list[int], bits: np.ndarray, slots: int, docs_at_once: int = 128):
    """(doc_id, k1, k2, text) to (row, doc_id, k1, k2, words, seeds) of each text with a seed that the
    bitmap may hold: ``words`` are those under its seeds, with a 0 for each gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, made = Words(), TaskContext.get().partitionId() << 40
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
        mask = np.int64(slots - 1)
        for whole in batches:
            rows = []
            for at in range(0, whole.num_rows, docs_at_once):
                batch = whole.slice(at, docs_at_once)
                each = [words(t) for t in batch.column(3).to_pylist()]
                ends = np.cumsum([0, *map(len, each)])
                ids = np.concatenate([*each, np.empty(0, np.int64)])
                near = np.zeros(len(ids) + 1, np.int64)
                found = []
                for n in lengths:
                    h = seeds_at(ids, n)
                    slot = h & mask
                    hit = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                    doc = np.searchsorted(ends, hit, "right") - 1
                    own = hit + n <= ends[doc + 1]  # not into the next text
                    hit, doc = hit[own], doc[own]
                    np.add.at(near, hit, 1)
                    np.add.at(near, hit + n, -1)
                    found.append((doc, h[hit]))
                doc, seed = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                if not len(doc):
                    continue
                under = np.where(np.cumsum(near[:-1]) > 0, ids, 0)
                order = np.argsort(doc, kind="stable")
                doc, seed = doc[order], seed[order]
                cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                keys = [batch.column(k) for k in range(3)]
                for k, part in zip(doc[cuts].tolist(), np.split(seed, cuts[1:])):
                    text = under[ends[k] : ends[k + 1]]
                    edge = np.concatenate([[True], (text[1:] != 0) | (text[:-1] != 0)])
                    rows.append((made, *(c[k].as_py() for c in keys), text[edge], np.unique(part)))
                    made += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["row", "doc_id", "k1", "k2", "words", "seeds"])

    return run


def _tiles(min_words: int, coverage: float):
    """(doc_id, k1, k2, words, item_id, ids) to (doc_id, k1, k2, item_id, coverage, n_tiles, longest) of the items that leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
        for batch in batches:
            rows = []
            for doc_id, k1, k2, words, item_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                tiles = tile(ids, words, min(min_words, len(ids)))
                part = sum(t[2] for t in tiles) / len(ids)
                if part >= coverage:
                    rows.append((doc_id, k1, k2, item_id, part, len(tiles), max(t[2] for t in tiles)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "k1", "k2", "item_id", "coverage", "n_tiles", "longest"])

    return run


def _leaks(src: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, min_words: int, coverage: float) -> DataFrame:
    """(doc_id, k1, k2, item_id, coverage, n_tiles, longest) of ``src`` (doc_id, k1, k2, text)."""
    own = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = stash(own.mapInArrow(_items(min_words), "item long, item_id long, ids array<long>, seeds array<long>, n int"), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect()) or [min_words]  # min_words at most
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    marked, slots = marked_keys(seeds.select("seed"), "seed", per_key=1 << 12)  # a text asks for hundreds
    bits = np.zeros(slots >> 6, np.uint64)
    table = marked.toArrow()  # a row for each 64 slots at most
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    schema = "row long, doc_id long, k1 long, k2 long, words array<long>, seeds array<long>"
    hits = stash(src.mapInArrow(_hits(lengths, bits, slots), schema), "seed-hits")
    pairs = hits.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct()
    met = pairs.join(hits.drop("seeds"), "row").join(items.select("item", "item_id", "ids"), "item")
    out = "doc_id long, k1 long, k2 long, item_id long, coverage double, n_tiles long, longest long"
    return met.select("doc_id", "k1", "k2", "words", "item_id", "ids").mapInArrow(_tiles(min_words, coverage), out)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 5, coverage: float = 0.8) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of each item that leaks into a document."""
    none = F.lit(0).cast("long")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), none.alias("k1"), none.alias("k2"), F.col(text_col).alias("text"))
    return _leaks(src, benchmark, item_col, item_text, min_words, coverage).drop("k1", "k2")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_words: int = 5, coverage: float = 0.8) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns; only rows that may
    be among the others move."""
    names, flag = [free_name(docs, n) for n in ("row_k1", "row_k2")], free_name(docs, "row_marked")
    keyed = docs.withColumns(dict(zip(names, row_key(docs, id_col, text_col))))
    src = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(names[0]).alias("k1"), F.col(names[1]).alias("k2"), F.col(text_col).alias("text"))
    gone = stash(_leaks(src, benchmark, item_col, item_text, min_words, coverage).select("k1", "k2").distinct(), "leaking-rows")
    checked = may_hold(keyed, names[0], *marked_keys(gone, "k1"), flag)
    stay = checked.filter(F.col(flag)).join(gone.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])), names, "left_anti")
    return checked.filter(~F.col(flag)).unionByName(stay).select(*(F.col(f"`{c}`") for c in docs.columns))
