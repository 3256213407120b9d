"""SimHash near-duplicates by Golay-code fuzzy hashing.

Words are what white space of ASCII parts, letters A-Z lowered; a fingerprint
bit is 1 if it is set in over half of the hashes of the text's shingles. Two
fingerprints link when at most four of their 64 bits differ.

Candidates: a fingerprint is cut into three segments, padded to Golay words. Of
four differing bits, either two segments hold at most one each, or one segment
holds none and the others two each. In the first case the pair meets under a
pair of codeword indices, where for one segment one side gives its nearest
codeword and the other all its keys; in the second it meets under the exact
segment and a codeword index of the next. So every link is a candidate.

Only distinct fingerprints are dealt out. Within a key the task walks the graph
of links and emits a spanning forest, at most a row for each member, not the
pairs. A key with more than ``hot`` members is not gathered: its members take
an exact way of their own, meeting under every word that differs from them in
at most two bits, as two fingerprints do exactly if they differ in at most four.

Cases: texts of fewer words than a shingle hash whole; null, empty and wordless
texts have fingerprint zero and link like any other; null ids are kept, and
name a component only if it has no other; repeated rows each get their row;
extra columns are ignored; a very long text has all its shingles hashed; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import discard, free_name, marked_keys, may_hold, row_key, settle, stash, stash_at
from .components import connected_components

BITS, LIMIT = 64, 4
_CUTS = ((0, 22), (22, 21), (43, 21))  # first bit and length of each segment


def hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(flat, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -width] + 1]).tolist()
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """The bits set in over half of ``h``, as a signed 64-bit integer."""
    if not len(h):
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 200):  # sums of up to 200 bits fit a byte
        part = np.unpackbits(h[at : at + 200].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                fp = [fingerprint(hashes(t, width)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (key, fp), without repetition."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = whole.column(0).slice(at, 4096).to_numpy()
            seg = [(fp.view(np.uint64) >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in _CUTS]
            codes = [golay.keys(s) for s in seg]
            rows, keys = [], []
            every = np.arange(len(fp))
            for i, j in ((0, 1), (0, 2), (1, 2)):
                (ci, ni), (cj, nj) = codes[i], codes[j]
                table = (i + j) << 60
                for k in range(6):
                    on = every[nj > k]  # nearest of i with every key of j
                    rows.append(on)
                    keys.append(table | ci[on, 0] << 12 | cj[on, k])
                    if k:  # every key of i with the nearest of j
                        on = every[ni > k]
                        rows.append(on)
                        keys.append(table | ci[on, k] << 12 | cj[on, 0])
            for i in range(3):
                c, n = codes[(i + 1) % 3]
                for k in range(6):
                    on = every[n > k]
                    rows.append(on)
                    keys.append((4 + i) << 60 | seg[i][on] << 12 | c[on, k])
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[r])], ["key", "fp"])


def _walk(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fp`` (distinct)."""
    out, rest = [], fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= limit
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _links(limit: int, hot: int, all_linked: bool = False):
    """Sorted (key, fp) to edges (a, b), or (a, null) for each member of a key with over ``hot`` members.

    all_linked: members of a key link without a look at their bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the members so far of the key that a batch ended with
        held_key, held_n, is_hot = None, 0, False
        edges_a: list[np.ndarray] = []
        edges_b: list[np.ndarray] = []

        def pairs(x, y):
            edges_a.append(np.asarray(x, np.int64))
            edges_b.append(np.asarray(y, np.int64))

        def close():
            nonlocal held, held_key, held_n, is_hot
            if held and held_n > 1 and not is_hot:
                fp = np.unique(np.concatenate(held))
                if all_linked:
                    pairs(fp[1:], fp[:-1])
                elif len(fp) > 1 and (found := _walk(fp.view(np.uint64), limit)):
                    e = np.array(found, np.uint64).view(np.int64)
                    pairs(e[:, 0], e[:, 1])
            held, held_key, held_n, is_hot = [], None, 0, False

        def out(a, b, null):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=null) if len(b) else pa.array([], pa.int64())], ["a", "b"])

        lone: list[np.ndarray] = []

        def add(key, fp):
            nonlocal held_key, held_n, is_hot
            if key != held_key:
                close()
                held_key = key
            held.append(fp)
            held_n += len(fp)
            if not all_linked and held_n > hot:
                is_hot = True
                lone.extend(held)
                held.clear()
            elif all_linked:  # one member stands for those before it
                whole = np.concatenate(held)
                pairs(whole[1:], whole[:-1])
                held[:] = [whole[-1:]]

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            size = np.diff(cuts)
            # keys of two members that begin and end within the batch, all at once
            two = np.flatnonzero(size == 2)
            two = two[(two > 0) & (two < len(size) - 1)]
            if len(two):
                x, y = fp[cuts[two]], fp[cuts[two] + 1]
                ok = (np.bitwise_count((x ^ y).view(np.uint64)) <= limit) & (x != y) if not all_linked else x != y
                pairs(x[ok], y[ok])
            for k in sorted({0, len(size) - 1, *np.flatnonzero(size > 2).tolist()}):
                add(int(key[cuts[k]]), fp[cuts[k] : cuts[k + 1]])
            if edges_a or lone:
                a = np.concatenate([*edges_a, *lone])
                b = np.concatenate([*edges_b, *lone])
                null = np.arange(len(a)) >= sum(map(len, edges_a))
                edges_a.clear(), edges_b.clear(), lone.clear()
                yield out(a, b, null)
        close()
        if edges_a or lone:
            a = np.concatenate([*edges_a, *lone])
            b = np.concatenate([*edges_b, *lone])
            yield out(a, b, np.arange(len(a)) >= sum(map(len, edges_a)))

    return run


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (key, fp): every word that differs in at most two bits."""
    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    i, j = np.triu_indices(BITS, 1)
    flips = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            fp = whole.column(0).slice(at, 64).to_numpy()
            key = fp.view(np.uint64)[:, None] ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(fp, len(flips)))], ["key", "fp"])


def fingerprint_links(fps: DataFrame, hot: int = 4096) -> DataFrame:
    """Edges (a, b) among the distinct longs of ``fps``'s column fp, whose components are
    those of all pairs that differ in at most four bits."""

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key")

    found = stash(dealt(fps.select("fp").mapInArrow(_keys, "key long, fp long")).mapInArrow(_links(LIMIT, hot), "a long, b long"), "links")
    lone = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    near = dealt(lone.mapInArrow(_near_words, "key long, fp long")).mapInArrow(_links(LIMIT, hot, True), "a long, b long")
    return found.filter("b is not null").unionByName(near)


def simhash_components(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", hot: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``: the component's smallest id."""
    table = stash(fingerprints(docs, width, id_col, text_col), "fingerprints")
    first = stash(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    parts = stash(connected_components(fingerprint_links(first, hot)).withColumnRenamed("node", "fp"), "parts")
    least = stash(parts.join(first, "fp").groupBy("component").agg(F.min("first").alias("least")), "least")
    joined = stash(parts.join(least, "component").select("fp", "least"), "joined")
    named = stash(first.join(joined, "fp", "left").select("fp", F.least("least", "first").alias("component_id")), "named")
    return table.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# --- documents of similar shingle sets -------------------------------------------------
#
# For sets of shingles with a Jaccard index of 0.8 some 15 % of SimHash bits differ, far
# more than the pigeonhole above allows. So the bits are doubled (the second half from a
# mix of the same hashes), each half is cut into three segments as before, and every key
# of every segment is used on both sides: of six segments, one holds two errors or fewer,
# or shares a codeword by luck, in 99 of 100 such pairs. What meets is compared over all
# 128 bits, and whatever is near enough is verified by the exact Jaccard index: first a spanning
# forest of each key, then, where edges of it failed, every pair between the pieces.

WIDE_LIMIT = 35  # of 128 bits: at an index of 0.8 the mean is 19.4, the standard deviation 4.1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _wide_prints(width: int):
    """(doc_id, k1, k2, text) to (doc_id, k1, k2, f0, f1, s0, s1, n): the print's halves, those of the shingle set's digest, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                prints = []
                for t in batch.column(3).to_pylist():
                    h = np.unique(hashes(t, width))  # similarity is that of sets, so a repeated shingle votes once
                    digest = np.frombuffer(xxhash.xxh128_digest(h.tobytes()), np.int64)
                    prints.append((fingerprint(h), fingerprint(_mix(h)) if len(h) else 0, *digest.tolist(), len(h)))
                f = [pa.array([p[k] for p in prints], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *f], ["doc_id", "k1", "k2", "f0", "f1", "s0", "s1", "n"])

    return run


def wide_keys(f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys): every key of every segment of the prints (f0, f1)."""
    rows, keys = [], []
    for half, f in enumerate((f0, f1)):
        for i, (start, n) in enumerate(_CUTS):
            code, count = golay.keys((f.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << n) - 1))
            for k in range(6):
                on = np.flatnonzero(count > k)
                rows.append(on)
                keys.append((half * 3 + i) << 12 | code[on, k])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int64)


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, f0, f1, n) to (key, uid, f0, f1, n)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            cols = [whole.column(k).slice(at, 2048).to_numpy() for k in range(4)]
            rows, keys = wide_keys(cols[1], cols[2])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c[rows]) for c in cols)], ["key", "uid", "f0", "f1", "n"])


def _distance(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Differing bits of prints of two words each."""
    return np.bitwise_count(f[..., 0] ^ g[..., 0]).astype(np.uint8) + np.bitwise_count(f[..., 1] ^ g[..., 1])


def _nearest_tree(f: np.ndarray, size: np.ndarray, limit: int, similarity: float) -> list[tuple[int, int, int]]:
    """(a, b, first of the tree) of a minimum spanning forest of the pairs within ``limit`` whose sizes admit ``similarity``."""

    def far(k, rows):
        fits = np.minimum(size[k], size[rows]) >= similarity * np.maximum(size[k], size[rows])
        return np.where(fits, _distance(f[k], f[rows]), 255)

    out = []
    rest = np.arange(len(f))
    while len(rest) > 1:
        at, rest = rest[0], rest[1:]
        first = int(at)
        best, via = far(at, rest), np.full(len(rest), at)
        while len(rest):
            k = int(best.argmin())
            if best[k] > limit:
                break
            at = rest[k]
            out.append((int(via[k]), int(at), first))
            left = np.arange(len(rest)) != k
            rest, best, via = rest[left], best[left], via[left]
            d = far(at, rest)
            nearer = d < best
            best, via = np.where(nearer, d, best), np.where(nearer, at, via)
    return out


def _wide_links(limit: int, similarity: float, strip: int = 512):
    """Sorted (key, i, j, uid, f0, f1, n) to (cluster, a, b): a spanning forest of the near pairs of each (key, i, j).
    cluster stands for the members of a tree, and is null where they are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: list[tuple] = []
        now = None

        def close():
            uid, size = (np.concatenate([h[k] for h in held]) for k in (0, 3))
            f = np.stack([np.concatenate([h[k] for h in held]).view(np.uint64) for k in (1, 2)], 1)
            held.clear()
            order = np.lexsort((uid, size))  # equal members make equal trees
            uid, f, size = uid[order], f[order], size[order]
            near = np.zeros(len(uid), bool)
            for at in range(0, len(uid), strip):
                own = f[at : at + strip]
                # sets of a similarity have sizes of that ratio at least
                end = int(np.searchsorted(size, size[min(at + strip, len(size)) - 1] / similarity, "right"))
                for to in range(at, end, 8 * strip):  # a bounded part of the pairs at a time
                    upto = min(end, to + 8 * strip)
                    x, y = np.nonzero(_distance(own[:, None], f[None, to:upto]) <= limit)
                    x, y = x + at, y + to
                    off = (x != y) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]))
                    near[x[off]] = near[y[off]] = True
            some = np.flatnonzero(near)
            edges = _nearest_tree(f[some], size[some], limit, similarity) if len(some) else []
            trees: dict[int, list[int]] = {}
            for e in edges:
                trees.setdefault(e[2], [e[2]]).append(e[1])
            name = {t: int(np.array(xxhash.xxh64_intdigest(np.sort(uid[some[m]]).tobytes()), np.uint64).view(np.int64)) if len(m) > 2 else None for t, m in trees.items()}
            cols = [[name[e[2]] for e in edges], [int(uid[some[e[0]]]) for e in edges], [int(uid[some[e[1]]]) for e in edges]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cluster", "a", "b"])

        for batch in batches:
            key, i, j, uid, f0, f1, n = (c.to_numpy() for c in batch.columns)
            new = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(key)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (own := (key[a], i[a], j[a])) != now and held:
                    yield close()
                now = own
                held.append((uid[a:b], f0[a:b], f1[a:b], n[a:b]))
        if held:
            yield close()

    return run


def _tiled(keyed: DataFrame, tile: int) -> DataFrame:
    """``keyed`` with (i, j): a key of over ``tile`` members is dealt into tiles of its own, and every
    two tiles meet, so no task gathers it. The hot keys are among 24,576, which bounds their broadcast."""
    hot = keyed.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > tile)
    hot = stash(hot.select("key", F.ceil(F.col("members") / tile).cast("int").alias("tiles")), "wide-hot")
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "uid", "f0", "f1", "n")


def _same_sets(similarity: float):
    """(a, b, x, y), texts' hash sets as bytes, to (a, b) of those with a Jaccard index of ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint32) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], ["a", "b"])

    return run


def _hash_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.unique((hashes(t, width) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["uid", "hashes"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key (first column) of sorted rows."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if key[a] != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _words_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The parts and the prints (two words each) of rows with part, f0 and f1."""
    return rows["part"].to_numpy(), np.stack([rows[c].to_numpy().view(np.uint64) for c in ("f0", "f1")], 1)


def _apart(limit: int):
    """Sorted (key, uid, part, f0, f1) to those rows that have one of another part within ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            part, f = _words_of(rows)
            if (part == part[0]).all():
                continue
            near = [bool((((np.bitwise_count(f[:, 0] ^ f[k, 0]) + np.bitwise_count(f[:, 1] ^ f[k, 1])) <= limit) & (part != part[k])).any()) for k in range(len(f))]
            yield from rows.filter(pa.array(near)).to_batches()

    return run


def _joined(limit: int, similarity: float):
    """Sorted (key, uid, part, f0, f1, hashes) to edges (a, b) that join parts: every two rows
    within ``limit`` and of different parts are verified, or joined by others that were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            part, f = _words_of(rows)
            part, uid = part.copy(), rows["uid"].to_numpy()
            sets = [np.frombuffer(h.as_buffer(), np.uint32) for h in rows["hashes"]]
            size = np.array([len(x) for x in sets])
            edges = []
            for k, x in enumerate(sets):
                to = np.flatnonzero((np.bitwise_count(f[k + 1 :, 0] ^ f[k, 0]) + np.bitwise_count(f[k + 1 :, 1] ^ f[k, 1]) <= limit) & (part[k + 1 :] != part[k])) + k + 1
                for at in range(0, len(to), 256):
                    own = to[at : at + 256]
                    flat, ends = np.concatenate([sets[j] for j in own]), np.concatenate([[0], np.cumsum(size[own])])
                    hits = np.concatenate([[0], np.cumsum(np.isin(flat, x))])
                    both = hits[ends[1:]] - hits[ends[:-1]]
                    for j in own[both >= similarity * (len(x) + size[own] - both)]:
                        if part[j] != part[k]:
                            edges.append((int(uid[k]), int(uid[j])))
                            part[part == part[j]] = part[k]
            yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in edges], pa.int64()) for c in (0, 1)], ["a", "b"])

    return run


def _edges_between(links: DataFrame, groups: DataFrame, parts: DataFrame, sets: DataFrame, similarity: float, tile: int = 1024) -> DataFrame:
    """Edges between ``parts``, the components of the verified edges of ``links``.

    A tree that lost an edge to the verification may have other pairs within the limit between
    the pieces. Of each such cluster the members that have one are gathered with their sets;
    those of over ``tile`` members are dealt into tiles, and every two tiles meet. A member is of
    as many clusters as its keys, so prints and sets are joined to it once, with the list of them."""
    ends = links.filter("cluster is not null")
    for c in ("a", "b"):
        ends = ends.join(parts.select(F.col("uid").alias(c), F.col("component").alias(f"{c}_part")), c, "left")
    cut = stash(ends.filter("coalesce(a_part, a) <> coalesce(b_part, b)").select("cluster").distinct(), "wide-cut")
    members = stash(links.join(cut, "cluster").select("cluster", F.explode(F.array("a", "b")).alias("uid")).distinct(), "wide-members")
    tiles = members.groupBy("cluster").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.xxhash64("cluster", F.least(own, other), F.greatest(own, other)))
    keyed = members.join(tiles, "cluster").groupBy("uid").agg(F.flatten(F.collect_list(meets)).alias("keys"))
    dealt = keyed.join(groups.select("uid", "f0", "f1"), "uid").join(parts, "uid", "left")
    dealt = dealt.select(F.explode("keys").alias("key"), "uid", F.coalesce("component", "uid").alias("part"), "f0", "f1")
    schema = "key long, uid long, part long, f0 long, f1 long"
    near = stash(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_apart(WIDE_LIMIT), schema), "wide-apart")
    asked = near.groupBy("uid", "part", "f0", "f1").agg(F.collect_list("key").alias("keys"))
    return asked.join(sets, "uid").select(F.explode("keys").alias("key"), "uid", "part", "f0", "f1", "hashes").repartition("key").sortWithinPartitions("key").mapInArrow(_joined(WIDE_LIMIT, similarity), "a long, b long")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = 8192) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each connected group of texts whose
    shingle sets have a Jaccard index of at least ``similarity`` (0.8 or more), the row with
    the smallest id stays (a null id is the smallest; then by a hash of the row).

    Texts move only where they must: those of candidate pairs, to be verified, and the rows of
    groups with more than one, to be thinned. A bounded bitmap of keys tells all other rows,
    which stay without a shuffle.

    Cases: null, empty and wordless texts have the empty set and are copies of each other;
    texts of fewer words than ``width`` are compared whole; null ids are kept like others; of
    equal rows one stays; a very long text has all its shingles hashed; extra columns are
    carried, whatever their names; an empty table gives an empty one."""
    if similarity < 0.8:
        raise ValueError("the candidates are calibrated for 0.8 and more")
    spark = docs.sparkSession
    names, flag = [free_name(docs, n) for n in ("row_k1", "row_k2")], free_name(docs, "row_marked")
    marked = docs.withColumns(dict(zip(names, row_key(docs, id_col, text_col))))
    src = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(names[0]).alias("k1"), F.col(names[1]).alias("k2"), F.col(text_col).alias("text"))
    schema = "doc_id long, k1 long, k2 long, f0 long, f1 long, s0 long, s1 long, n long"
    prints = stash(src.mapInArrow(_wide_prints(width), schema), "wide-prints")
    # equal sets of shingles make one group
    groups = prints.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "k1", "k2", "f0", "f1", "n")).alias("rep"), F.count("*").alias("copies"))
    groups = groups.select("s0", F.struct("rep.doc_id", "rep.k1", "rep.k2").alias("rep"), "rep.f0", "rep.f1", "rep.n", "copies")
    groups = stash(groups.withColumn("uid", F.monotonically_increasing_id()), "wide-groups")
    keyed = groups.select("uid", "f0", "f1", "n").mapInArrow(_wide_keys, "key long, uid long, f0 long, f1 long, n long")
    order = ["key", "i", "j"]
    dealt = _tiled(keyed, tile).repartition(*order).sortWithinPartitions(*order).mapInArrow(_wide_links(WIDE_LIMIT, similarity), "cluster long, a long, b long")
    links = stash(dealt.select("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "wide-links")
    found = links.select("a", "b").distinct()
    asked = found.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    reps = stash(groups.join(asked, "uid").select("uid", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")), "wide-asked")
    texts = may_hold(src, "k1", *marked_keys(reps, "k1")).filter("marked").select("k1", "k2", "text")
    texts = texts.dropDuplicates(["k1", "k2"]).join(reps, ["k1", "k2"]).select("uid", "text")
    sets, sets_path = stash_at(texts.mapInArrow(_hash_sets(width), "uid long, hashes binary"), "wide-sets")
    pairs = found.join(sets.select(F.col("uid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("uid").alias("b"), F.col("hashes").alias("y")), "b")
    same = pairs.select("a", "b", "x", "y").mapInArrow(_same_sets(similarity), "a long, b long")
    edges = stash(same, "wide-edges")
    # the moved texts have served
    del texts, pairs, same, dealt, keyed
    settle(spark)
    parts = stash(connected_components(edges).withColumnRenamed("node", "uid"), "wide-parts")
    more = stash(_edges_between(links, groups, parts, sets, similarity), "wide-more")
    del sets
    discard(spark, sets_path)
    if not more.isEmpty():
        edges = parts.select(F.col("uid").alias("a"), F.col("component").alias("b")).unionByName(more)
        parts = stash(connected_components(edges).withColumnRenamed("node", "uid"), "wide-joined")
    settle(spark)
    best = stash(groups.join(parts, "uid").groupBy("component").agg(F.min("rep").alias("best")), "wide-best")
    placed = groups.join(parts, "uid", "left").join(best, "component", "left")
    placed = placed.select("s0", "rep", (F.col("best").isNotNull() | (F.col("copies") > 1)).alias("several"), (F.col("best").isNull() | (F.col("rep") == F.col("best"))).alias("stays"))
    several = stash(placed.filter("several").select("s0", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), "stays"), "wide-several")
    # rows of a group with more than one, and few others: of these the best of each group stay
    rows = may_hold(prints.select("s0", "s1", "k1"), "s0", *marked_keys(several, "s0")).filter("marked")
    bitmap, slots = marked_keys(rows, "k1")
    checked = may_hold(marked, names[0], bitmap, slots, flag)
    kept = may_hold(groups.select(F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2")), "k1", bitmap, slots).filter("marked").drop("marked")
    kept = kept.join(several.filter("not stays").select("k1", "k2"), ["k1", "k2"], "left_anti").select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    thinned = checked.filter(F.col(flag)).dropDuplicates(names).join(kept, names, "left_semi")
    return checked.filter(~F.col(flag)).unionByName(thinned).select(*(F.col(f"`{c}`") for c in docs.columns))
