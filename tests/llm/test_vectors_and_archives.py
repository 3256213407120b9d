"""Vectors against brute force; archives against SQL and by hand; the pipeline on a small corpus."""

import duckdb
import numpy as np
import pytest

from floatweave.llm import vectors, warc
from floatweave.llm.common import new_path
from floatweave.llm.queries import OP10_SQL


def brute(rows, cosine=0.93):
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    good = [k for k, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a in good:
        for b in good:
            if a < b and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = (np.array(rows[k][2], np.float32).astype(float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    least = {}
    for k in range(n):
        least[root(k)] = min(least.get(root(k), 1 << 60), rows[k][0])
    return [(rows[k][0], links[k], least[root(k)]) for k in range(n)]


@pytest.mark.parametrize("tile", [1024, 8])
def test_vector_links(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    rows = [(k, int(rng.integers(2)), [float(np.float32(x)) for x in base[rng.integers(6)] + rng.normal(size=16) * rng.choice([0.05, 0.1, 0.15])]) for k in range(90)]
    rows += [(90, None, rows[0][2]), (91, 0, None), (92, 0, [0.0] * 16), (93, 0, [float("nan")] * 16), (94, 0, []), (95, *rows[0][1:]), (96, *rows[0][1:]), (97, 0, [1.0, None]), (98, 0, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<float>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.vector_links(table, tile=tile).collect()}
    want = brute(rows)
    found, true = sum(v[0] for v in got.values()), sum(w[1] for w in want)
    assert len(got) == len(rows) and 0.97 * true <= found <= true
    for i, n, c in want:
        assert got[i][0] <= n
        if i >= 90:
            assert got[i] == (n, c, i == c)
    assert vectors.vector_links(table.limit(0)).count() == 0


def test_vector_links_in_double_precision(spark):
    """Pairs on both sides of the threshold that single precision cannot tell apart."""
    import math

    rows = []
    for k in range(40):
        angle = math.acos(0.93) + (1e-10 if k % 2 else -1e-10)
        rows += [(2 * k, k, [1.0, 0.0, 0.0, 0.0]), (2 * k + 1, k, [math.cos(angle), math.sin(angle), 0.0, 0.0])]
    got = {r.vec_id: r.n_links for r in vectors.vector_links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert all(got[2 * k] == 0 for k in range(1, 40, 2))
    assert sum(got[2 * k] for k in range(0, 40, 2)) >= 19


def test_collisions_are_those_of_windows():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 64, 300):
        value = rng.normal(size=(n, 64))
        want = (np.abs(value[:, None, :] - value[None, :, :]) <= 0.75).sum(2)
        assert np.array_equal(np.concatenate([c for _, c in vectors._collisions(value, 0.75)]), want)


def test_tables_grow_with_the_vectors():
    assert vectors.lines_per_table(1) == vectors.lines_per_table(65536) == 6 and vectors.lines_per_table(10**7) == 14
    assert vectors.calibrate(0.93, per_table=9)[0] > vectors.calibrate(0.93)[0]


def test_calibration_is_monotonous():
    assert vectors.calibrate(0.99)[0] < vectors.calibrate(0.93)[0] < vectors.calibrate(0.85)[0]


def test_chunked_framing():
    body = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(body)) == body == warc.unchunked(warc.chunked(body, 7))
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives(spark):
    rows = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, "u", "ab"), (4, None, None), (5, "u\r\nv", "\r\n\r\n日本" * 30000), (6, "w", "\r\n\r\n日本" * 30000), (7, "a", "ab"), (8, "a", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    path = new_path(spark, "archives")
    warc.write_warc(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"), path)
    read = warc.read_warc(spark, path)
    payloads = {r.page_id: bytes(r.payload) for r in read.collect() if r.record_type == "response"}
    assert payloads == {i: (h or "").encode() for i, _, h in rows if i not in (1, 5)}
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted(tuple(r) for r in warc.resolved(read).select(*names).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({OP10_SQL})").fetchall())


def test_repeated_and_null_pages(spark):
    rows = [(6, "w", "z" * 90000), (6, "w", "z" * 90000), (None, "q", "z" * 90000), (None, "q", "y")]
    path = new_path(spark, "archives")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type) for r in warc.resolved(warc.read_warc(spark, path)).collect())
    assert got == [(0, 1, "response"), (0, 90000, "revisit"), (6, 90000, "response"), (6, 90000, "response")]
    path = new_path(spark, "archives")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_cut_records_are_told():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc\r\n\r\n"))
