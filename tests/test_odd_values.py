"""Queries against their SQL on values that the standard tables have only at larger sizes."""

import duckdb
import pytest

from floatweave.queries import oracle_sql, queries


def rows(found):
    return sorted([tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in found])


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables in which zeros of both signs stand among two-place decimals."""
    path = tmp_path_factory.mktemp("odd")
    cell = "CASE k % 700 WHEN 13 THEN -0.0::DOUBLE WHEN 14 THEN 0.0::DOUBLE ELSE round((k * 7919 % 100003) / 100 - 90, 2) END"
    con = duckdb.connect()
    for table, columns in {
        "customer": f"k AS c_custkey, {cell} AS c_acctbal",
        "events": f"k AS event_id, abs({cell}) AS value",
        "orders": f"k AS o_orderkey, round(1000 + abs({cell}), 2) AS o_totalprice",
        "lineitem": f"k // 4 AS l_orderkey, CAST(k % 4 AS INTEGER) AS l_linenumber, k % 97 AS l_partkey, k % 11 AS l_suppkey, round(1 + abs({cell}), 2) AS l_extendedprice, CAST(1 + k % 50 AS DOUBLE) AS l_quantity, (k * 7 % 11) / 100 AS l_discount, (k % 9) / 100 AS l_tax",
    }.items():
        con.execute(f"COPY (SELECT {columns} FROM range(2500) t(k)) TO '{path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return str(path), con


def same(spark, odd, name):
    path, con = odd
    df = queries()[name](spark, path)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()[name]})").fetchall()
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(want)


@pytest.mark.parametrize("name", ["bit_functions", "decimal_functions", "chunk_sizes_c_acctbal", "compression_ratio_by_column", "stream_split"])
def test_same_rows_on_zeros(spark, odd, name):
    same(spark, odd, name)


def test_round_away_from_zero(spark):
    from pyspark.sql import functions as F

    from floatweave.functions import decimals

    values = [-0.0, 0.0, -0.04, 0.04, 1.25, -1.25, 3.0, 1e300, float("inf")]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(decimals.round_up(F.col("v"), F.lit(1)).alias("up")).collect()
    assert [repr(r.up) for r in got] == ["-0.0", "0.0", "-0.1", "0.1", "1.3", "-1.3", "3.0", repr(1e300 * 10 / 10), "inf"]


@pytest.mark.parametrize("single", [False, True])
def test_sizes_without_signs_of_zeros(spark, single):
    """The plan's sizes are the codec's bytes without signs of zeros, too; the codecs of the registry keep them."""
    import numpy as np
    from pyspark.sql import functions as F

    from floatweave.codecs import find, registry
    from floatweave.operators.compress import compress
    from floatweave.plans.chunks import chunk_sizes

    name = "planes_f32" if single else "planes"
    v = np.array([0.0, -0.0, 1.5, -2.25] * 300 + [1 / 3, -0.0] * 30)
    values = spark.createDataFrame([("s", k, float(np.float32(x)) if single else float(x)) for k, x in enumerate(v)], "series_id string, pos long, value double")
    want = {r.block_id: r.k for r in compress(values, name + "_unsigned", block=1025).select("block_id", F.octet_length("payload").alias("k")).collect()}
    assert {r.chunk_id: r.bytes for r in chunk_sizes(values, single=single, signed_zeros=False).collect()} == want
    v = v.astype(np.float32 if single else float)
    less, full = find(name + "_unsigned"), registry()[name]
    assert np.array_equal(less.decode(less.encode(v[:1025]), 1025), v[:1025]) and len(less.encode(v[:1025])) < len(full.encode(v[:1025]))
    assert np.array_equal(np.signbit(full.decode(full.encode(v), len(v))), np.signbit(v)) and name + "_unsigned" not in registry()


@pytest.mark.parametrize("name", ["rle_runs", "rle_restore", "cascaded_run_frames", "chunk_sizes_l_discount", "roundtrip_cascaded", "roundtrip_gzip"])
def test_tasks_grow_with_rows(spark, odd, name, monkeypatch):
    """2,500 rows at 250 a task: more tasks than the session's four, and the same rows."""
    from floatweave.sources import series

    monkeypatch.setattr(series, "TASK_ROWS", 250)
    assert queries()[name](spark, odd[0]).rdd.getNumPartitions() >= 10
    same(spark, odd, name)
