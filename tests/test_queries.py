"""Queries against their SQL at the smallest scale, and plans that must hold at any."""

import os

import duckdb
import pytest

from floatweave.queries import load_series, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
FAST = ["chunk_sizes_events_value", "plane_sparsity", "chunk_offsets", "decimal_places_histogram", "delta_zigzag", "running_sum_restore", "roundtrip_planes", "roundtrip_raw_planes", "roundtrip_float32", "payload_bytes_match", "stream_split", "xor_histogram", "rle_runs", "rle_restore", "for_bitwidth", "grid_sizes", "alp_best_pairs", "column_profile", "digit_statistics", "exists_packed", "cleaned_columns", "flattened_columns", "significant_figures", "round_trip_verification", "chunk_sizes_f32_raw", "chunk_sizes_f32_rounded", "ablation_f32_sparse", "chunk_offsets_f32", "plane_sparsity_f32", "decimal_places_f32", "payload_bytes_f32", "chunk_sizes_raw", "payload_bytes_raw", "chunk_sizes_per_value_beta", "block_index", "bit_functions", "decimal_functions", "roundtrip_pfpc", "roundtrip_alp_chosen", "roundtrip_alp_local", "roundtrip_mpc_f32", "roundtrip_chimp128_f32", "roundtrip_elf_f32", "roundtrip_elf_star_f32", "roundtrip_alp_f32", "roundtrip_alp_rd_f32", "roundtrip_alp_chosen_f32", "roundtrip_spdp", "roundtrip_spdp_f32", "gorilla_size", "chimp_size", "chimp_size_f32", "patas_size"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the standard tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found):
    return sorted([tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in found])


@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    made = duck.execute(oracle_sql()[name])
    own = [c[0] for c in made.description]
    assert sorted(own) == names
    want = [tuple(r[own.index(c)] for c in names) for r in made.fetchall()]
    assert rows(tuple(r) for r in df.select(*names).collect()) == rows(want)


def test_every_oracle_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_one_exchange_serves_a_chunk_query(spark):
    from floatweave.plans.chunks import chunk_sizes

    plan = chunk_sizes(load_series(spark, SF, "events_value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_scans_are_pruned(spark):
    plan = queries()["all_columns_equal"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in plan


def test_sizes_are_those_of_the_codecs(spark):
    from pyspark.sql import functions as F

    from floatweave.operators.compress import compress
    from floatweave.operators.integers import grid_sizes, sub_chunk_sizes

    values = load_series(spark, SF, "l_extendedprice").filter("pos < 4096")
    made = compress(values, "gfc").select(F.octet_length("payload") - 4).first()[0]
    assert sub_chunk_sizes(values).first()["bytes"] == made
    made = compress(values, "grid", block=4096).select(F.octet_length("payload") - 4).first()[0]
    assert grid_sizes(values).first()["bytes"] == made
