"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from floatweave.queries import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "chunk_sizes_events_value", "chunk_sizes_o_totalprice", "chunk_sizes_l_extendedprice", "compression_ratio_by_column", "chunk_offsets", "plane_sparsity",
    "ablation_dense", "decimal_places_histogram", "delta_zigzag", "running_sum_restore", "roundtrip_planes", "roundtrip_alp", "roundtrip_grid", "roundtrip_zstd",
    "rle_runs", "for_bitwidth", "grid_sizes", "alp_best_pairs", "alp_exceptions", "column_profile", "digit_statistics", "column_similarity", "cleaned_columns",
    "exists_value", "exists_packed", "all_columns_equal", "significant_figures", "number_tokens",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, times = queries(), {}
    every["chunk_sizes_s_acctbal"](spark, SF_DIR).count()  # the session's own start
    for name in HEADLINE:
        began = time.time()
        every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
