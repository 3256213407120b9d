"""Text and CSV sources, splitting, generators, and the streaming form."""

import pytest
from pyspark.sql import functions as F

from floatweave.operators.compress import decompress
from floatweave.sources import synthetic, text
from floatweave.sources.series import with_positions
from floatweave.streaming.ingest import compress_stream


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.csv").write_text('"x", y\n1.5,2\nNaN,3.25\n?,oops\n4,5\n')
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("z\n7\n8.125\n")
    return str(tmp_path)


def test_catalog(spark, folder):
    got = [(r.column_id, r.place, r.name) for r in text.catalog(spark, folder).orderBy("column_id").collect()]
    assert got == [(0, 0, "x"), (1, 1, "y"), (2, 0, "z")]


def test_csv_column(spark, folder):
    got = [(r.pos, r.value) for r in text.csv_column(spark, f"{folder}/a.csv", "x").orderBy("pos").collect()]
    assert got == [(0, 1.5), (1, 4.0)]


def test_csv_flat(spark, folder):
    got = [(r.pos, r.value) for r in text.csv_flat(spark, f"{folder}/a.csv").orderBy("pos").collect()]
    assert got == [(0, 1.5), (1, 4.0), (2, 2.0), (3, 3.25), (4, 5.0)]
    cut = [r.value for r in text.csv_flat(spark, f"{folder}/a.csv", figures=2).orderBy("pos").collect()]
    assert cut == [1.5, 4.0, 2.0, 3.3, 5.0]


def test_split_by_size(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 0.5).alias("v"))
    paths = text.split_by_size(rows, ["id"], ["v"], [0.001, 1.0], str(tmp_path))
    assert [spark.read.option("header", "true").csv(p).count() for p in paths] == [131, 1000]


def test_binary(spark, tmp_path):
    rows = spark.range(100).select("id", F.sqrt("id").alias("v"))
    text.to_binary(rows, "v", ["id"], f"{tmp_path}/out")
    data = spark.read.parquet(f"{tmp_path}/out").first()["data"]
    (tmp_path / "one.f64").write_bytes(bytes(data))
    got = text.from_binary(spark, f"{tmp_path}/one.f64").orderBy("pos").collect()
    assert [r.value for r in got] == [r.v for r in rows.orderBy("id").collect()]


def test_positions_are_dense(spark):
    got = with_positions(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k").orderBy("k").collect()
    assert [r.pos for r in got] == list(range(1000)) and [r.k for r in got] == list(range(1000))


def test_positions_of_nothing(spark):
    assert with_positions(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("kind", synthetic.PATTERNS)
def test_patterns(spark, kind):
    got = synthetic.pattern(spark, kind, 50).agg(F.count("value"), F.count_distinct("pos")).first()
    assert tuple(got) == (50, 50)


def test_stream(spark, tmp_path):
    source = spark.range(250).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), (F.col("id") * 0.25).alias("value"))
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    query = compress_stream(stream, block=100).writeStream.format("memory").queryName("blocks").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    packed = spark.table("blocks")
    assert sorted(r.n for r in packed.collect()) == [100, 100]
    assert [r.value for r in decompress(packed, block=100).orderBy("pos").collect()] == [k * 0.25 for k in range(200)]


def test_decimal_edges(spark):
    """The functions beyond the range of decimals, against the plain versions of the codecs."""
    import numpy as np

    from floatweave.codecs.xor import significant, start
    from floatweave.functions import decimals
    from pyspark.sql import functions as F

    values = [1e25, 1.5e-20, -123.456, 0.0, -0.0, 2.5, 0.125, 1e-5, 1e16, 999.9999, 1e300, 0.001, 123456789.125, 1 / 3, float("nan"), float("inf")]
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in values], "v double").select("v", decimals.significant_figures(v, 2).alias("cut"), decimals.exact_start(v).alias("sp"), decimals.significant_count(v).alias("n"), decimals.round_up(v, F.lit(1)).alias("up")).collect()
    for x, r in zip(values, rows):
        if x == 0 or not np.isfinite(x):
            assert r.n is None and repr(r.cut) == repr(x)
            continue
        assert r.cut == (0.13 if x == 0.125 else float(f"{x:.1e}")), x
        if 1e-16 <= abs(x) <= 1e16:
            assert r.sp == start(abs(x)) and r.n == significant(abs(x))[1], x
    assert rows[1].cut == 1.5e-20 and rows[0].cut == 1e25 and rows[2].up == -123.5 and rows[5].up == 2.5


def test_negative_zero_is_an_exception(spark):
    from floatweave.operators.integers import scaled
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "v double").select(scaled(F.col("v"), F.lit(2), F.lit(0))[1].alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, True]


def test_files_in_order(spark, tmp_path):
    from floatweave.sources import text

    for k in range(5):
        (tmp_path / f"f{k}.csv").write_text("a,b\n" + "".join(f"{k}{r},x{r}\n" for r in range(3 + 40 * (k % 2))))
    want = [float(f"{k}{r}") for k in range(5) for r in range(3 + 40 * (k % 2))]
    assert [r.value for r in text.csv_flat(spark, str(tmp_path)).orderBy("pos").collect()] == want
    assert [r.value for r in text.csv_column(spark, str(tmp_path), "a").orderBy("pos").collect()] == want
    assert {(r.cells, r.skipped) for r in text.skipped_cells(spark, str(tmp_path)).collect()} == {(8, 5), (88, 45)}
    flat = text.flatten_rows(spark, str(tmp_path), str(tmp_path / "out"))
    assert [r.floats for r in flat.orderBy("pos").collect()] == want
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert back.columns == ["floats"] and back.count() == len(want)


def test_descriptor_and_binary(spark, tmp_path):
    import numpy as np
    import pytest
    from floatweave.sources import text

    (tmp_path / "data").mkdir()
    np.arange(6, dtype="<f4").tofile(tmp_path / "data" / "a.f32")
    np.arange(24, dtype="<f8").tofile(tmp_path / "data" / "b.f64")
    (tmp_path / "list.csv").write_text("a.f32;float;2 3\nb.f64;double;2 3 4\n")
    got = text.described(spark, str(tmp_path / "list.csv"), str(tmp_path / "data")).collect()
    assert sorted((r.series_id, r.pos, r.value) for r in got) == sorted([("a.f32", k, float(k)) for k in range(6)] + [("b.f64", k, float(k)) for k in range(24)])
    assert {(r.series_id, tuple(r.dims)) for r in got} == {("a.f32", (2, 3)), ("b.f64", (2, 3, 4))}
    (tmp_path / "bad.csv").write_text("a.f32;float;7\n")
    with pytest.raises(Exception, match="holds 6 values"):
        text.described(spark, str(tmp_path / "bad.csv"), str(tmp_path / "data")).collect()
    rows = spark.createDataFrame([(k, f"s{k}") for k in range(5)], "k long, s string")
    text.to_binary(rows, "s", ["k"], str(tmp_path / "strings"), "string")
    assert bytes(spark.read.parquet(str(tmp_path / "strings")).first().data) == b"s0\ns1\ns2\ns3\ns4\n"
    assert text.sizes_between(30, 90, 30) == [30, 60, 90] and text.DEFAULT_SIZES[-1] == 300


def test_functions_of_sql(spark):
    from floatweave.functions.udf import register

    register(spark)
    row = spark.sql("SELECT decode_block(encode_block(array(1.5D, 2.25D), 'planes'), 2, 'planes') AS v, encode_block(cast(null AS array<double>), 'alp') AS n").first()
    assert list(row.v) == [1.5, 2.25] and row.n is None
    blob = spark.sql("SELECT encode_block(array(1.5D, 2.25D, 9D), 'zstd') AS b").first().b
    spark.createDataFrame([(blob,)], "b binary").createOrReplaceTempView("blobs")
    got = spark.sql("SELECT d.pos, d.value FROM blobs, LATERAL decode_blob(b, 3, 'zstd') AS d ORDER BY pos").collect()
    assert [(r.pos, r.value) for r in got] == [(0, 1.5), (1, 2.25), (2, 9.0)]


def test_streams_in_shards_timings_and_sizes(spark):
    from floatweave.operators import compress as packing
    from floatweave.operators.integers import xor_histogram
    from floatweave.sources import synthetic

    values = synthetic.pattern(spark, "linear", 5000)
    packed = packing.compress(values, "planes", block=1025)
    blobs = packing.stream(packed, shard_blocks=2)
    assert blobs.count() == 3
    again = packing.split_stream(blobs, shard_blocks=2).select("block_id", "n", "payload").orderBy("block_id").collect()
    assert again == packed.select("block_id", "n", "payload").orderBy("block_id").collect()
    assert {r.step for r in packing.timings(values, "zstd", runs=1).collect()} == {"compress", "round_trip", "round_trip_over_compress"}
    table = {r.codec: r for r in packing.codec_table(values, ["planes", "gorilla", "mpc_f32"]).collect()}
    assert table["gorilla"].bytes == sum(r.k for r in packing.compress(values, "gorilla").selectExpr("octet_length(payload) AS k").collect()) and table["mpc_f32"].n_values == 5000
    whole = sorted(map(tuple, xor_histogram(values).collect()))
    assert whole == sorted(map(tuple, xor_histogram(values, block=7).collect()))


def test_plan_sizes_of_special_values(spark):
    """The plan's sizes are the codec's bytes, in both widths, over zeros of both signs, NaN, infinities and extremes."""
    import numpy as np
    from floatweave.operators.compress import compress
    from floatweave.plans.chunks import chunk_sizes
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    odd = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1.7976931348623157e308, 2.2250738585072014e-308, 5e-324, 1e-9, 1e300, -1.5]
    parts = [np.array(odd * 100), np.round(rng.uniform(-500, 500, 1025), 2), np.array([0.0, -0.0] * 512 + [1.0]), np.zeros(1025), np.array([1.25, float("inf")] * 20)]
    flat = np.concatenate([np.resize(x, 1025) for x in parts[:-1]] + [parts[-1]])
    for single in (False, True):
        with np.errstate(over="ignore"):
            own = flat.astype(np.float32).astype(np.float64) if single else flat
        values = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(own)], "series_id string, pos long, value double")
        want = {r.block_id: r.k for r in compress(values, "planes_f32" if single else "planes", block=1025).select("block_id", F.octet_length("payload").alias("k")).collect()}
        assert {r.chunk_id: r.bytes for r in chunk_sizes(values, single=single).collect()} == want
