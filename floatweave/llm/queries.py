"""The contract queries: each applies one operator, with production parameters,
to the whole of its table and derives the digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans, span_text

    found = secret_spans(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    counts = token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_round_trip, digests

    return digests(bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_path
    from .token_files import read_tokens, write_tokens

    path = new_path(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def _fold(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels").filter(_fold("doc_id", 3) != 1))
    return toxicity(docs, model).select(
        "doc_id",
        F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import vector_links

    return vector_links(_table(spark, sf_dir, "embeddings"))


#: every pair of a label, and the closure of the links: for tables of test size
OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1), c AS (SELECT x, min(y) AS c FROM r GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id, train

    docs = _table(spark, sf_dir, "documents")
    filters = train(docs.filter(_fold("doc_id", 5) != 0))
    found = language_id(docs, filters)
    return found.withColumn("held_out", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_path
    from .warc import read_warc, resolved, write_warc

    path = new_path(spark, "archives")
    write_warc(_table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS digest FROM pages
), best AS (
  SELECT digest, max(page_id) AS best FROM p WHERE octet_length(body) >= 1000 GROUP BY digest
)
SELECT p.page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN best IS NULL OR p.page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN best IS NULL OR p.page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to
FROM p LEFT JOIN best ON p.digest = best.digest
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_secrets": op2_secrets,
        "op3_token_counts": op3_token_counts,
        "op4_simhash": op4_simhash,
        "op5_bpe": op5_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_vectors": op7_vectors,
        "op8_decontaminate": op8_decontaminate,
        "op9_language_id": op9_language_id,
        "op10_warc": op10_warc,
    }


def oracles() -> dict[str, str]:
    return {"op7_vectors": OP7_SQL, "op10_warc": OP10_SQL}
