"""The corpus pipeline: stages over ``documents``, each written and read again.

1. toxicity: documents scored toxic by a model fitted to ``labels`` go.
2. near_duplicates: one document of each group of near copies stays (shingles of
   five words, Jaccard index of 0.8 and more).
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret in a text is replaced by a mark; no document goes.
5. bpe: texts become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floatweave.llm import bpe, decontaminate, secrets, simhash, toxicity
from floatweave.llm.common import stash
from floatweave.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS), width=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars"))
    spans = F.array_sort(F.concat("base", "added"))
    masked = found.withColumn("text", secrets.redact(F.col("text"), spans))
    return masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(docs.select(*COLUMNS), vocabulary("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The stages hold a trained model, tilings and merges, which SQL does not express; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents`` in turn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage-{name}")
    return docs
