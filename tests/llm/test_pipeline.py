"""Every stage of the corpus pipeline on a small corpus, against what was planted in it."""

import random

import pytest

import corpus_pipeline
from floatweave.llm.queries import vocabulary


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n=80: " ".join(rng.choice(words) for _ in range(n))
    leak = text(30)
    rows, labels, planted = [], [], {"toxic": set(), "copies": set(), "leaks": set(), "secrets": set()}
    for k in range(240):
        t, toxic = text(), k % 6 == 0
        if toxic:
            t = t.replace(" ", " vileword ", 3)
            planted["toxic"].add(k)
        labels.append((k, int(toxic)))
        rows.append((k, t))
    for k in range(240, 250):  # copies of clean documents
        rows.append((k, rows[6 * (k - 240) + 1][1] + ("" if k % 2 else " w1")))
        planted["copies"].add(k)
    for k in range(250, 255):
        rows.append((k, f"{text(20)} {leak} {text(20)}"))
        planted["leaks"].add(k)
    for k in range(255, 260):
        rows.append((k, f"{text(30)} api_key = Ab3dE6gH9kLmN0pQ {text(10)}"))
        planted["secrets"].add(k)
    rows.append((260, None))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), planted


def test_stages(spark, corpus, tmp_path):
    path, texts, planted = corpus
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), set(texts)
    gone = {"toxicity": planted["toxic"], "near_duplicates": planted["copies"], "decontamination": planted["leaks"], "secrets": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        left -= gone[name]
        assert {r.doc_id for r in docs.collect()} == left, name
    for r in docs.collect():
        assert ("[SECRET]" in (r.text or "")) == (r.doc_id in planted["secrets"])
        assert r.n_chars == len(r.text or "")
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    from tokenizers import Tokenizer

    tok, kept = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: list(r.ids) for r in final} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in kept.items()}


def test_run(spark, corpus):
    path, texts, planted = corpus
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(texts) - planted["toxic"] - planted["copies"] - planted["leaks"]


def test_empty(spark, corpus, tmp_path):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name
