"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps, for each slot, one bit for each language; the
AND of an n-gram's slots is the set of all languages that contain it, false
positives aside. A text's n-grams are looked up, the bits of each language are
counted, each count is corrected by its language's false-positive rate, and the
language with the largest corrected share is predicted.

Training uses at most ``max_docs`` labelled documents of each language, those
with the smallest hash of their id (a documented bound; the labels only fit the
filters). An n-gram enters a language's filter if its rate there is at least
``min_share`` of its largest rate over the languages, so that foreign words in
a language's documents don't enter its filter.

Cases: a null or empty text or one with no letter gets ``und`` and score 0; ties
go to the language first in alphabetical order; null labels are not learned from;
a training set without labels predicts ``und`` for every text; null ids are kept;
repeated rows each get their row; all n-grams of a very long text count; more than
64 languages take several masks; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N = 4  # characters of an n-gram
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def ngram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the N-grams of lower-cased texts, where each starts (len + 1 offsets), and which texts have a letter.

    Everything but letters becomes one blank, so words keep their ends.
    """
    lowered = [" " + (t or "").lower() + "   " for t in texts]
    joined = "".join(lowered)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, at = _classes(code)
    code = distinct[at]
    ends = np.cumsum([0, *map(len, lowered)])
    has = np.add.reduceat((code != 32).astype(np.int64), ends[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    keep[ends[:-1]] = True
    code = code[keep].astype(np.uint64)
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    h = np.zeros(len(code), np.uint64)
    m = len(code) - N + 1
    if m > 0:
        for k in range(N):
            h[:m] = h[:m] * np.uint64(0x100000001B3) + code[k : m + k]
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    # an n-gram that reaches into the next text is not one: the last N - 1 places of each text are blanks or ends
    valid = np.ones(len(code), bool)
    for k in range(1, N):
        valid[np.maximum(kept[1:] - k, 0)] = False
    starts = np.concatenate([[0], np.cumsum(valid)])[kept]
    return h[valid], starts, has


def _classes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code point, itself if a letter, else a blank, by way of the few distinct ones."""
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    values = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.uint32)
    place[values] = np.arange(len(values), dtype=np.uint32)
    return np.array([v if chr(v).isalpha() else 32 for v in values.tolist()], np.uint32), place[code]


@dataclass
class Filters:
    """The bit-sliced filter: ``slots[w][i]`` has a bit for each language of the w-th 64."""

    languages: list[str]
    slots: list[np.ndarray]
    slot_bits: int
    false_rate: np.ndarray

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        rest = np.uint64(64 - self.slot_bits)
        a, b = (h >> rest).astype(np.int64), ((h * _MIX[1]) >> rest).astype(np.int64)
        return [s[a] & s[b] for s in self.slots]


def fit(samples: dict[str, list[str]], slot_bits: int = 20, min_share: float = 0.35) -> Filters:
    """Filters from texts by language."""
    languages = sorted(samples)
    grams, rates = [], []
    for lang in languages:
        h = np.concatenate([*(ngram_hashes(samples[lang][i : i + 500])[0] for i in range(0, len(samples[lang]), 500)), np.empty(0, np.uint64)])
        g, n = np.unique(h, return_counts=True)
        grams.append(g)
        rates.append(n / max(1, len(h)))
    every = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]))
    best = np.zeros(len(every))
    for g, r in zip(grams, rates):
        at = np.searchsorted(every, g)
        best[at] = np.maximum(best[at], r)
    dtype = next(d for d, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(languages) <= n or n == 64)
    found = Filters(languages, [np.zeros(1 << slot_bits, dtype) for _ in range(-(-len(languages) // 64))], slot_bits, np.zeros(len(languages)))
    bits = np.uint64(slot_bits)
    for k, (g, r) in enumerate(zip(grams, rates)):
        own = g[r >= min_share * best[np.searchsorted(every, g)]]
        slots, bit = found.slots[k // 64], dtype(1 << k % 64)
        for h in (own, own * _MIX[1]):
            slots[(h >> (np.uint64(64) - bits)).astype(np.int64)] |= bit
        fill = np.count_nonzero(slots & bit) / len(slots)
        found.false_rate[k] = fill**2
    return found


def predict(filters: Filters, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    if not filters.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    h, starts, has = ngram_hashes(texts)
    masks = filters.masks(h)
    n = np.diff(starts)
    share = np.zeros((len(texts), len(filters.languages)))
    for k, rate in enumerate(filters.false_rate):
        mask = masks[k // 64]
        hit = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(k % 64)) & mask.dtype.type(1), dtype=np.int64)])
        count = hit[starts[1:]] - hit[starts[:-1]]
        share[:, k] = np.clip((count - n * rate) / np.maximum(1, n) / (1 - rate), 0, 1)
    best = share.argmax(1)
    score = np.where(has, share[np.arange(len(texts)), best], 0.0)
    return [filters.languages[b] if ok else "und" for b, ok in zip(best, has)], score


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, max_chars: int = 6_000_000) -> Filters:
    """Fit on a bounded sample: of each language the ``max_docs`` documents with the
    smallest hash of id, and of those as many as fit ``max_chars`` characters."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    # two passes whatever the number of languages: one counts, so that of each language some
    # max_docs rows by hash are left to the other, which ranks and hands over that bounded sample
    per = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    samples: dict[str, list[str]] = {lang: [] for lang in sorted(per)}
    if not per:
        return fit(samples)
    room = dict.fromkeys(per, max_chars // len(per))
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 1.5 * max_docs / n) * (1 << 30))) for lang, n in per.items()], "lang string, share long")
    own = src.join(F.broadcast(shares), "lang").withColumn("h", F.xxhash64("id", F.xxhash64("text")))
    own = own.filter((F.pmod("h", F.lit(1 << 30)) <= F.col("share")) & (F.length("text") <= max_chars // len(per)))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= max_docs)
    for r in ranked.select("lang", "text").orderBy("lang", "rank").toLocalIterator():
        if len(r["text"]) <= room[r["lang"]]:
            samples[r["lang"]].append(r["text"])
            room[r["lang"]] -= len(r["text"])
    return fit(samples)


def language_id(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                lang, score = predict(filters, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double")
