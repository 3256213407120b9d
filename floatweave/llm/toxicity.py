"""Toxicity: a linear-chain conditional random field over words.

States are clean and toxic; a word's emission is the sum of the weights of its
features (the word and its prefixes), and four weights score the transitions.
Forward-backward marginals give each word's probability; a text's score is a
logistic function of their sum, share and maximum, and words over one half are
its offending offsets.

Training uses at most ``max_docs`` labelled documents of up to ``max_chars``
characters, a quarter of them toxic, those with the smallest hash of id (a
documented bound on what is learned from, not on what is scored); the logistic function
weighs the clean ones up to their share of all labels. Document labels become word labels: in a toxic
document, words whose feature occurs far more often in toxic documents are
toxic; every other word is clean.

Inference is exact and vectorised: a text's chain is a product of 2 x 2
matrices, so stretches of ``STRETCH`` words are first multiplied side by side,
then chained, then filled in side by side.

Cases: a null or empty text scores as a text without toxic words; null ids are
kept and repeated rows each get their row; extra columns are ignored; without
labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH, FEATURE_BITS, MAX_WORDS = 64, 18, 400_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: str) -> list[str]:
    core = _EDGE.sub("", word)
    return ["=" + core, *(core[:n] + "*" for n in (4, 5, 6) if len(core) >= n)] if core else []


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << FEATURE_BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << FEATURE_BITS))
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0  # score of a toxic first word
    doc: np.ndarray | None = None  # logistic weights; None: nothing was learned

    def emission(self, word: str) -> float:
        return float(min(30.0, max(-30.0, self.bias + sum(self.weights[_slot(f)] for f in features(word)))))


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words in a row, ``first`` where a text begins: the toxic marginals, and the
    forward and backward ratios of toxic to clean."""
    n = len(emit)
    rows = -(-n // STRETCH)
    x = np.ones(rows * STRETCH)
    x[:n] = np.exp(np.clip(emit, -30, 30))
    head = np.ones(rows * STRETCH, bool)
    head[:n] = first
    x, head = x.reshape(rows, STRETCH).T.copy(), head.reshape(rows, STRETCH).T.copy()
    (t00, t01), (t10, t11) = np.exp(trans)
    s = math.exp(start)
    # row vectors (clean, toxic) times [[a, b], [c, d]]: a = t00 (1 at a head), b = t01 x (s x), c, d likewise
    a = np.where(head, 1.0, t00)
    b = np.where(head, s * x, t01 * x)
    c = np.where(head, 1.0, t10)
    d = np.where(head, s * x, t11 * x)
    p, q, r, u = a[0], b[0], c[0], d[0]
    for k in range(1, STRETCH):
        p, q, r, u = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + u * c[k], r * b[k] + u * d[k]
        scale = 1.0 / (p + q + r + u)
        p, q, r, u = p * scale, q * scale, r * scale, u * scale
    fore, ratio = np.empty(rows), 1.0
    P, Q, R, U = p.tolist(), q.tolist(), r.tolist(), u.tolist()
    for k in range(rows):
        fore[k] = ratio
        ratio = (Q[k] + ratio * U[k]) / (P[k] + ratio * R[k])
    back, ratio = np.empty(rows), 1.0
    for k in range(rows - 1, -1, -1):
        back[k] = ratio
        ratio = (R[k] + U[k] * ratio) / (P[k] + Q[k] * ratio)
    alpha, beta = np.empty((STRETCH, rows)), np.empty((STRETCH, rows))
    ratio = fore
    for k in range(STRETCH):
        alpha[k] = ratio = (b[k] + ratio * d[k]) / (a[k] + ratio * c[k])
    ratio = back
    for k in range(STRETCH - 1, -1, -1):
        beta[k] = ratio
        ratio = (c[k] + d[k] * ratio) / (a[k] + b[k] * ratio)
    alpha, beta = alpha.T.ravel()[:n], beta.T.ravel()[:n]
    odds = alpha * beta
    return odds / (1 + odds), alpha, beta


def _summary(p: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text: 1, log of 1 + the sum of marginals over one half, their share, their maximum.
    Small marginals are left out, or long texts would gather them."""
    some = n > 0
    total, top = np.zeros(len(n)), np.zeros(len(n))
    if some.any():
        at = starts[:-1][some]
        total[some], top[some] = np.add.reduceat(np.where(p > 0.5, p, 0.0), at), np.maximum.reduceat(p, at)
    return np.stack([np.ones(len(n)), np.log1p(total), np.sqrt(total / np.maximum(n, 1)), top], 1)


def _toxic_words(texts: list[str], toxic: list[int], ids: list[np.ndarray], feats: list[list[str]], n1: int, min_share: float, min_odds: float) -> np.ndarray:
    """Which words have a feature that is far more frequent in toxic documents; copies of a text count once."""
    yes, no, seen = Counter(), Counter(), set()
    for wanted in (1, 0):  # only features that toxic documents have often enough are counted in the others
        for t, own, y in zip(texts, ids, toxic):
            if y == wanted and (key := zlib.crc32(t.encode())) not in seen:
                seen.add(key)
                found = {f for w in np.unique(own).tolist() for f in feats[w]}
                (yes if y else no).update(found if y else found & yes.keys())
        if wanted:
            yes = Counter({f: a for f, a in yes.items() if a >= max(5, min_share * n1)})
    n0 = len(toxic) - n1
    odds = {f: math.log((a + 0.5) / (n1 + 1)) - math.log((no[f] + 0.5) / (n0 + 1)) for f, a in yes.items()}
    return np.array([any(odds.get(f, 0.0) >= min_odds for f in fs) for fs in feats], bool)


def _shards(ids: list[np.ndarray], marked: np.ndarray, toxic: np.ndarray, words: int = 150_000) -> Iterator[tuple]:
    """(words, whether each is a text's first, whether it is toxic, words of each text) of runs of texts: training holds one run's arrays at a time."""
    at = 0
    while at < len(ids):
        to, n = at, 0
        while to < len(ids) and (n < words or to == at):
            n += len(ids[to])
            to += 1
        size = np.array([len(x) for x in ids[at:to]])
        flat = np.concatenate(ids[at:to])
        first = np.zeros(len(flat), bool)
        first[np.concatenate([[0], np.cumsum(size)])[:-1][size > 0]] = True
        yield flat, first, (marked[flat] & np.repeat(toxic[at:to], size)).astype(np.int8), size
        at = to


def fit(texts: list[str], toxic: list[int], clean_weight: float = 1.0, epochs: int = 25, min_share: float = 0.015, min_odds: float = 3.0) -> Model:
    """A model from texts and their labels."""
    model = Model()
    n1 = sum(toxic)
    if not n1 or n1 == len(toxic):
        return model
    place: dict[str, int] = {}
    ids = [np.array([place.setdefault(w, len(place)) for w in t.lower().split()], np.int32) for t in texts]
    feats = [features(w) for w in place]
    marked = _toxic_words(texts, toxic, ids, feats, n1, min_share, min_odds)
    slot = np.array([_slot(f) for fs in feats for f in fs], np.int64)
    owner = np.repeat(np.arange(len(feats), dtype=np.int32), [len(fs) for fs in feats])
    del place, feats
    shards = list(_shards(ids, marked, np.array(toxic, bool)))
    params = [model.weights, np.zeros(1), model.trans, np.zeros(1)]
    params[1][0] = -4.0
    past = [np.full_like(p, 1e-2) for p in params]
    n_words = len(marked)

    def emissions() -> np.ndarray:
        return np.clip(np.bincount(owner, params[0][slot], n_words) + params[1][0], -30, 30)

    for _ in range(epochs):
        word, by_word = emissions(), np.zeros(n_words)
        grads = [None, np.zeros(1), -0.02 * params[2], np.zeros(1)]
        for flat, first, y, _ in shards:
            emit = word[flat]
            p, alpha, beta = marginals(emit, first, params[2], params[3][0])
            miss = y - p
            by_word += np.bincount(flat, miss, n_words)
            inner = np.flatnonzero(~first)
            before, after = alpha[inner - 1], np.exp(emit[inner]) * beta[inner]
            # the four joint marginals of neighbours
            (t00, t01), (t10, t11) = np.exp(params[2])
            parts = [t00 * np.ones_like(before), t01 * after, t10 * before, t11 * before * after]
            total = sum(parts)
            have = np.bincount(2 * y[inner - 1] + y[inner], minlength=4)
            grads[2] += (have - np.array([(q / total).sum() for q in parts])).reshape(2, 2)
            grads[1] += miss.sum()
            grads[3] += miss[first].sum()
        grads[0] = np.bincount(slot, by_word[owner], len(params[0])) - 0.02 * params[0]
        for v, g, h in zip(params, grads, past):
            h += g * g
            v += 0.5 * g / np.sqrt(h)
    model.bias, model.start = float(params[1][0]), float(params[3][0])
    word = emissions()
    X = np.concatenate([_summary(marginals(word[flat], first, model.trans, model.start)[0], np.concatenate([[0], np.cumsum(size)]), size) for flat, first, _, size in shards])
    t = np.array(toxic, float)
    w, weigh = np.zeros(X.shape[1]), np.where(t > 0, 1.0, clean_weight)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        z = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (weigh * (t - z)) - 0.1 * w
        w += np.linalg.solve((X * (weigh * z * (1 - z))[:, None]).T @ X + 0.1 * np.eye(len(w)), g)
    model.doc = w
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores, and the offending (start, end) code points of each text."""
        model, known = self.model, self.known
        if model.doc is None:
            return np.zeros(len(texts)), [[] for _ in texts]
        flat: list[float] = []
        size = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = (t or "").lower().split()
            got = [known.get(w) for w in words]
            if None in got:
                for k, v in enumerate(got):
                    if v is None:
                        if (v := known.get(w := words[k])) is None:
                            if len(known) >= MAX_WORDS:
                                known.clear()
                            v = known[w] = model.emission(w)
                        got[k] = v
            size[i] = len(got)
            flat += got
        emit = np.array(flat)
        starts = np.concatenate([[0], np.cumsum(size)])
        first = np.zeros(len(emit), bool)
        first[starts[:-1][size > 0]] = True
        p = marginals(emit, first, model.trans, model.start)[0] if len(emit) else emit
        score = 1 / (1 + np.exp(-np.clip(_summary(p, starts, size) @ model.doc, -30, 30)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        bad = np.flatnonzero(p > 0.5)
        for i in np.unique(np.searchsorted(starts, bad, "right") - 1).tolist():
            own = set((bad[(bad >= starts[i]) & (bad < starts[i + 1])] - starts[i]).tolist())
            spans[i] = [m.span() for k, m in enumerate(re.finditer(r"\S+", texts[i])) if k in own]
        return score, spans


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 4000, max_chars: int = 20_000) -> Model:
    """Fit on at most ``max_docs`` labelled documents. A document with several labels is
    toxic if one of them says so."""
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("toxic")).dropna()
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    bound = {1: max_docs // 4, 0: max_docs - max_docs // 4}
    picked = [tuple(r) for y in (0, 1) for r in own.filter(F.col("toxic") == y).orderBy(*order).limit(bound[y]).collect()]
    few = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))  # max_docs rows at most
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") <= max_chars)
    first = src.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # repeated ids give one text
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in first.collect())
    share = {y: n.get(y, 0) / max(1, min(bound[y], n.get(y, 0))) for y in (0, 1)}
    return fit([r[1] for r in rows], [r[2] for r in rows], share[0] / max(1e-9, share[1]))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans) of each row of ``docs``; spans are [start, end) code points of toxic words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                score, spans = scorer.score(batch.column(1).to_pylist())
                found = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), found], ["doc_id", "score", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                yield batch.filter(pa.array(scorer.score(batch.column(at_text).to_pylist())[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
