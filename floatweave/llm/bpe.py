"""Byte-pair encoding and decoding with word ends, from a public vocabulary file.

Encoding: a word's symbols form a doubly linked list; a priority queue holds
(merge rank, position) of neighbouring pairs. The best entry is taken, skipped
when it is stale (a symbol of it has been merged since), or merged, and the
pairs on both sides of the new symbol are queued. Decoding joins vocabulary
strings in the order of the ids; the file names no decoder, so the strings are
joined by one space, word ends included, as the library does.

Cases: a null or empty text has no ids and decodes to an empty text; a null id
is kept; repeated rows each get their row; extra columns are ignored. Special
tokens' strings in a text become their ids.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import UNSAFE, WORD_LEVEL, byte_chars, load_tokenizer, special_strings

_SHIFT = 20


class WordBPE:
    """A byte-pair encoder whose words end in a marked symbol."""

    def __init__(self, path: str, max_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.strings: list[str] = [""] * (1 + max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in self.vocab.items():
            self.strings[i] = s
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges[self.vocab[a] << _SHIFT | self.vocab[b]] = rank, self.vocab[a + b]
        chars = byte_chars()
        self.symbol = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.end] for c in chars]
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.tok = load_tokenizer(path)
        self.special = special_strings(self.tok)
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.max_entries = max_entries
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        ids = [self.symbol[b] for b in word]
        n = len(ids)
        if not n:
            return ids
        ids[-1] = self.last[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        rule, queue = self.merges.get, []
        for i in range(n - 1):
            pair = ids[i] << _SHIFT | ids[i + 1]
            if (m := rule(pair)) is not None:
                queue.append((m[0], i, pair, m[1]))
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        while queue:
            _, i, pair, new = pop(queue)
            j = after[i]
            if j < 0 or ids[i] << _SHIFT | ids[j] != pair:  # stale: one of the two is gone
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                pair = new << _SHIFT | ids[k]
                if (m := rule(pair)) is not None:
                    push(queue, (m[0], i, pair, m[1]))
            h = before[i]
            if h >= 0:
                pair = ids[h] << _SHIFT | new
                if (m := rule(pair)) is not None:
                    push(queue, (m[0], h, pair, m[1]))
        return [x for x in ids if x >= 0]

    def _word(self, w: str) -> bytes:
        if (got := self.words.get(w)) is None:
            if len(self.words) >= self.max_entries:
                self.words.clear()
            got = self.words[w] = np.array(self.merge(w.encode()), np.int32).tobytes()
        return got

    def _hard(self, text: str) -> bytes:
        """A text with special strings or characters beyond the simple range."""
        out, at = [], 0
        for m in [*self.cut.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                shown = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))
                out += (np.array(self.merge(bytes(self.byte_of[c] for c in s)), np.int32).tobytes() for s, _ in shown)
            if m:
                out.append(np.array([self.special_ids[m[0]]], np.int32).tobytes())
                at = m.end()
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if UNSAFE.search(text) or self.cut.search(text):
            return np.frombuffer(self._hard(text), np.int32)
        chunks = text.lower().split()
        known = self.chunks
        out = [known.get(c) for c in chunks]
        if None in out:
            for k, c in enumerate(chunks):
                if out[k] is None:
                    if (got := known.get(c)) is None:
                        if len(known) >= self.max_entries:
                            known.clear()
                        got = known[c] = b"".join(map(self._word, WORD_LEVEL.findall(c)))
                    out[k] = got
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


_held: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    if path not in _held:
        _held[path] = WordBPE(path)
    return _held[path]


def _encode(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)])
                cols = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
                if decode:
                    cols.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    return run


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row of ``docs``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_encode(tokenizer, False), "doc_id long, ids array<int>")


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of each row and their decoding, in one pass."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_encode(tokenizer, True), "doc_id long, ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of each row of ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    src = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, "doc_id long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``bpe_round_trip``'s rows."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
