"""Token counts: pieces are counted once per distinct pre-token.

1. Documents are split into pre-tokens; a block of them becomes one row with
   its distinct pre-tokens and the frequencies (document, pre-token, n).
2. The distinct pre-tokens of all blocks are dealt out by value and sorted, so
   each value meets the library once, for its number of pieces.
3. The numbers return to their blocks, are joined to the frequencies there and
   summed. No ids are made outside the library, and what is shuffled is each
   block's vocabulary, not each document's.

Cases: a null or empty text counts as zero bytes and zero tokens; a null id is
kept; repeated rows each get their row; extra columns are ignored; an empty
table gives an empty result; a very long text is a block of its own. Texts with
a special token's string are counted whole by the library, which finds special
tokens as it does by default; so are all texts under a sentence model, whose
pieces may span words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, stash_bucketed, tasks_for
from .pretokens import BYTE_LEVEL, UNSAFE, load_tokenizer, special_strings

_BLOCK = "block long, words array<string>, doc array<long>, n_bytes array<long>, whole array<long>, ptr array<long>, freq binary, size long"


def _frequencies(path: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None if path.endswith(".model") else load_tokenizer(path)
        if tok is None:
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
        special = special_strings(tok) if tok else []
        part, made = TaskContext.get().partitionId(), 0
        split = BYTE_LEVEL.findall
        names = ["block", "words", "doc", "n_bytes", "whole", "ptr", "freq", "size"]

        def fresh():
            return {}, [], [], [], [0], [], []

        words, doc, n_bytes, whole, ptr, idx, cnt = fresh()
        chars = 0

        def row():
            flat = np.concatenate([np.array(idx, np.int32), np.array(cnt, np.int32)])
            flat = flat.view(np.uint8).reshape(-1, 4).T.copy()  # like bytes together, which compress better
            cols = [[(part << 32) | made], [list(words)], [doc], [n_bytes], [whole], [ptr], [pa.compress(flat.ravel(), codec="zstd", asbytes=True)], [flat.nbytes]]
            kinds = [pa.int64(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part_of = batch.slice(start, 256)
                for i, t in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist()):
                    t = t or ""
                    doc.append(i)
                    n_bytes.append(len(t.encode()))
                    if tok is None:  # pieces of a sentence model may span words: whole texts
                        whole.append(len(piece.encode(t, num_threads=1)))
                    elif any(s in t for s in special):
                        whole.append(len(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids))
                    else:
                        whole.append(0)
                        # beyond the Latin ranges the library's own pre-tokenizer cuts, by its Unicode tables
                        cut = [t[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(t)] if UNSAFE.search(t) else split(t)
                        for w, n in Counter(cut).items():
                            idx.append(words.setdefault(w, len(words)))
                            cnt.append(n)
                    ptr.append(len(idx))
                    chars += len(t)
                    if chars >= block_chars:
                        yield row()
                        made += 1
                        words, doc, n_bytes, whole, ptr, idx, cnt = fresh()
                        chars = 0
        if doc:
            yield row()

    return run


def _pieces(path: str, keep: int = 1_000_000):
    """Sorted (word, block, pos) to (block, positions, numbers of pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None if path.endswith(".model") else load_tokenizer(path)
        last, last_n = None, 0
        held: dict[int, list] = {}
        count = 0

        def flush():
            rows = []
            for b, parts in held.items():
                pos = np.concatenate([p for p, _ in parts])
                num = np.concatenate([n for _, n in parts])
                rows.append((b, pos.astype(np.int32).tobytes(), num.astype(np.int32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["block", "pos", "num"])

        for batch in batches:
            enc = batch.column(0).dictionary_encode()
            words, code = enc.dictionary.to_pylist(), enc.indices.to_numpy()
            first = 1 if words and words[0] == last else 0
            nums = [last_n] * first + [len(e.ids) for e in tok.encode_batch_fast(words[first:], add_special_tokens=False)]
            if not words:
                continue
            last, last_n = words[-1], nums[-1]
            n = np.array(nums, np.int64)[code]
            block, pos = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for part in np.split(order, cuts):
                held.setdefault(int(block[part[0]]), []).append((pos[part], n[part]))
            count += len(code)
            if count >= keep:
                yield flush()
                held, count = {}, 0
        if held:
            yield flush()

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            get = {n: batch.column(k)[r] for k, n in enumerate(batch.schema.names)}
            flat = np.frombuffer(pa.decompress(get["freq"].as_buffer(), decompressed_size=get["size"].as_py(), codec="zstd"), np.uint8)
            flat = flat.reshape(4, -1).T.copy().view(np.int32).ravel()
            idx, cnt = flat[: len(flat) // 2], flat[len(flat) // 2 :]
            num = np.zeros(get["n_words"].as_py(), np.int64)
            for part in get["parts"].as_py() or []:
                num[np.frombuffer(part["pos"], np.int32)] = np.frombuffer(part["num"], np.int32)
            total = np.concatenate([[0], np.cumsum(cnt * num[idx])])
            ptr = get["ptr"].values.to_numpy()
            tokens = total[ptr[1:]] - total[ptr[:-1]] + get["whole"].values.to_numpy()
            yield pa.RecordBatch.from_arrays([get["doc"].values, get["n_bytes"].values, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 32_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``docs`` under the vocabulary file ``tokenizer``."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks, drop = stash_bucketed(src.mapInArrow(_frequencies(tokenizer, block_chars), _BLOCK), "token-blocks", "block", tasks_for(src))
    words = blocks.select("block", F.posexplode("words").alias("pos", "word")).select("word", "block", "pos")
    counted = words.repartition(tasks_for(src), "word").sortWithinPartitions("word").mapInArrow(_pieces(tokenizer), "block long, pos binary, num binary")
    per_block = counted.groupBy("block").agg(F.collect_list(F.struct("pos", "num")).alias("parts"))
    joined = blocks.select("block", "doc", "n_bytes", "whole", "ptr", "freq", "size", F.size("words").alias("n_words")).join(per_block, "block", "left")
    counts = stash(joined.mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long"), "token-counts")
    drop()
    return counts
