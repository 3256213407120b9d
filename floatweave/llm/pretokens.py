"""Splitting text into pre-tokens as the public tokenizers do, and cached encoding.

The merges of a byte-pair encoding never cross a pre-token, so the ids of a
text are the ids of its pre-tokens in order. What lies within the ranges that
``UNSAFE`` leaves is split here with explicit character classes; for the rest the
library's own pre-tokenizer is asked, so both follow its Unicode tables.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG = 64  # characters of a chunk that is not kept

_RANGE = [chr(c) for c in range(0x250)]
_LETTERS = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _RANGE if unicodedata.category(c)[0] == "N")
_SPACES = "\t\n\x0b\x0c\r \xa0"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: A character outside the range for which the classes above are complete.
UNSAFE = re.compile("[^\t\n\x0b\x0c\r -~\xa0-įı-ɏ‐-‧‰-⁞€]")

#: Pre-tokens of the byte-level vocabulary: a word, number or sign run takes one space before it.
BYTE_LEVEL = re.compile(
    f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)

#: Pre-tokens of the vocabulary with word ends: white space is dropped, digits stand alone.
WORD_LEVEL = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


_WIDE = [c for c in map(chr, range(0x3001)) if (c.isspace() or c == "\u180e") and c != " "]
_ASCII = [c for c in _WIDE if c < "\x80"]


def space_run(text: str) -> bool:
    """Whether a space stands beside more white space: then cutting at single spaces is not exact."""
    return "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in (_ASCII if text.isascii() else _WIDE))


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def special_strings(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Hash:
    """64-bit hashes of an Arrow string array without making Python strings: a random number for
    each byte, times an odd power of its place, summed by differences of one running sum."""

    def __init__(self):
        rng = np.random.default_rng(20250)
        self.value = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = rng.integers(1, 2**62, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
        self.back = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = self.unpower = np.empty(0, np.uint64)

    def __call__(self, strings: pa.Array) -> np.ndarray:
        offset = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
        offset = offset - offset[0]
        if len(self.power) <= len(raw):
            n = 2 * len(raw) + 1024
            self.power, self.unpower = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (self.base, self.back))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=total[1:])
        h = (total[offset[1:]] - total[offset[:-1]]) * self.unpower[offset[:-1]]
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x9E3779B97F4A7C15) + np.diff(offset).astype(np.uint64)).view(np.int64)


class IdTable:
    """The ids of strings, found by the strings' 64-bit hashes in sorted arrays, which take a
    third of a dictionary's memory and no walk through it; at most ``limit`` strings."""

    def __init__(self, dtype: np.dtype, limit: int = 2_000_000):
        self.dtype, self.limit = dtype, limit
        self.clear()

    def clear(self) -> None:
        self.hash, self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 20, self.dtype), 0

    def full(self, more: int) -> bool:
        return len(self.hash) + more > self.limit

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, at, -1)

    def add(self, h: np.ndarray, new: np.ndarray, n: np.ndarray) -> None:
        """Keep ``new``, the ids of all strings of these hashes, ``n`` of each."""
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(new), self.used), self.dtype)])
        self.pool[self.used : self.used + len(new)] = new
        size = n.astype(np.int32)
        first = self.used + np.cumsum(n) - n
        self.used += len(new)
        order = np.argsort(h)
        at = np.searchsorted(self.hash, h[order])
        self.hash, self.first, self.size = (np.insert(old, at, x[order]) for old, x in ((self.hash, h), (self.first, first), (self.size, size)))


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that ``code`` names, one after the other."""
    n = size[code]
    ends = np.cumsum(n)
    place = np.repeat(first[code] - (ends - n), n)
    place += np.arange(len(place))
    return pool[place]


class ByteLevelEncoder:
    """Ids of whole texts under a byte-level vocabulary file of the tokenizers library.

    A text is cut at its single spaces, where a pre-token always begins whatever the
    letters. Arrow finds the distinct chunks of a run of texts; each is looked up once in a
    bounded table, and the library's model merges the pre-tokens of those that are new.
    Texts with a space beside more white space go to the library whole.
    """

    def __init__(self, path: str, dtype: str, limit: int = 2_000_000):
        self.dtype = np.dtype(dtype)  # little-endian machines, as Arrow's
        self.tok = load_tokenizer(path)
        self.special = special_strings(self.tok)
        self.shown = dict(enumerate(byte_chars()))
        self.table, self.hash = IdTable(self.dtype, limit), _Hash()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of chunks behind one space: the library's model merges each
        distinct pre-token of theirs once."""
        pieces: dict[str, int] = {}  # as the vocabulary shows them; behind \0 what the library takes as it stands
        place, shown = pieces.setdefault, self.shown
        code, n = [], []
        for c in chunks:
            if len(c) > LONG:
                own = ["\0" + c]
            elif c.isascii() and c.isprintable():  # shown as it is, but for the space before it
                if c.isalpha():
                    code.append(place("Ġ" + c, len(pieces)))
                    n.append(1)
                    continue
                if (rest := c[:-1]).isalpha() and c[-1] in ".,;:!?":
                    own = ["Ġ" + rest, c[-1]]
                else:
                    own = BYTE_LEVEL.findall(" " + c)
                    own[0] = "Ġ" + own[0][1:]
            elif UNSAFE.search(c):
                own = ["\0" + c]
            else:
                own = [p.encode().decode("latin-1").translate(shown) for p in BYTE_LEVEL.findall(" " + c)]
            for p in own:
                code.append(place(p, len(pieces)))
            n.append(len(own))
        tokenize = self.model.tokenize
        ids, size = [], []
        for p in pieces:
            before = len(ids)
            ids += [t.id for t in tokenize(p)] if p[0] != "\0" else self._library([" " + p[1:]])[0].tolist()
            size.append(len(ids) - before)
        size, flat = np.array(size, np.int64), np.array(ids, self.dtype)
        return _gather(flat, np.cumsum(size) - size, size, np.array(code, np.int64)), np.add.reduceat(size[code], np.cumsum(n) - n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if not texts:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        self.model = self.tok.model
        every = "\0".join(texts)
        special = [s for s in self.special if s in every]
        odd = "  " in every or any(c in every for c in _WIDE)
        hard = [i for i, t in enumerate(texts) if space_run(t) or any(s in t for s in special)] if odd or special else []
        easy = texts
        if hard:
            easy = list(texts)
            for i in hard:
                easy[i] = ""
        cut = pc.split_pattern(pa.array(easy, pa.large_string()), " ")
        start = cut.offsets.to_numpy()
        chunks = cut.values.dictionary_encode()
        h = self.hash(chunks.dictionary)
        order = np.argsort(h)  # neighbours are found fast
        h, words = h[order], chunks.dictionary.take(pa.array(order))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        code = rank[chunks.indices.to_numpy()]
        new = np.flatnonzero(self.table.find(h) < 0)
        # a text's first chunk has no space before it; whole texts of the library come last
        heads = cut.values.take(pa.array(start[:-1])).dictionary_encode()
        code[start[:-1]] = heads.indices.to_numpy() + len(words)
        own = self._library(heads.dictionary.to_pylist())
        if hard:
            code[start[:-1][hard]] = np.arange(len(hard)) + len(words) + len(own)
            own += self._library([texts[i] for i in hard])
        if len(new):
            if self.table.full(len(new)):  # begins anew with the chunks of these texts
                self.table.clear()
                new = np.arange(len(words))
            self.table.add(h[new], *self._learn(words.take(pa.array(new)).to_pylist()))
        table, at = self.table, self.table.find(h)
        pool = np.concatenate([*own, table.pool[: table.used]])
        size = np.fromiter(map(len, own), np.int64, len(own))
        first = np.concatenate([table.first[at] + len(pool) - table.used, np.cumsum(size) - size])
        size = np.concatenate([table.size[at], size])
        return _gather(pool, first, size, code), np.add.reduceat(size[code], start[:-1])
