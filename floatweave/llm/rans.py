"""Static range asymmetric numeral system over integer symbols, in NumPy.

One table of frequencies, scaled to a power of two, serves every block. A block
is coded by ``LANES`` interleaved coders that share one stream of 32-bit words;
every ``CHECK`` steps the coders' states and the place in the stream are kept,
so a decoder can start there. A block depends on nothing but the table.

Block: header, checkpoint offsets, checkpoint states, words. The header holds
the number of symbols, steps, sections and words, the CRC-32 of what follows it
and of the symbols as 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE_BITS = 20  # frequencies sum to 2**20
LANES = 256
CHECK = 256  # steps between checkpoints
BLOCK = LANES * CHECK * 4  # symbols in a full block
_LOW = np.uint64(1 << 31)  # a coder's state stays in [2**31, 2**63)
_HEAD = struct.Struct("<4sIIIIII")


def scale(counts: np.ndarray) -> np.ndarray:
    """Counts to frequencies that sum to 2**SCALE_BITS; a symbol that occurs keeps 1 at least."""
    counts = counts.astype(np.int64)
    total, room = int(counts.sum()), 1 << SCALE_BITS
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > room:
        raise ValueError("more symbols than the table has room for")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (room / total)).astype(np.int64)), 0)
    left = room - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if left > 0:
        freq[order[0]] += left
    k = 0
    while left < 0:  # take from the most frequent, which notice it least
        take = min(-left, max(1, int(freq[order[k]]) // 8), int(freq[order[k]]) - 1)
        freq[order[k]] -= take
        left += take
        k = k + 1 if k + 1 < len(order) and freq[order[k + 1]] > 1 else 0
    return freq


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.slot_freq = self.freq[self.symbol]
        self.slot_bias = np.arange(len(self.symbol), dtype=np.uint64) - self.cum[self.symbol]


def encode(symbols: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of BLOCK symbols, the last one shorter."""
    full = len(symbols) // BLOCK
    out = _encode(symbols[: full * BLOCK].reshape(full, BLOCK), table) if full else []
    if len(symbols) > full * BLOCK:
        out += _encode(symbols[full * BLOCK :][None, :], table)
    return out


def _encode(blocks: np.ndarray, table: Table) -> list[bytes]:
    n_blocks, n = blocks.shape
    steps = -(-n // LANES)
    padded = np.empty((n_blocks, steps * LANES), np.int64)
    padded[:, :n] = blocks
    padded[:, n:] = blocks[:, -1:]  # any symbol that the table holds
    padded = padded.reshape(n_blocks, steps, LANES)
    freq, cum = table.freq[padded], table.cum[padded]
    state = np.full((n_blocks, LANES), _LOW, np.uint64)
    emits = np.zeros((n_blocks, steps, LANES), bool)
    words = np.zeros((n_blocks, steps, LANES), np.uint32)
    sections = -(-steps // CHECK)
    kept = np.empty((n_blocks, sections, LANES), np.uint64)
    bits, thirty_two, top = np.uint64(SCALE_BITS), np.uint64(32), np.uint64(63 - SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        f = freq[:, t]
        big = state >= f << top
        emits[:, t] = big
        words[:, t] = state  # the low half, kept where it is emitted
        state = np.where(big, state >> thirty_two, state)
        q = state // f
        state = (q << bits) + (state - q * f) + cum[:, t]
        if t % CHECK == 0:
            kept[:, t // CHECK] = state
    out = []
    for b in range(n_blocks):
        stream = words[b][emits[b]].astype("<u4")
        before = np.concatenate([[0], np.cumsum(emits[b].sum(1))])[np.arange(sections) * CHECK].astype("<u4")
        body = before.tobytes() + kept[b].astype("<u8").tobytes() + stream.tobytes()
        head = _HEAD.pack(b"RANB", n, steps, sections, len(stream), zlib.crc32(body), zlib.crc32(blocks[b].astype("<u4").tobytes()))
        out.append(head + body)
    return out


def decode(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The symbols of each block. All sections of all blocks of one length advance together."""
    out: list[np.ndarray | None] = [None] * len(blocks)
    parsed = [_HEAD.unpack_from(b) for b in blocks]
    for shape in sorted({(p[1], p[2], p[3]) for p in parsed}):
        mine = [k for k, p in enumerate(parsed) if (p[1], p[2], p[3]) == shape]
        for k, got in zip(mine, _decode([blocks[k] for k in mine], [parsed[k] for k in mine], table)):
            out[k] = got
    return out


def _decode(blocks: list[bytes], heads: list[tuple], table: Table) -> list[np.ndarray]:
    _, n, steps, sections = heads[0][:4]
    begin, states, streams, base = [], [], [], 0
    for raw, h in zip(blocks, heads):
        if h[0] != b"RANB":
            raise ValueError("not a block")
        at = _HEAD.size
        begin.append(np.frombuffer(raw, "<u4", sections, at).astype(np.int64) + base)
        states.append(np.frombuffer(raw, "<u8", sections * LANES, at + 4 * sections).reshape(sections, LANES))
        words = at + 4 * sections + 8 * sections * LANES
        if len(raw) != words + 4 * h[4] or zlib.crc32(memoryview(raw)[at:]) != h[5]:
            raise ValueError("a block fails its checksum")
        streams.append(np.frombuffer(raw, "<u4", h[4], words))
        base += h[4]
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    at, state = np.concatenate(begin), np.concatenate(states).astype(np.uint64)
    lanes = sections * len(blocks)
    out = np.empty((lanes, CHECK, LANES), np.uint32)
    bits, mask, thirty_two = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    live = np.array([min(CHECK, steps - s * CHECK) for s in range(sections)] * len(blocks))
    for t in range(CHECK):
        if t == live.min() and t:  # the last, shorter sections are through
            if not (going := live > t).any():
                break
            rows = np.flatnonzero(going)
        elif t == 0:
            rows = np.arange(lanes)
        st = state[rows]
        slot = (st & mask).astype(np.int64)
        out[rows, t] = table.symbol[slot]
        st = table.slot_freq[slot] * (st >> bits) + table.slot_bias[slot]
        low = st < _LOW
        rank = np.cumsum(low, axis=1)
        place = at[rows][:, None] + rank - 1
        st = np.where(low, st << thirty_two | stream[np.minimum(np.maximum(place, 0), len(stream) - 1)], st)
        at[rows] += rank[:, -1]
        state[rows] = st
    got = out.reshape(len(blocks), -1)[:, : steps * LANES] if sections == 1 or steps % CHECK == 0 else out.reshape(len(blocks), sections * CHECK * LANES)
    result = []
    for b, h in enumerate(heads):
        ids = got[b][:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != h[6]:
            raise ValueError("the symbols of a block fail their checksum")
        result.append(ids)
    return result
