"""Integer building blocks: frame of reference, bit packing, runs and differences."""

from __future__ import annotations

import struct

import numpy as np


def width_of(values: np.ndarray) -> tuple[int, int]:
    """(base, bits) of a frame of reference; equal values take none."""
    if not len(values):
        return 0, 0
    lo, hi = int(values.min()), int(values.max())
    return lo, (hi - lo).bit_length()


def pack(values: np.ndarray, base: int, bits: int) -> bytes:
    """The low ``bits`` of value - base, most significant bit first."""
    if not bits or not len(values):
        return b""
    off = (values.astype(np.int64).view(np.uint64) - np.array([base], np.int64).view(np.uint64)).astype(">u8")
    return np.packbits(np.unpackbits(off.view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - bits :]).tobytes()


def unpack(data: bytes, n: int, base: int, bits: int) -> np.ndarray:
    if not bits:
        return np.full(n, base, np.int64)
    grid = np.zeros((n, 64), np.uint8)
    grid[:, 64 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8))[: n * bits].reshape(n, bits)
    off = np.packbits(grid, axis=1).view(">u8").astype(np.uint64).ravel()
    return (off + np.array([base], np.int64).view(np.uint64)).view(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, length) of each run."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.diff(np.concatenate([at, [len(values)]]))


class Cascaded:
    """Runs, then runs of the differences of the runs' values, each list bit-packed.

    Works on the bits of doubles; ``n_runs`` rounds of runs with ``n_deltas``
    differences between them."""

    name, block, dtype = "cascaded", 4096, "f8"

    def __init__(self, n_runs: int = 2, n_deltas: int = 1):
        self.n_runs, self.n_deltas = n_runs, n_deltas

    def encode(self, values) -> bytes:
        return self.encode_ints(np.ascontiguousarray(values, np.float64).view(np.int64))

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        return self.decode_ints(data).view(np.float64)

    def encode_ints(self, x: np.ndarray) -> bytes:
        lists, firsts = [], []
        deltas = self.n_deltas
        for _ in range(self.n_runs):
            x, lengths = runs(x)
            lists.append(lengths)
            if deltas and len(x):
                firsts.append(int(x[0]))
                x = (x[1:].view(np.uint64) - x[:-1].view(np.uint64)).view(np.int64)
                deltas -= 1
        lists.append(x)
        out = [struct.pack("<BB", len(lists), len(firsts)), np.array(firsts, "<i8").tobytes()]
        for one in lists:
            base, bits = width_of(one)
            body = pack(one, base, bits)
            out += [struct.pack("<IqBI", len(one), base, bits, len(body)), body]
        return b"".join(out)

    def decode_ints(self, data: bytes) -> np.ndarray:
        n_lists, n_firsts = struct.unpack_from("<BB", data)
        firsts = np.frombuffer(data, "<i8", n_firsts, 2).astype(np.int64)
        at, lists = 2 + 8 * n_firsts, []
        for _ in range(n_lists):
            n, base, bits, size = struct.unpack_from("<IqBI", data, at)
            at += 17
            lists.append(unpack(data[at : at + size], n, base, bits))
            at += size
        x = lists.pop()
        for k in range(len(lists) - 1, -1, -1):
            if k < len(firsts):
                x = np.cumsum(np.concatenate([firsts[k : k + 1], x]).view(np.uint64), dtype=np.uint64).view(np.int64)
            x = np.repeat(x, lists[k])
        return x
