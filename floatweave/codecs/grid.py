"""The block-transform codec: differences of rotated bits, and their bit matrices without zero words.

A cube of 4096 values (one dimension, 64 x 64, or 16 x 16 x 16) is transformed: bits turned left by
one, differences along each dimension, negative ones complemented. Of every 64
values (32 of floats) the OR is written, and of the transposed bit matrix the
words of the bits that are set there. What does not fill a cube follows as it is.
"""

from __future__ import annotations

import struct

import numpy as np

CUBE = 4096
SIDE = {1: 4096, 2: 64, 3: 16}


class GridCodec:
    def __init__(self, kind: str = "f8", dims: int = 1):
        self.float, self.uint, self.bits = (np.float64, np.uint64, 64) if kind == "f8" else (np.float32, np.uint32, 32)
        self.name = "grid" + ("" if kind == "f8" else "_f32") + ("" if dims == 1 else f"_{dims}d")
        self.dims, self.block, self.dtype = dims, CUBE * 4, kind

    def _shape(self, cubes: np.ndarray) -> np.ndarray:
        return cubes.reshape(len(cubes), *[SIDE[self.dims]] * self.dims)

    def transform(self, x: np.ndarray) -> np.ndarray:
        one, top = self.uint(1), self.uint(self.bits - 1)
        x = self._shape((x << one) | (x >> top))
        for axis in range(1, self.dims + 1):
            x = np.diff(x, axis=axis, prepend=self.uint(0))
        x = x.reshape(-1, CUBE)
        return np.where(x >> top > 0, x ^ (~self.uint(0) >> one), x)

    def invert(self, x: np.ndarray) -> np.ndarray:
        one, top = self.uint(1), self.uint(self.bits - 1)
        x = self._shape(np.where(x >> top > 0, x ^ (~self.uint(0) >> one), x))
        for axis in range(1, self.dims + 1):
            x = np.cumsum(x, axis=axis, dtype=self.uint)
        x = x.reshape(-1, CUBE)
        return (x >> one) | (x << top)

    def encode(self, values) -> bytes:
        bits = np.ascontiguousarray(values, self.float).view(self.uint)
        full = len(bits) // CUBE
        out = [struct.pack("<I", len(bits))]
        big = np.dtype(self.uint).newbyteorder(">")
        for cube in self.transform(bits[: full * CUBE].reshape(full, CUBE)) if full else []:
            groups = cube.reshape(-1, self.bits)
            heads = np.bitwise_or.reduce(groups, axis=1)
            grid = np.unpackbits(groups.astype(big).view(np.uint8).reshape(len(groups), self.bits, self.bits // 8), axis=2)
            words = np.packbits(grid.transpose(0, 2, 1), axis=2).reshape(-1, self.bits // 8)
            some = np.unpackbits(heads.astype(big).view(np.uint8)).astype(bool)
            out += [heads.astype(big).tobytes(), words[some].tobytes()]
        out.append(bits[full * CUBE :].tobytes())
        return b"".join(out)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (n,) = struct.unpack_from("<I", data)
        at, size, cubes = 4, self.bits // 8, []
        big = np.dtype(self.uint).newbyteorder(">")
        for _ in range(n // CUBE):
            heads = data[at : at + CUBE // self.bits * size]
            at += len(heads)
            some = np.unpackbits(np.frombuffer(heads, np.uint8)).astype(bool)
            words = np.zeros((CUBE, size), np.uint8)
            words[some] = np.frombuffer(data, np.uint8, int(some.sum()) * size, at).reshape(-1, size)
            at += int(some.sum()) * size
            grid = np.unpackbits(words.reshape(-1, self.bits, size), axis=2)
            cubes.append(np.packbits(grid.transpose(0, 2, 1), axis=2).reshape(-1, size).view(big).astype(self.uint).ravel())
        whole = self.invert(np.stack(cubes)).ravel() if cubes else np.zeros(0, self.uint)
        return np.concatenate([whole, np.frombuffer(data, self.uint, n % CUBE, at)]).view(self.float)
