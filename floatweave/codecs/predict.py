"""Codecs that store what a prediction misses: hashed predictors, sub-chunk differences, word matrices."""

from __future__ import annotations

import struct

import numpy as np

_M = (1 << 64) - 1


class Fpc:
    """Two hashed predictors, of values and of differences; the nearer one's XOR loses its leading
    zero bytes. Four bits a value: the predictor and the number of zero bytes (four count as three)."""

    name, block, dtype = "fpc", 32768, "f8"

    def __init__(self, table_bits: int = 16):
        self.mask = (1 << table_bits) - 1

    def _predictors(self):
        value, step = {}, {}
        h = g = last = 0

        def look():
            return value.get(h, 0), (last + step.get(g, 0)) & _M

        def learn(x: int) -> None:
            nonlocal h, g, last
            value[h] = x
            h = (h << 6 ^ x >> 48) & self.mask
            d = (x - last) & _M
            step[g] = d
            g = (g << 2 ^ d >> 40) & self.mask
            last = x

        return look, learn

    def encode(self, values) -> bytes:
        look, learn = self._predictors()
        codes, body = [], []
        for x in np.ascontiguousarray(values, np.float64).view(np.uint64).tolist():
            a, b = (p ^ x for p in look())
            d, which = (a, 0) if a <= b else (b, 8)
            zeros = 8 - (d.bit_length() + 7) // 8
            zeros = 3 if zeros == 4 else zeros
            codes.append(which | (zeros if zeros < 4 else zeros - 1))
            body.append(d.to_bytes(8, "little")[: 8 - zeros])
            learn(x)
        n = len(codes)
        pairs = np.array(codes + [0] * (n % 2), np.uint8).reshape(-1, 2)
        return struct.pack("<I", n) + (pairs[:, 0] << 4 | pairs[:, 1]).tobytes() + b"".join(body)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (n,) = struct.unpack_from("<I", data)
        packed = np.frombuffer(data, np.uint8, (n + 1) // 2, 4)
        codes = np.stack([packed >> 4, packed & 15], 1).ravel()[:n].tolist()
        look, learn = self._predictors()
        at, out = 4 + (n + 1) // 2, []
        for c in codes:
            zeros = c & 7
            size = 8 - (zeros if zeros < 4 else zeros + 1)
            x = look()[c >> 3] ^ int.from_bytes(data[at : at + size], "little")
            at += size
            out.append(x)
            learn(x)
        return np.array(out, np.uint64).view(np.float64)


class Gfc:
    """Sub-chunks of 32 values against the last of the sub-chunk before (``dim`` of them in turn).
    Four bits a value: the sign and the bytes of the difference, of which two count as three."""

    name, block, dtype = "gfc", 32 * 512, "f8"

    def __init__(self, dim: int = 1):
        self.dim = dim

    def _reference(self, x: np.ndarray, k: int) -> np.ndarray:
        lane = np.arange(32)
        return np.zeros(32, np.uint64) if not k else x[k - 32 + (32 - self.dim + lane % self.dim)]

    def encode(self, values) -> bytes:
        x = np.ascontiguousarray(values, np.float64).view(np.uint64)
        n = len(x)
        x = np.concatenate([x, np.zeros(-n % 32, np.uint64)])
        ref = np.concatenate([self._reference(x, k) for k in range(0, len(x), 32)] or [np.zeros(0, np.uint64)])
        d = x - ref
        negative = d >> np.uint64(63) > 0
        size = np.where(negative, ~d + np.uint64(1), d)
        bytes_ = size.astype("<u8").view(np.uint8).reshape(-1, 8)
        used = 8 - np.argmax(np.concatenate([bytes_[:, ::-1] != 0, np.ones((len(x), 1), bool)], 1), axis=1)
        used = np.where(used == 2, 3, used)
        code = np.where(negative, 8, 0) | np.where(used > 2, used - 1, used)
        packed = (code[0::2] << 4 | code[1::2]).astype(np.uint8)
        return struct.pack("<I", n) + packed.tobytes() + bytes_[np.arange(8) < used[:, None]].tobytes()

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (n,) = struct.unpack_from("<I", data)
        full = n + -n % 32
        packed = np.frombuffer(data, np.uint8, full // 2, 4)
        code = np.stack([packed >> 4, packed & 15], 1).ravel().astype(np.int64)
        used = np.where(code & 7 > 1, (code & 7) + 1, code & 7)
        bytes_ = np.zeros((full, 8), np.uint8)
        bytes_[np.arange(8) < used[:, None]] = np.frombuffer(data, np.uint8, int(used.sum()), 4 + full // 2)
        size = bytes_.view("<u8").ravel().astype(np.uint64)
        d = np.where(code & 8 > 0, ~size + np.uint64(1), size)
        x = np.zeros(full, np.uint64)
        for k in range(0, full, 32):
            x[k : k + 32] = d[k : k + 32] + self._reference(x, k)
        return x[:n].view(np.float64)


class ParallelFpc:
    """FPC in lanes: pieces of ``piece`` values are dealt out in turn, and each lane has predictors
    of its own, so lanes encode and decode apart."""

    name, block, dtype = "pfpc", 65536, "f8"

    def __init__(self, lanes: int = 4, piece: int = 1024, table_bits: int = 16):
        self.lanes, self.piece, self.one = lanes, piece, Fpc(table_bits)

    def _lane(self, n: int) -> np.ndarray:
        return np.arange(n) // self.piece % self.lanes

    def encode(self, values) -> bytes:
        v = np.ascontiguousarray(values, np.float64)
        parts = [self.one.encode(v[self._lane(len(v)) == k]) for k in range(self.lanes)]
        return struct.pack(f"<I{self.lanes}I", len(v), *map(len, parts)) + b"".join(parts)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        n, *sizes = struct.unpack_from(f"<I{self.lanes}I", data)
        out, at, lane = np.empty(n), 4 + 4 * self.lanes, self._lane(n)
        for k, size in enumerate(sizes):
            out[lane == k] = self.one.decode(data[at : at + size])
            at += size
        return out


class Mpc:
    """Chunks of 1024 words: differences ``dim`` back, the bit matrix of every word's number of bits
    transposed, differences of the words, and a bitmap of the words that are not zero, before those words."""

    block = 16384

    def __init__(self, dim: int = 1, kind: str = "f8"):
        self.dim, self.dtype = dim, kind
        self.name = "mpc" if kind == "f8" else "mpc_f32"
        self.float, self.word, self.bits = (np.float64, np.dtype("<u8"), 64) if kind == "f8" else (np.float32, np.dtype("<u4"), 32)

    def _transpose(self, x: np.ndarray) -> np.ndarray:
        grid = np.unpackbits(x.astype(self.word).view(np.uint8).reshape(-1, self.bits, self.bits // 8), axis=2, bitorder="little")
        return np.packbits(grid.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, self.bits // 8).view(self.word).ravel()

    def encode(self, values) -> bytes:
        x = np.ascontiguousarray(values, self.float).view(self.word)
        n = len(x)
        x = np.concatenate([x, np.zeros(-n % 1024, self.word)]).reshape(-1, 1024)
        y = x.copy()
        y[:, self.dim :] = x[:, self.dim :] - x[:, : -self.dim]
        z = self._transpose(y.ravel()).reshape(-1, 1024)
        z[:, 1:] = z[:, 1:] - z[:, :-1]
        z = z.ravel()
        return struct.pack("<IB", n, self.dim) + np.packbits(z != 0).tobytes() + z[z != 0].tobytes()

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        n, dim = struct.unpack_from("<IB", data)
        full = n + -n % 1024
        some = np.unpackbits(np.frombuffer(data, np.uint8, full // 8, 5)).astype(bool)
        z = np.zeros(full, self.word)
        z[some] = np.frombuffer(data, self.word, int(some.sum()), 5 + full // 8)
        y = self._transpose(np.cumsum(z.reshape(-1, 1024), axis=1, dtype=self.word).ravel()).reshape(-1, 1024)
        for lane in range(dim):
            y[:, lane::dim] = np.cumsum(y[:, lane::dim], axis=1, dtype=self.word)
        return np.ascontiguousarray(y.ravel()[:n]).view(self.float)
