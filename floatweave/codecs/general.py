"""Byte codecs of Arrow, over the values' bytes in chunks of 64 KiB."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

CHUNK = 65536


class ByteCodec:
    block, dtype = 65536, "f8"

    def __init__(self, codec: str):
        self.codec, self.name = codec, codec

    def encode(self, values) -> bytes:
        raw = np.ascontiguousarray(values, np.float64).tobytes()
        parts = [pa.compress(raw[k : k + CHUNK], codec=self.codec, asbytes=True) for k in range(0, len(raw), CHUNK)]
        return struct.pack(f"<I{len(parts)}I", len(raw), *map(len, parts)) + b"".join(parts)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (size,) = struct.unpack_from("<I", data)
        lens = struct.unpack_from(f"<{-(-size // CHUNK)}I", data, 4)
        at, out = 4 + 4 * len(lens), []
        for k, m in enumerate(lens):
            out.append(pa.decompress(data[at : at + m], decompressed_size=min(CHUNK, size - k * CHUNK), codec=self.codec, asbytes=True))
            at += m
        return np.frombuffer(b"".join(out), np.float64)


class Spdp:
    """Bytes of all values less the byte two before, dealt out by their place in a value, less the byte
    before, and then repeats by LZ4 (the published codec ends in a finder of repeats of its own)."""

    block = 65536

    def __init__(self, kind: str = "f8"):
        self.dtype, self.name = kind, "spdp" if kind == "f8" else "spdp_f32"

    @staticmethod
    def transform(raw: np.ndarray) -> np.ndarray:
        raw = raw.copy()
        raw[2:] -= raw[:-2].copy()
        dealt = np.concatenate([raw[k::8] for k in range(8)])
        return np.diff(dealt, prepend=np.uint8(0))

    @staticmethod
    def invert(data: np.ndarray) -> np.ndarray:
        dealt, raw, at = np.cumsum(data, dtype=np.uint8), np.zeros(len(data), np.uint8), 0
        for k in range(8):
            size = len(raw[k::8])
            raw[k::8] = dealt[at : at + size]
            at += size
        for k in range(2):
            raw[k::2] = np.cumsum(raw[k::2], dtype=np.uint8)
        return raw

    def encode(self, values) -> bytes:
        raw = np.ascontiguousarray(values, self.dtype).view(np.uint8)
        return struct.pack("<I", len(raw)) + (pa.compress(self.transform(raw).tobytes(), codec="lz4", asbytes=True) if len(raw) else b"")

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (size,) = struct.unpack_from("<I", data)
        if not size:
            return np.zeros(0, self.dtype)
        own = pa.decompress(data[4:], decompressed_size=size, codec="lz4", asbytes=True)
        return self.invert(np.frombuffer(own, np.uint8)).view(self.dtype)


def codecs() -> list:
    return [*(ByteCodec(c) for c in ("lz4", "snappy", "gzip", "zstd")), Spdp(), Spdp("f4")]
