"""The bit-plane codec: decimals to integers, differences, and their bit planes.

A block is cut into chunks of a base value and up to 1024 differences. A chunk
is a header (size in bits, first value, alpha, beta, number of planes, flags)
and the planes from the highest bit down, each dense or, if that is shorter, as
a bitmap of its non-zero bytes and those bytes. Little-endian throughout.
"""

from __future__ import annotations

import struct

import numpy as np

CHUNK = 1025
# fixed values of the formats: digits a chunk may use, mark for "not decimal", least error, header
FORMS = {
    "f8": {"digits": 15, "none": 23, "ulp": 2.0**-52, "magic": 6755399441055744.0, "float": np.float64, "uint": np.uint64, "int": np.int64, "bits": 64, "head": struct.Struct("<QqBBBQ")},
    "f4": {"digits": 6, "none": 17, "ulp": 2.0**-23, "magic": 12582912.0, "float": np.float32, "uint": np.uint32, "int": np.int32, "bits": 32, "head": struct.Struct("<IiBBBI")},
}


def half_away(x: np.ndarray) -> np.ndarray:
    whole = np.trunc(x)
    return whole + np.sign(x) * (np.abs(x - whole) >= 0.5)


def decimal_places(v: np.ndarray, form: dict, signed_zeros: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(places, start position) of each value; the position of zero is -99. Without ``signed_zeros`` a
    negative zero is as good as zero."""
    kind = form["float"]
    limit = 15 if kind is np.float64 else 7
    with np.errstate(all="ignore"):
        size = np.abs(v)
        sp = np.where((v == 0) | ~np.isfinite(v), -99, np.floor(np.log10(np.where(size == 0, 1, size).astype(np.float64)))).astype(np.int64)
        places = np.full(v.shape, -1)
        top = 16 if limit == 15 else 9
        for d in range(top + 1):
            p = kind(10.0**d)
            t = v * p
            stop = (np.abs(t - ((t + kind(form["magic"])) - kind(form["magic"]))) < size * kind(form["ulp"]) * p) | (sp >= limit - d)
            back = half_away(t) / p == v
            places = np.where((places < 0) & stop, np.where(back, d, form["none"]), places)
        places = np.where(places < 0, form["none"], places)
        places = np.where(v == 0, np.where(np.signbit(v) & signed_zeros, form["none"], 0), places)
    return np.where(np.isfinite(v), places, form["none"]), sp


def quantize(v: np.ndarray, form: dict, signed_zeros: bool = True) -> tuple[int, int, bool, np.ndarray]:
    """(alpha, beta, raw, integers as unsigned) of one chunk."""
    places, sp = decimal_places(v, form, signed_zeros)
    alpha, beta = int(places.max()), int(sp.max()) + int(places.max()) + 1
    raw = alpha > form["digits"] or beta > form["digits"]
    if raw:
        bits = v.view(form["uint"])
        return alpha, beta, True, (bits << form["uint"](1)) ^ (bits.view(form["int"]) >> form["int"](form["bits"] - 1)).view(form["uint"])
    return alpha, beta, False, half_away(v * form["float"](10.0**alpha)).astype(form["int"]).view(form["uint"])


def restore(q: np.ndarray, alpha: int, raw: bool, form: dict) -> np.ndarray:
    if not raw:
        return q.view(form["int"]).astype(form["float"]) / form["float"](10.0**alpha)
    one = form["uint"](1)
    sign = q & one
    return ((q >> one) ^ (np.where(sign > 0, ~form["uint"](0), form["uint"](0)) >> one) | (sign << form["uint"](form["bits"] - 1))).view(form["float"])


class PlaneCodec:
    """``signed_zeros`` False is the published format: decimal chunks give negative zeros back as zeros."""

    def __init__(self, kind: str = "f8", policy: str = "adaptive", signed_zeros: bool = True):
        self.form, self.policy, self.signed_zeros = FORMS[kind], policy, signed_zeros
        self.name = "planes" + ("" if kind == "f8" else "_f32") + ("" if policy == "adaptive" else f"_{policy}") + ("" if signed_zeros else "_unsigned")
        self.block, self.dtype = CHUNK * 16, kind

    def encode(self, values: np.ndarray) -> bytes:
        values = np.ascontiguousarray(values, self.form["float"])
        return b"".join(self._chunk(values[k : k + CHUNK]) for k in range(0, len(values), CHUNK))

    def _chunk(self, v: np.ndarray) -> bytes:
        form = self.form
        alpha, beta, raw, q = quantize(v, form, self.signed_zeros)
        step = q[1:] - q[:-1]  # wraps
        zz = (step << form["uint"](1)) ^ (step.view(form["int"]) >> form["int"](form["bits"] - 1)).view(form["uint"])
        width = max(1, int(np.bitwise_or.reduce(zz)).bit_length()) if len(zz) else 1
        nb = -(-len(zz) // 8)
        grid = np.unpackbits(zz.astype(zz.dtype.newbyteorder(">")).view(np.uint8).reshape(len(zz), form["bits"] // 8), axis=1)
        planes = np.packbits(grid[:, form["bits"] - width :].T, axis=1) if nb else np.zeros((width, 0), np.uint8)
        used = np.count_nonzero(planes, axis=1)
        sparse = {"adaptive": -(-nb // 8) + used < nb, "dense": used < 0, "sparse": used >= 0}[self.policy]
        body, flags = [], 0
        for k in range(width):
            if sparse[k]:
                flags |= 1 << k
                body += (np.packbits(planes[k] != 0, bitorder="little").tobytes(), planes[k][planes[k] != 0].tobytes())
            else:
                body.append(planes[k].tobytes())
        data = b"".join(body)
        first = int(q[:1].view(form["int"])[0])
        return form["head"].pack(8 * (form["head"].size + len(data)), first, alpha, beta & 255, width, flags) + data

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        """``n``: the number of values; without it every chunk but the last must be whole, and a
        last chunk whose length is no multiple of eight gets up to seven values more."""
        out, at = [], 0
        left = n
        while at < len(data):
            size = self.form["head"].unpack_from(data, at)[0] // 8
            count = CHUNK if left is None else min(CHUNK, left)
            out.append(self._unchunk(data[at : at + size], count))
            at += size
            left = None if left is None else left - count
        return np.concatenate(out) if out else np.zeros(0, self.form["float"])

    def _unchunk(self, data: bytes, n: int) -> np.ndarray:
        form = self.form
        _, first, alpha, beta, width, flags = form["head"].unpack_from(data)
        if not 0 < width <= form["bits"]:
            raise ValueError("a chunk with an impossible number of planes")
        raw = alpha > form["digits"] or beta > form["digits"] and beta < 128  # a negative beta wraps in its byte
        at, nb = form["head"].size, -(-(n - 1) // 8)
        planes = np.zeros((width, nb), np.uint8)
        body = np.frombuffer(data, np.uint8)
        for k in range(width):
            if flags >> k & 1:
                some = np.unpackbits(body[at : at + -(-nb // 8)], bitorder="little")[:nb].astype(bool)
                at += -(-nb // 8)
                planes[k, some] = body[at : at + int(some.sum())]
                at += int(some.sum())
            else:
                planes[k] = body[at : at + nb]
                at += nb
        grid = np.zeros((n - 1, form["bits"]), np.uint8)
        grid[:, form["bits"] - width :] = np.unpackbits(planes, axis=1)[:, : n - 1].T
        zz = np.packbits(grid, axis=1).view(np.dtype(form["uint"]).newbyteorder(">")).astype(form["uint"]).ravel() if n > 1 else np.zeros(0, form["uint"])
        step = (zz >> form["uint"](1)) ^ (np.zeros_like(zz) - (zz & form["uint"](1)))
        q = np.cumsum(np.concatenate([np.array([first], form["int"]).view(form["uint"]), step]), dtype=form["uint"])
        return restore(q, alpha, raw, form)
