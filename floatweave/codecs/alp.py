"""Decimal scaling with exceptions, and the two-part form for values that are no decimals.

A value v becomes rint(v * 10^e * 10^-f); if i * 10^f * 10^-e gives v back, the
integer stands for it in a frame of reference, else it is an exception. Samples
of a row group choose up to five (e, f); each vector of 1024 takes the best.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from .integers import pack, unpack

# fixed values of the format
VECTOR, GROUP, SAMPLES, CANDIDATES, MAX_E = 1024, 100, 32, 5, 18
STEP = 12  # every twelfth vector of a group is sampled
POSITION_BITS = 16
LIMIT = 9223372036854774784.0
MAGIC = 6755399441055744.0
POWERS = np.array([float(f"1e{k}") for k in range(MAX_E + 1)])
INVERSES = np.array([float(f"1e-{k}") for k in range(MAX_E + 1)])


class Form(NamedTuple):
    """What differs between doubles and floats; ``two_part``: bits a sampled value from which on the two-part form is taken."""

    width: int
    max_e: int
    two_part: int
    integers: float  # bound of the integers' size
    magic: np.floating
    powers: np.ndarray
    inverses: np.ndarray


FORMS = {
    "f8": Form(64, MAX_E, 48, LIMIT, np.float64(MAGIC), POWERS, INVERSES),
    "f4": Form(32, 10, 22, 2147483520.0, np.float32(12582912.0), POWERS[:11].astype("f4"), INVERSES[:11].astype("f4")),
}


def form_of(v: np.ndarray) -> Form:
    return FORMS["f4" if v.dtype.itemsize == 4 else "f8"]


def scaled(v: np.ndarray, e: int, f: int) -> tuple[np.ndarray, np.ndarray]:
    """(integers, which of them give their value back)."""
    form = form_of(v)
    with np.errstate(all="ignore"):
        t = v * form.powers[e] * form.inverses[f]
        ok = np.isfinite(v) & (np.abs(t) <= form.integers) & ~((v == 0) & np.signbit(v))
        q = np.where(ok, (np.where(ok, t, t.dtype.type(0)) + form.magic) - form.magic, 0)
        ok &= np.abs(q) < 2.0 ** (form.width - 1)
        q = np.where(ok, q, 0).astype(np.int64)
        ok &= unscaled(q, e, f, form) == v
    return q, ok


def unscaled(q: np.ndarray, e: int, f: int, form: Form = FORMS["f8"]) -> np.ndarray:
    return q.astype(form.powers.dtype) * form.powers[f] * form.inverses[e]


def estimate(v: np.ndarray, e: int, f: int) -> tuple[int, int]:
    """(bits, values that are no exceptions) of a sample."""
    q, ok = scaled(v, e, f)
    exception = form_of(v).width + POSITION_BITS
    if not ok.any():
        return len(v) * exception, 0
    bits = (int(q[ok].max()) - int(q[ok].min())).bit_length()
    return len(v) * bits + int((~ok).sum()) * exception, int(ok.sum())


def best_pair(sample: np.ndarray) -> tuple[int, int, int]:
    """(e, f, estimated bits): the least bits, then the larger e, then the larger f; at least two values must fit."""
    form = form_of(sample)
    best = (len(sample) * (2 * form.width + POSITION_BITS), 0, 0)
    for e in range(form.max_e, -1, -1):
        for f in range(e, -1, -1):
            bits, fit = estimate(sample, e, f)
            if fit >= 2 and (bits, -e, -f) < best:
                best = (bits, -e, -f)
    return -best[1], -best[2], best[0]


def sampled(v: np.ndarray) -> list[np.ndarray]:
    """Of every twelfth whole vector of a row group, 32 values at equal distances."""
    whole = [v[k * VECTOR : (k + 1) * VECTOR] for k in range(0, -(-len(v) // VECTOR), STEP)]
    return [w[:: VECTOR // SAMPLES] for w in whole if len(w) == VECTOR] or [v[:SAMPLES]]


def choose(v: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """((e, f) candidates of a row group, most frequent first; whether it takes the two-part form)."""
    found: dict[tuple[int, int], int] = {}
    form = form_of(v)
    least = SAMPLES * (2 * form.width + POSITION_BITS)
    for s in sampled(v):
        e, f, bits = best_pair(s)
        found[e, f] = found.get((e, f), 0) + 1
        least = min(least, bits)
    ranked = sorted(found, key=lambda c: (-found[c], -c[0], -c[1]))
    return ranked[:CANDIDATES], least >= form.two_part * SAMPLES


def pair_of(v: np.ndarray, candidates: list[tuple[int, int]]) -> tuple[int, int]:
    """The candidate for one vector: two in a row that are no better end the search."""
    sample, best, worse = v[:: max(1, len(v) // SAMPLES)], None, 0
    for e, f in candidates:
        q, ok = scaled(sample, e, f)
        bits = (int(q[ok].max()) - int(q[ok].min())).bit_length() if ok.any() else 0
        size = SAMPLES * bits + int((~ok).sum()) * (form_of(v).width + POSITION_BITS)
        if best is None:
            best = size, e, f
        elif size >= best[0]:
            worse += 1
            if worse == 2:
                break
        else:
            best, worse = (size, e, f), 0
    return best[1:] if best else (0, 0)


class Alp:
    block = VECTOR * GROUP

    def __init__(self, kind: str = "f8"):
        self.dtype, self.form = kind, FORMS[kind]
        self.name = "alp" if kind == "f8" else "alp_f32"

    def encode(self, values) -> bytes:
        v = np.ascontiguousarray(values, self.dtype)
        return self._encode(v, choose(v)[0] if len(v) else [])

    def _encode(self, v: np.ndarray, candidates: list[tuple[int, int]]) -> bytes:
        out = [struct.pack("<I", len(v))]
        for k in range(0, len(v), VECTOR):
            one = v[k : k + VECTOR]
            e, f = pair_of(one, candidates)
            q, ok = scaled(one, e, f)
            q = np.where(ok, q, q[ok][0] if ok.any() else 0)
            base, bits = int(q.min()), (int(q.max()) - int(q.min())).bit_length()
            at = np.flatnonzero(~ok)
            out += [struct.pack("<BBBqH", e, f, bits, base, len(at)), pack(q, base, bits), at.astype("<u2").tobytes(), one[at].tobytes()]
        return b"".join(out)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (n,) = struct.unpack_from("<I", data)
        at, out = 4, []
        for k in range(0, n, VECTOR):
            count = min(VECTOR, n - k)
            e, f, bits, base, bad = struct.unpack_from("<BBBqH", data, at)
            at += 13
            size = -(-count * bits // 8)
            v = unscaled(unpack(data[at : at + size], count, base, bits), e, f, self.form)
            at += size
            v[np.frombuffer(data, "<u2", bad, at)] = np.frombuffer(data, "<" + self.dtype, bad, at + 2 * bad)
            at += (2 + self.form.width // 8) * bad
            out.append(v)
        return np.concatenate(out) if out else np.zeros(0, self.dtype)


class AlpRd:
    """The upper 1 to 16 bits through a dictionary of at most eight, the rest as they are."""

    block = VECTOR * GROUP

    def __init__(self, kind: str = "f8"):
        self.dtype, self.form = kind, FORMS[kind]
        self.name = "alp_rd" if kind == "f8" else "alp_rd_f32"

    @staticmethod
    def dictionary(bits: np.ndarray, right: int) -> tuple[np.ndarray, int, float]:
        """(left parts kept, bits of an index, estimated bits a value); ties in frequency go to the smaller part."""
        left, n = np.unique(bits >> np.uint64(right), return_counts=True)
        order = np.lexsort((left, -n))
        kept = left[order[:8]]
        width = max(1, (len(kept) - 1).bit_length())
        return kept, width, right + width + n[order[8:]].sum() * 32 / len(bits)

    def encode(self, values) -> bytes:
        bits = np.ascontiguousarray(values, self.dtype).view(f"u{self.form.width // 8}").astype(np.uint64)
        if not len(bits):
            return struct.pack("<I", 0)
        sample = np.concatenate(sampled(bits))
        right = min(range(self.form.width - 1, self.form.width - 17, -1), key=lambda r: (self.dictionary(sample, r)[2], -r))
        kept, width, _ = self.dictionary(sample, right)
        out = [struct.pack("<IBBB", len(bits), right, width, len(kept)), kept.astype("<u2").tobytes()]
        place = {int(x): k for k, x in enumerate(kept)}
        left = (bits >> np.uint64(right)).tolist()
        at = np.array([k for k, x in enumerate(left) if x not in place], np.int64)
        index = np.array([place.get(x, 0) for x in left], np.int64)
        low = (bits & np.uint64((1 << right) - 1)).view(np.int64)
        out += [pack(index, 0, width), pack(low, 0, right), struct.pack("<I", len(at)), at.astype("<u4").tobytes(), np.array([left[k] for k in at], "<u2").tobytes()]
        return b"".join(out)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        (n,) = struct.unpack_from("<I", data)
        if not n:
            return np.zeros(0, self.dtype)
        right, width, kept_n = struct.unpack_from("<BBB", data, 4)
        kept = np.frombuffer(data, "<u2", kept_n, 7).astype(np.uint64)
        at = 7 + 2 * kept_n
        size = -(-n * width // 8)
        left = kept[unpack(data[at : at + size], n, 0, width)]
        at += size
        size = -(-n * right // 8)
        low = unpack(data[at : at + size], n, 0, right).view(np.uint64)
        at += size
        (bad,) = struct.unpack_from("<I", data, at)
        left[np.frombuffer(data, "<u4", bad, at + 4)] = np.frombuffer(data, "<u2", bad, at + 4 + 4 * bad)
        return (left << np.uint64(right) | low).astype(f"u{self.form.width // 8}").view(self.dtype)


class AlpChosen:
    """The form that the first-level sample of a row group asks for: decimal, or in two parts. One byte says which."""

    block = VECTOR * GROUP

    def __init__(self, kind: str = "f8"):
        self.dtype, self.form = kind, FORMS[kind]
        self.name = "alp_chosen" if kind == "f8" else "alp_chosen_f32"

    def encode(self, values) -> bytes:
        v = np.ascontiguousarray(values, self.dtype)
        candidates, two_part = choose(v) if len(v) else ([], False)
        return b"\1" + AlpRd(self.dtype).encode(v) if two_part else b"\0" + Alp(self.dtype)._encode(v, candidates)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        return (AlpRd if data[0] else Alp)(self.dtype).decode(data[1:], n)


class AlpLocal:
    """Vectors of 1000, each with a pair of its own and a mode of its own: where over a fifth of the
    values would be exceptions the vector takes the two-part form."""

    name, block, dtype = "alp_local", 1000, "f8"

    def encode(self, values) -> bytes:
        v = np.ascontiguousarray(values, np.float64)
        if not len(v):
            return b"\0" + Alp().encode(v)
        e, f, _ = best_pair(v[:: max(1, len(v) // SAMPLES)][:SAMPLES])
        exceptions = int((~scaled(v, e, f)[1]).sum())
        return b"\1" + AlpRd().encode(v) if 5 * exceptions > len(v) else b"\0" + Alp()._encode(v, [(e, f)])

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        return (AlpRd() if data[0] else Alp()).decode(data[1:], n)
