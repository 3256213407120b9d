"""Stateful XOR codecs: each value against one of the values before it."""

from __future__ import annotations

import math
from bisect import bisect_right
from typing import NamedTuple

import numpy as np

# fixed values of the formats: leading zeros are rounded down to one of eight numbers
ROUNDED = (0, 8, 12, 16, 18, 20, 22, 24)
ROUNDED_32 = (0, 6, 10, 12, 14, 16, 18, 20)  # of the erasing codec over floats
NAN = 0x7FF8000000000000


class Form(NamedTuple):
    """What differs between doubles and floats."""

    width: int
    nan: int
    fraction: int  # bits of it
    digits: int  # the most significant digits that may be named
    rounded: tuple[int, ...]  # of the erasing codec
    most: int  # digits beyond which a value is no decimal

    @property
    def whole(self) -> int:
        return (1 << self.width) - 1

    def lead(self, x: int) -> int:
        return self.width - x.bit_length()

    def trail(self, x: int) -> int:
        return (x & -x).bit_length() - 1 if x else self.width

    def bits(self, values) -> list[int]:
        return np.ascontiguousarray(values, f"f{self.width // 8}").view(f"u{self.width // 8}").tolist()

    def floats(self, bits: list[int]) -> np.ndarray:
        return np.array(bits, f"u{self.width // 8}").view(f"f{self.width // 8}")


FORMS = {"f8": Form(64, NAN, 52, 15, ROUNDED, 17), "f4": Form(32, 0x7FC00000, 23, 7, ROUNDED_32, 9)}


def code_of(rounded: tuple[int, ...], zeros: int) -> int:
    """Which of eight numbers of leading zeros stands for this one."""
    return bisect_right(rounded, zeros) - 1


def lead(x: int) -> int:
    return FORMS["f8"].lead(x)


def trail(x: int) -> int:
    return FORMS["f8"].trail(x)


class Writer:
    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def done(self) -> bytes:
        bits = "".join(self.parts)
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


class Reader:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(format(b, "08b") for b in data), 0

    def get(self, n: int) -> int:
        self.at += n
        return int(self.bits[self.at - n : self.at], 2) if n else 0


_bits, _floats = FORMS["f8"].bits, FORMS["f8"].floats


class Gorilla:
    """Each value against the last: 0 for equal, 10 and the old window, or 11, a new window (5
    bits of leading zeros, 6 of length) and its bits. A NaN ends the stream, so values that
    are NaN are not taken."""

    name, block, dtype = "gorilla", 16384, "f8"

    def encode(self, values) -> bytes:
        out, last, window = Writer(), None, None
        if np.isnan(values).any():
            raise ValueError("NaN ends a stream of this codec; filter it first")
        for x in [*_bits(values), NAN]:
            if last is None:
                out.put(x, 64)
            elif not (d := x ^ last):
                out.put(0, 1)
            else:
                a, b = min(lead(d), 31), trail(d)
                if window and a >= window[0] and b >= window[1]:
                    out.put(2, 2)
                    out.put(d >> window[1], 64 - sum(window))
                else:
                    window = a, b
                    out.put(3, 2)
                    out.put(a, 5)
                    out.put((64 - a - b) & 63, 6)
                    out.put(d >> b, 64 - a - b)
            last = x
        return out.done()

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        src, window = Reader(data), None
        found = [src.get(64)]
        while found[-1] != NAN:
            x = found[-1]
            if src.get(1):
                if src.get(1):
                    a, size = src.get(5), src.get(6) or 64
                    window = a, 64 - a - size
                x ^= src.get(64 - sum(window)) << window[1]
            found.append(x)
        return _floats(found[:-1])


class Chimp:
    """Each value against one of the last 128 that ends in the same bits, if the XOR then ends in
    more than 13 zeros, or against the last."""

    block, previous = 1024, 128

    def __init__(self, kind: str = "f8"):
        self.dtype, self.form = kind, FORMS[kind]
        self.name = "chimp128" if kind == "f8" else "chimp128_f32"
        self.size_bits = 6 if kind == "f8" else 5
        self.low = self.size_bits + 7  # 7: log2(128)

    def encode(self, values) -> bytes:
        if np.isnan(values).any():
            raise ValueError("NaN ends a stream of this codec; filter it first")
        out, ring, seen, held, form = Writer(), [0] * self.previous, {}, None, self.form
        for k, x in enumerate([*form.bits(values), form.nan]):
            key = x & ((1 << (self.low + 1)) - 1)
            if not k:
                out.put(x, form.width)
            else:
                ref, tz = (k - 1) % self.previous, 0
                at = seen.get(key, 0)  # an unseen key stands for the first value
                if (k - 1) - at < self.previous and (t := form.trail(x ^ ring[at % self.previous])) > self.low:
                    ref, tz = at % self.previous, t
                d = x ^ ring[ref]
                if not d:
                    out.put(0, 2)
                    out.put(ref, 7)
                    held = None
                elif tz > self.low:
                    code = code_of(ROUNDED, form.lead(d))
                    size = form.width - ROUNDED[code] - tz
                    out.put(1, 2)
                    out.put(ref, 7)
                    out.put(code, 3)
                    out.put(size, self.size_bits)
                    out.put(d >> tz, size)
                    held = None
                else:
                    code = code_of(ROUNDED, form.lead(d))
                    if code == held:
                        out.put(2, 2)
                    else:
                        out.put(3, 2)
                        out.put(code, 3)
                        held = code
                    out.put(d, form.width - ROUNDED[code])
            ring[k % self.previous] = x
            seen[key] = k
        return out.done()

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        src, held, form = Reader(data), None, self.form
        found = [src.get(form.width)]
        while found[-1] != form.nan:
            k, flag = len(found), src.get(2)
            if flag < 2:
                at = src.get(7)
                ref = next(j for j in range(k - 1, max(-1, k - 1 - self.previous), -1) if j % self.previous == at)
                if flag:
                    code, size = src.get(3), src.get(self.size_bits)
                    found.append(found[ref] ^ (src.get(size) << (form.width - ROUNDED[code] - size)))
                else:
                    found.append(found[ref])
            else:
                if flag == 3:
                    held = src.get(3)
                found.append(found[-1] ^ src.get(form.width - ROUNDED[held]))
        return form.floats(found[:-1])


class Patas:
    """Byte-aligned: for each value 16 bits (7: how far back the reference is, 3: bytes, 6:
    trailing zeros) and the significant bytes of the XOR."""

    name, block, dtype = "patas", 1024, "f8"
    previous, low = 128, 14

    def encode(self, values) -> bytes:
        xs, meta, body, seen = _bits(values), [], [], {}
        for k, x in enumerate(xs):
            key = x & ((1 << self.low) - 1)
            if not k:
                body.append(x.to_bytes(8, "little"))
                meta.append(0)
            else:
                at = seen.get(key, 0)
                ref = at if k - at < self.previous else k - 1
                d = x ^ xs[ref]
                tz = trail(d) if d else 63
                size = -(-(d.bit_length() - tz) // 8) if d else 0
                body.append((d >> tz).to_bytes(size, "little"))
                meta.append((k - ref) << 9 | (size & 7) << 6 | tz)
            seen[key] = k
        return len(xs).to_bytes(4, "little") + np.array(meta, "<u2").tobytes() + b"".join(body)

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        n = int.from_bytes(data[:4], "little")
        meta, at, out = np.frombuffer(data, "<u2", n, 4).tolist(), 4 + 2 * n, []
        for k, m in enumerate(meta):
            if not k:
                out.append(int.from_bytes(data[at : at + 8], "little"))
                at += 8
                continue
            back, size, tz = m >> 9, m >> 6 & 7, m & 63
            size = 8 if not size and tz < 63 else size  # eight bytes wrap to none; an equal value has 63
            out.append(out[k - back] ^ (int.from_bytes(data[at : at + size], "little") << tz))
            at += size
        return _floats(out)


def start(v: float) -> int:
    """floor(log10(v)), exact at powers of ten."""
    k = math.floor(math.log10(v))
    return k + 1 if float(f"1e{k + 1}") <= v else k - 1 if float(f"1e{k}") > v else k


def significant(v: float, form: Form = FORMS["f8"]) -> tuple[int, int]:
    """(decimal places, significant digits) of |v|; the digits are 0 for a power of ten below one and 17 (of
    floats 9) if none suffice. A float has the fewest places whose rounding is nearest to it among floats."""
    sp, single = start(v), form.width == 32
    for places in range(max(0, -sp), form.most - sp):
        if places > 300:
            break
        power = float(f"1e{places}")
        scaled = v * power
        if single:
            ten, found = float(np.float32(f"1e{sp}")), float(np.float32(round(scaled) / power))
        else:
            ten, found = float(f"1e{sp}"), v if scaled == math.trunc(scaled) and scaled / power == v else None
        if found == v:
            return places, 0 if v < 1 and v == ten else sp + places + 1
    return form.most - sp - 1, form.most


def erased(values, form: Form) -> list[tuple[int, int | None]]:
    """(bits that are kept, digits that give the rest back or null) of each value."""
    out, bias = [], (1 << (form.width - form.fraction - 2)) - 1
    for v, x in zip(np.asarray(values).tolist(), form.bits(values)):
        kept, digits = x, None
        if v and math.isfinite(v):
            places, found = significant(abs(v), form)
            exponent = (x >> form.fraction & (2 * bias + 1)) - bias
            erase = form.fraction - (math.ceil(places * math.log2(10)) + exponent)
            low = (1 << erase) - 1 if form.digits.bit_length() < erase <= form.fraction else 0
            if x & low and found <= form.digits and elf_restore(x & ~low, found, form) == x:
                kept, digits = x & ~low, found
        out.append((kept, digits))
    return out


class Elf:
    """Low bits that the number of significant digits gives back are erased before the XOR.

    For each value: 10 if nothing is erased, 0 if the digits' number is the last one, or 11
    and its bits (four, of floats three); then the XOR code of what is left."""

    block, names = 1000, ("elf", "elf_f32")

    def __init__(self, kind: str = "f8"):
        self.dtype, self.form = kind, FORMS[kind]
        self.name = self.names[kind == "f4"]

    def encode(self, values) -> bytes:
        if np.isnan(values).any():
            raise ValueError("this codec takes no NaN; filter it first")
        return self._put(erased(values, self.form))

    def decode(self, data: bytes, n: int | None = None) -> np.ndarray:
        src, digits, out = Reader(data), None, []
        n = src.get(32)
        xor = self._xor(src)
        for _ in range(n):
            whole = False
            if src.get(1):
                if src.get(1):
                    digits = src.get(self.form.digits.bit_length())
                else:
                    whole = True
            x = xor.get()
            out.append(x if whole else elf_restore(x, digits, self.form))
        return self.form.floats(out)

    def _put(self, rows: list[tuple[int, int | None]]) -> bytes:
        out, last_digits = Writer(), None
        out.put(len(rows), 32)
        xor = self._xor(out, rows)
        for kept, digits in rows:
            if digits is None:
                out.put(2, 2)
            elif digits == last_digits:
                out.put(0, 1)
            else:
                out.put(3, 2)
                out.put(digits, self.form.digits.bit_length())
                last_digits = digits
            xor.put(kept)
        return out.done()

    def _xor(self, io, rows=None):
        return _ElfXor(io, self.form)


def elf_restore(kept: int, digits: int, form: Form = FORMS["f8"]) -> int:
    """The value with that many significant digits that lies next above (in size) the erased one."""
    v = float(form.floats([kept])[0])
    size = abs(v)
    if not size:
        return kept
    sp = start(size)
    if not digits:
        found = float(f"1e{sp + 1}")
    else:
        places = digits - sp - 1
        found = math.ceil(size * float(f"1e{places}")) / float(f"1e{places}") if 0 <= places <= 300 else size
    with np.errstate(over="ignore"):
        return form.bits(np.array([math.copysign(found, v)]))[0]


class _ElfXor:
    """01 for equal, 00 for the window before, 1 and a new window: three bits of rounded leading
    zeros, and the centre's length in few bits (10) or in more (11)."""

    def __init__(self, io, form: Form):
        self.io, self.form, self.last, self.code, self.tz = io, form, None, None, None
        self.short, self.long = (4, 6) if form.width == 64 else (3, 5)

    def _centre(self) -> int:
        return self.form.width - self.form.rounded[self.code] - self.tz

    def put(self, x: int) -> None:
        out, form = self.io, self.form
        if self.last is None:
            tz = form.trail(x)
            out.put(tz, form.width.bit_length())
            out.put(x >> (tz + 1), max(0, form.width - 1 - tz))
        elif not (d := x ^ self.last):
            out.put(1, 2)
        else:
            code, tz = code_of(form.rounded, form.lead(d)), form.trail(d)
            if code == self.code and tz >= self.tz:
                out.put(0, 2)
            else:
                self.code, self.tz = code, tz
                few = self._centre() <= 1 << self.short
                out.put(2 if few else 3, 2)
                out.put(code, 3)
                out.put(self._centre(), self.short if few else self.long)
            out.put(d >> self.tz, self._centre())
        self.last = x

    def get(self) -> int:
        src, width = self.io, self.form.width
        if self.last is None:
            tz = src.get(width.bit_length())
            self.last = (src.get(width - 1 - tz) << 1 | 1) << tz if tz < width else 0
            return self.last
        flag = src.get(2)
        if flag == 1:
            return self.last
        if flag:
            self.code = src.get(3)
            bits = self.short if flag == 2 else self.long
            self.tz = width - self.form.rounded[self.code] - (src.get(bits) or 1 << bits)
        self.last ^= src.get(self._centre()) << self.tz
        return self.last


def offices(counts: list[int], most_bits: int = 5) -> list[int]:
    """Positions to which the numbers below 64 are rounded down, 0 first: those that cost least in all, counted
    in bits: the bits of a position's name for every number, and the bits that rounding loses."""
    used = [k for k, n in enumerate(counts) if n or not k]
    total = sum(counts)
    best: tuple[int, list[int]] | None = None
    for bits in range(most_bits + 1):
        wanted = min(1 << bits, len(used))
        # cost[i]: the least for numbers below used[i], which is the last position so far
        loss = lambda a, b: sum(counts[k] * (k - used[a]) for k in range(used[a], used[b] if b < len(used) else len(counts)))
        cost, back = {0: 0}, [{0: -1}]
        for _ in range(1, wanted):
            new, via = {}, {}
            for i in range(1, len(used)):
                options = [(c + loss(a, i), a) for a, c in cost.items() if a < i]
                if options:
                    new[i], via[i] = min(options)
            cost = new
            back.append(via)
        least, last = min((c + loss(i, len(used)), i) for i, c in cost.items())
        if best is None or least + total * bits < best[0]:
            chosen = []
            for via in reversed(back):
                chosen.append(used[last])
                last = via[last]
            best = least + total * bits, chosen[::-1]
        if wanted == len(used):
            break
    return best[1]


class ElfStar(Elf):
    """The erasing codec in two passes: the numbers of leading and trailing zeros that occur decide
    to which positions they are rounded, and the tables stand before the values."""

    names = "elf_star", "elf_star_f32"

    def _xor(self, io, rows=None):
        if rows is None:
            return _StarXor(io, tuple([io.get(6) for _ in range(io.get(6))] for _ in range(2)), self.form)
        leads, trails = [0] * self.form.width, [0] * self.form.width
        for (before, _), (kept, _) in zip(rows, rows[1:]):
            if d := kept ^ before:
                leads[self.form.lead(d)] += 1
                trails[self.form.trail(d)] += 1
        tables = offices(leads), offices(trails)
        for table in tables:
            io.put(len(table), 6)
            for p in table:
                io.put(p, 6)
        return _StarXor(io, tables, self.form)


class _StarXor:
    """01 for equal, 1 for the window before, 00 and the names of a new window's two positions."""

    def __init__(self, io, tables, form: Form):
        self.io, self.tables, self.form, self.last, self.window = io, tables, form, None, None
        self.bits = [(len(t) - 1).bit_length() for t in tables]

    def _round(self, which: int, z: int) -> int:
        return max(k for k, p in enumerate(self.tables[which]) if p <= z)

    def put(self, x: int) -> None:
        out, lead, trail = self.io, self.form.lead, self.form.trail
        if self.last is None:
            out.put(x, self.form.width)
        elif not (d := x ^ self.last):
            out.put(1, 2)
        else:
            a, b = self._round(0, lead(d)), self._round(1, trail(d))
            fits = self.window is not None and lead(d) >= self.tables[0][self.window[0]] and trail(d) >= self.tables[1][self.window[1]]
            same = fits and sum(self.tables[k][self.window[k]] for k in (0, 1)) + sum(self.bits) + 1 >= self.tables[0][a] + self.tables[1][b]
            if same:
                out.put(1, 1)
            else:
                self.window = a, b
                out.put(0, 2)
                out.put(a, self.bits[0])
                out.put(b, self.bits[1])
            tz = self.tables[1][self.window[1]]
            out.put(d >> tz, self.form.width - self.tables[0][self.window[0]] - tz)
        self.last = x

    def get(self) -> int:
        src = self.io
        if self.last is None:
            self.last = src.get(self.form.width)
            return self.last
        if not src.get(1):
            if src.get(1):
                return self.last
            self.window = src.get(self.bits[0]), src.get(self.bits[1])
        tz = self.tables[1][self.window[1]]
        self.last ^= src.get(self.form.width - self.tables[0][self.window[0]] - tz) << tz
        return self.last
