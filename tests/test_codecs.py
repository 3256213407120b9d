"""Every codec gives every block back, bit for bit."""

import numpy as np
import pytest

from floatweave.codecs import registry
from floatweave.codecs.grid import GridCodec
from floatweave.codecs.planes import CHUNK, FORMS, PlaneCodec, decimal_places
from floatweave.codecs.predict import Fpc, Gfc, Mpc
from floatweave.codecs.xor import FORMS as XOR_FORMS
from floatweave.codecs.xor import offices, significant
from floatweave.operators.compress import NO_NAN

CODECS = registry()


def blocks():
    rng = np.random.default_rng(7)
    walk = np.round(np.cumsum(rng.normal(size=3000)), 2)
    yield "empty_but_one", np.array([1.25])
    yield "chunk", walk[:CHUNK]
    yield "chunk_and_one", walk[: CHUNK + 1]
    yield "decimals", walk
    yield "noise", rng.normal(size=5000)
    yield "roots", np.sqrt(np.arange(1500.0))
    yield "thirds", np.round(rng.uniform(0, 500, 2000), 2) / 3
    yield "zeros", np.zeros(1100)
    yield "edges", np.array([0.0, -0.0, 1e-9, 5e-324, 1.7976931348623157e308, -1.5, 123456789.123456, 1e15, 1e16, 9007199254740993.0, 0.1 + 0.2, 1e-300] * 9)
    yield "special", np.array([np.inf, -np.inf, 1.0, 2.5, np.nan] * 30)
    yield "runs", np.repeat(rng.integers(0, 5, 300).astype(float), rng.integers(1, 30, 300))
    yield "mixed", np.where(np.arange(6000) % 2 == 0, rng.uniform(-100, 100, 6000), 50 * np.sin(0.1 * np.arange(6000)))


@pytest.mark.parametrize("name", sorted(CODECS))
@pytest.mark.parametrize("block", [b[0] for b in blocks()])
def test_round_trip(name, block):
    codec, values = CODECS[name], dict(blocks())[block]
    if name in NO_NAN:
        values = values[~np.isnan(values)]
    if codec.dtype == "f4":
        with np.errstate(over="ignore"):
            values = values.astype(np.float32)
    back = codec.decode(codec.encode(values), len(values))
    kind = np.uint64 if codec.dtype == "f8" else np.uint32
    assert np.array_equal(np.ascontiguousarray(values).view(kind), np.ascontiguousarray(back).view(kind))


@pytest.mark.parametrize("policy", ["dense", "sparse"])
def test_plane_policies(policy):
    values = dict(blocks())["decimals"]
    adaptive, other = PlaneCodec(), PlaneCodec(policy=policy)
    assert len(adaptive.encode(values)) <= len(other.encode(values))
    assert np.array_equal(other.decode(other.encode(values), len(values)), values)


@pytest.mark.parametrize("dims", [2, 3])
def test_grid_dimensions(dims):
    values = np.random.default_rng(1).normal(size=4096 * 2 + 5)
    codec = GridCodec("f8", dims)
    assert np.array_equal(codec.decode(codec.encode(values)), values)


@pytest.mark.parametrize("codec", [Gfc(3), Mpc(2), Mpc(5), Fpc(4)])
def test_dimensions(codec):
    values = np.round(np.random.default_rng(1).normal(size=3001), 3)
    assert np.array_equal(codec.decode(codec.encode(values)), values)


def test_offices_cost_least():
    from itertools import combinations

    counts = [0] * 64
    for k, n in ((3, 5), (9, 2), (17, 40), (30, 1), (52, 7), (53, 9)):
        counts[k] = n
    cost = lambda ps: sum(n * (k - max(p for p in ps if p <= k)) for k, n in enumerate(counts))
    least = min(cost((0, *ps)) + sum(counts) * (len(ps)).bit_length() for m in (0, 1, 3) for ps in combinations([k for k, n in enumerate(counts) if n], m))
    found = offices(counts)
    assert cost(found) + sum(counts) * (len(found) - 1).bit_length() <= least


def test_decimal_places():
    places, sp = decimal_places(np.array([0.0, 1.0, 1.5, 0.01, 123.456, 1 / 3, np.inf, -0.0]), FORMS["f8"])
    assert places.tolist()[:5] == [0, 0, 1, 2, 3]
    assert places.tolist()[6:] == [23, 23]
    assert sp.tolist()[1:5] == [0, 0, -2, 2]


def test_significant_digits():
    assert significant(3.17) == (2, 3)
    assert significant(0.001) == (3, 0)
    assert significant(1200.0)[1] == 4


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 16, 1003])
def test_byte_transform(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    less = [int(raw[k]) - (int(raw[k - 2]) if k > 1 else 0) for k in range(n)]
    dealt = [less[k] for d in range(8) for k in range(d, n, 8)]
    want = [(x - (dealt[k - 1] if k else 0)) % 256 for k, x in enumerate(dealt)]
    made = CODECS["spdp"].transform(raw)
    assert made.tolist() == want
    assert CODECS["spdp"].invert(made).tolist() == raw.tolist()


def test_significant_digits_of_floats():
    single = XOR_FORMS["f4"]
    of = lambda v: significant(float(np.float32(v)), single)
    assert of(3.17) == (2, 3)
    assert of(0.001) == (3, 0)
    assert of(1200.0)[1] == 4
    assert of(1 / 3)[1] > single.digits


@pytest.mark.parametrize("name", ["elf_f32", "elf_star_f32", "alp_f32", "alp_chosen_f32"])
def test_decimals_of_floats_shrink(name):
    values = np.round(np.random.default_rng(1).uniform(0, 500, 1000), 2).astype(np.float32)
    assert len(CODECS[name].encode(values)) < 0.8 * values.nbytes


def test_scheme_of_floats():
    noise = np.random.default_rng(1).normal(size=4096).astype(np.float32)
    assert CODECS["alp_chosen_f32"].encode(noise)[0] == 1  # in two parts
    assert CODECS["alp_chosen_f32"].encode(np.round(noise, 1))[0] == 0
