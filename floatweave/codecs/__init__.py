"""Codecs over arrays of floats: each encodes a block of values to bytes and back, bit for bit.

A codec is an object with ``name``, ``block`` (values a block), ``dtype``,
``encode(array) -> bytes`` and ``decode(bytes) -> array``. ``registry()`` has all by name.
"""

from __future__ import annotations


def registry() -> dict:
    from . import alp, general, grid, integers, planes, predict, xor

    both = [c("f4") for c in (xor.Chimp, xor.Elf, xor.ElfStar, alp.Alp, alp.AlpRd, alp.AlpChosen)]
    made = [planes.PlaneCodec("f8"), planes.PlaneCodec("f4"), xor.Gorilla(), xor.Chimp(), xor.Patas(), xor.Elf(), xor.ElfStar(), alp.Alp(), alp.AlpRd(), alp.AlpChosen(), alp.AlpLocal(), grid.GridCodec("f8"), grid.GridCodec("f4"), integers.Cascaded(), predict.Fpc(), predict.ParallelFpc(), predict.Gfc(), predict.Mpc(), predict.Mpc(kind="f4"), *both, *general.codecs()]
    return {c.name: c for c in made}


def find(name: str):
    """A codec of the registry, or bit planes that drop the signs of zeros: not bit for bit, so by name only."""
    from .planes import PlaneCodec

    more = {c.name: c for c in (PlaneCodec("f8", signed_zeros=False), PlaneCodec("f4", signed_zeros=False))}
    return more[name] if name in more else registry()[name]


#: Formats of closed libraries: there is nothing to rebuild, and the names say so.
UNSUPPORTED = ("bitcomp", "bitcomp_sparse", "ans", "gdeflate", "fpzip", "zfp")
