"""Integer and floating-point bit expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(x: Column) -> Column:
    """Signed to unsigned order: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1))))


def double_bits(v: Column) -> Column:
    """The IEEE 754 bits of a double as a long."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), v).cast("long")


def bits_double(x: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), x).cast("double")


def sign_last(bits: Column) -> Column:
    """Bits turned left by one, complemented where the sign was set: small magnitudes become small numbers."""
    return F.shiftleft(bits, 1).bitwiseXOR(F.shiftright(bits, 63))


def wrapping_subtract(a: Column, b: Column) -> Column:
    """a - b modulo 2^64."""
    add = lambda x, y: F.reflect(F.lit("java.lang.Long"), F.lit("sum"), x, y).cast("long")
    return add(add(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def float_bits(v: Column) -> Column:
    """The IEEE 754 bits of a float as an int."""
    return F.reflect(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), v).cast("int")


def unsign_last(x: Column) -> Column:
    """The bits of ``sign_last``."""
    sign = x.bitwiseAND(F.lit(1).cast("long"))
    return F.shiftrightunsigned(x.bitwiseXOR(-sign), 1).bitwiseOR(F.shiftleft(sign, 63))


def wrap_32(x: Column) -> Column:
    """A long as the signed 32-bit integer of its low bits, still a long."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def bit_width(x: Column) -> Column:
    """Bits that an unsigned long takes, one for zero."""
    return F.length(F.bin(x))


def leading_zeros(x: Column, of_zero: int = 64) -> Column:
    """``of_zero``: the count for zero; its shortest text, one digit, counts 1."""
    return F.when(x == 0, of_zero).otherwise(F.lit(64) - F.length(F.bin(x)))


def trailing_zeros(x: Column, of_zero: int = 64) -> Column:
    return F.when(x == 0, of_zero).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.bin(x), F.lit("0"))))


def rotate_left_1(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseOR(F.shiftrightunsigned(x, 63))


def rotate_right_1(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseOR(F.shiftleft(x, 63))


def complement_negative(x: Column) -> Column:
    """Negative numbers with all bits but the sign flipped."""
    return F.when(x < 0, x.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(x)
