"""Decimal analysis of doubles and of numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the format
NOT_DECIMAL = 23
MAX_DIGITS = 15
MAGIC = 6755399441055744.0  # 2^51 + 2^52: adding and taking it away rounds to even
ULP = 2.220446049250313e-16  # 2^-52


def nearest_even(x: Column) -> Column:
    return x + F.lit(MAGIC) - F.lit(MAGIC)


def power_of_ten(n: Column) -> Column:
    """10^n for n in 0..16, exact."""
    return F.element_at(F.array(*(F.lit(float(f"1e{d}")) for d in range(17))), n.cast("int") + 1)


def start_position(v: Column) -> Column:
    """The decimal exponent of the first digit; null for zero and what is not finite."""
    return F.when((v != 0) & (F.abs(v) < float("inf")), F.floor(F.log10(F.abs(v)))).cast("int")


def is_negative_zero(v: Column) -> Column:
    """Told by its text: comparisons and even atan2 take it for zero."""
    return (v == 0) & (v.cast("string") == "-0.0")


def decimal_places(v: Column) -> Column:
    """The fewest decimal places that show ``v`` exactly, NOT_DECIMAL if none do.

    A place d is enough when v * 10^d is nearer to an integer than its error, or
    when all 16 digits are used; the result must then divide back to v. Zero has
    none; a negative zero, NaN and infinities are not decimal.
    """
    return checked_places(v, tried_places(v))


def tried_places(v: Column) -> Column:
    """The places at which the search for ``v`` stops, null if it does not; still to be checked."""
    sp = start_position(v)
    out = F.when(v == 0, F.lit(0))
    for d in range(17):
        p = F.lit(float(f"1e{d}"))
        t = v * p
        out = out.when((F.abs(t - nearest_even(t)) < F.abs(v) * F.lit(ULP * float(f"1e{d}"))) | (sp >= MAX_DIGITS - d), F.lit(d))
    return out


def checked_places(v: Column, tried: Column, signed_zeros: bool = True) -> Column:
    """``tried`` where it divides back to ``v``, else NOT_DECIMAL. Without ``signed_zeros`` a
    negative zero is as good as zero."""
    p = power_of_ten(tried)
    special = F.isnan(v) | (F.abs(v) == float("inf"))
    if signed_zeros:
        special |= is_negative_zero(v)
    return F.when(special, F.lit(NOT_DECIMAL)).otherwise(F.when(half_away(v * p) / p == v, tried).otherwise(F.lit(NOT_DECIMAL)))


def half_away(x: Column) -> Column:
    """Rounded to an integer, halves away from zero."""
    r = F.rint(x)
    return r + F.when((F.abs(x - r) == 0.5) & (F.signum(x - r) == F.signum(x)), F.signum(x)).otherwise(F.lit(0.0))


def brute_decimal_places(v: Column) -> Column:
    """The fewest places d below 17 with v * 10^d an integer in double arithmetic, else 17; no check back."""
    out = F.lit(17)
    for d in range(16, -1, -1):
        t = F.abs(v) * F.lit(float(f"1e{d}"))
        out = F.when(half_away(t) == t, F.lit(d)).otherwise(out)
    return out


def text_decimal_places(s: Column) -> Column:
    """Decimal places that a number written as text needs; an exponent moves the point."""
    low = F.regexp_replace(F.lower(F.trim(s)), "^[+-]", "")
    mantissa = F.split_part(low, F.lit("e"), F.lit(1))
    power = F.coalesce(F.split_part(low, F.lit("e"), F.lit(2)).try_cast("int"), F.lit(0))
    fraction = F.regexp_replace(F.split_part(mantissa, F.lit("."), F.lit(2)), "0+$", "")
    return F.greatest(F.lit(0), F.length(fraction) - power)


def text_significant_digits(s: Column) -> Column:
    """Significant digits of a number written as text: trailing zeros count only behind a
    point, leading ones never, and zero has one."""
    low = F.regexp_replace(F.lower(F.trim(s)), "^[+-]", "")
    mantissa = F.split_part(low, F.lit("e"), F.lit(1))
    digits = F.regexp_replace(mantissa, "[^0-9]", "")
    kept = F.regexp_replace(digits, "^0+", "")
    counted = F.when(F.contains(mantissa, F.lit(".")), F.length(kept)).otherwise(F.length(F.regexp_replace(kept, "0+$", "")))
    return F.when(digits == "", 0).when(kept == "", 1).otherwise(counted)


def significant_figures(v: Column, figures: int) -> Column:
    """``v`` with so many significant digits, halves of the written digits away from zero; NaN and
    infinities as they are."""
    if figures < 1:
        raise ValueError("at least one digit")
    cut = F.format_string(f"%.{figures - 1}e", v).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v == 0), v).otherwise(cut)


def round_up(v: Column, places: Column) -> Column:
    """``v`` rounded away from zero to the decimal places (0 to 16); a zero keeps its sign."""
    p = power_of_ten(places)
    t = v * p
    r = F.rint(t)
    return F.when(F.abs(r) < F.abs(t), r + F.signum(t)).otherwise(r) / p


def fraction_bits(places: Column) -> Column:
    """The binary places that show the decimal ones: ceil(places * log2(10))."""
    return F.ceil(places * F.lit(3.321928094887362)).cast("int")


def exact_start(v: Column) -> Column:
    """The decimal exponent of the first digit, exact at powers of ten from 1e-16 to 1e16; null for zero."""
    powers, size = F.array(*(F.lit(float(f"1e{d}")) for d in range(-17, 19))), F.abs(v)
    power = lambda n: F.element_at(powers, F.greatest(F.lit(-17), F.least(F.lit(18), n)) + 18)
    settle = lambda k: F.when((k < 17) & (power(k + 1) <= size), k + 1).when((k > -17) & (power(k) > size), k - 1).otherwise(k)
    return F.transform(F.array(start_position(v)), settle)[0]


def is_power_of_ten(v: Column) -> Column:
    """Whether |v| is a power of ten from 1e-16 to 1e16, as its nearest double."""
    return F.coalesce(F.array_contains(F.array(*(F.lit(float(f"1e{d}")) for d in range(-16, 17))), F.abs(v)), F.lit(False))


def significant_count(v: Column) -> Column:
    """Significant digits of ``v``: from its first digit to its last decimal place; 0 for a power of
    ten below one, 17 if no 17 digits show it, null for zero and what is not finite."""
    size = F.abs(v)
    powers = F.array(*(F.lit(float(f"1e{d}")) for d in range(34)))

    def fits(d: Column) -> Column:
        t = size * F.element_at(powers, d + 1)
        return (t == F.rint(t)) & (t / F.element_at(powers, d + 1) == size)

    def count(sp: Column) -> Column:
        places = F.filter(F.sequence(F.greatest(F.lit(0), -sp), F.greatest(F.lit(0), F.least(F.lit(33), 16 - sp))), fits)
        return F.coalesce(sp + F.try_element_at(places, F.lit(1)) + 1, F.lit(17))

    digits = F.transform(F.array(exact_start(v)), count)[0]  # as an array's element the exponent is found once
    finite = (v != 0) & ~F.isnan(v) & (size != float("inf"))
    return F.when(finite, F.when((size < 1) & is_power_of_ten(v), 0).otherwise(digits))


# fixed values of the 32-bit format
NOT_DECIMAL_32, MAX_DIGITS_32, MAGIC_32, ULP_32 = 17, 6, 12582912.0, 2.0**-23


def _single(x: float) -> Column:
    return F.lit(x).cast("float")


def tried_places_32(v: Column) -> Column:
    """As ``tried_places``, in single precision throughout."""
    sp = start_position(v.cast("double"))
    out = F.when(v == 0, F.lit(0))
    for d in range(10):
        p = _single(float(f"1e{d}"))
        t = v * p
        error = F.abs(t - ((t + _single(MAGIC_32)) - _single(MAGIC_32)))
        out = out.when((error < F.abs(v) * _single(ULP_32) * p) | (sp >= 7 - d), F.lit(d))
    return out


def scaled_32(v: Column, places: Column) -> Column:
    """v * 10^places in single precision, rounded to an integer (a double)."""
    p = F.element_at(F.array(*(_single(float(f"1e{d}")) for d in range(11))), F.least(places, F.lit(10)) + 1)
    return half_away((v * p).cast("double"))


def checked_places_32(v: Column, tried: Column, signed_zeros: bool = True) -> Column:
    wide = v.cast("double")
    p = F.element_at(F.array(*(F.lit(float(f"1e{d}")) for d in range(11))), tried + 1)
    special = F.isnan(v) | (F.abs(wide) == float("inf"))
    if signed_zeros:
        special |= is_negative_zero(v)
    back = (scaled_32(v, tried) / p).cast("float")  # a double's quotient rounds to the float's own
    return F.when(special | tried.isNull(), F.lit(NOT_DECIMAL_32)).otherwise(F.when(back == v, tried).otherwise(F.lit(NOT_DECIMAL_32)))
