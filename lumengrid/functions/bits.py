"""Bit views of 32-bit floats as columns.  Unsigned words are BIGINT in 0 .. 2^32 - 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, BODY, SIGN = 0xFFFFFFFF, 0x7FFFFFFF, 0x80000000


def long(x: int) -> Column:
    return F.lit(x).cast("long")


def float_bits(v: Column) -> Column:
    """The IEEE word of a FLOAT; exact for zeros, infinities, NaN payloads and subnormals."""
    raw = F.java_method(F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), v)
    return raw.cast("int").cast("long").bitwiseAND(long(WORD))


def bits_float(b: Column) -> Column:
    signed = F.when(b >= SIGN, b - (WORD + 1)).otherwise(b).cast("int")
    return F.java_method(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), signed).cast("float")


def sign_of(b: Column) -> Column:
    return F.shiftright(b, 31)


def exponent_of(b: Column) -> Column:
    return F.shiftright(b, 23).bitwiseAND(long(255))


def mantissa_of(b: Column) -> Column:
    return b.bitwiseAND(long(0x7FFFFF))


def is_finite(b: Column) -> Column:
    return exponent_of(b) != 255


def ordered(b: Column) -> Column:
    """A word whose integer order is the order of the floats."""
    return F.when(b >= SIGN, long(WORD) - b).otherwise(b + SIGN)


def unordered(o: Column) -> Column:
    return F.when(o >= SIGN, o - SIGN).otherwise(long(WORD) - o)


def ordered16(h: Column) -> Column:
    return F.when(h >= 0x8000, long(0xFFFF) - h).otherwise(h + 0x8000)


def bit(v: Column, k: int) -> Column:
    return F.shiftright(v, k).bitwiseAND(long(1))


def byte(v: Column, k: int) -> Column:
    return F.shiftright(v, 8 * k).bitwiseAND(long(255))


def half_bits(b: Column) -> Column:
    """Half-precision word of a float that is one exactly, with a normal exponent or zero; else null."""
    e, m = exponent_of(b) - 112, mantissa_of(b)
    sign = F.shiftright(b, 16).bitwiseAND(long(0x8000))
    normal = (e > 0) & (e < 31) & (m.bitwiseAND(long(0x1FFF)) == 0)
    return F.when((exponent_of(b) == 0) & (m == 0), sign).when(normal, sign + e * 1024 + F.shiftright(m, 13))


def half_to_float_bits(h: Column) -> Column:
    sign, e, m = F.shiftright(h, 15) * SIGN, F.shiftright(h, 10).bitwiseAND(long(31)), h.bitwiseAND(long(1023))
    top = F.floor(F.log2(F.greatest(m, long(1)).cast("double")))  # subnormal: the place of its leading bit
    small = (top + 103) * (1 << 23) + (m * F.pow(F.lit(2.0), 10 - top).cast("long")).bitwiseAND(long(1023)) * (1 << 13)
    return sign + F.when((e == 0) & (m == 0), long(0)).when(e == 0, small).when(e == 31, long(0x7F800000) + m * (1 << 13)).otherwise((e + 112) * (1 << 23) + m * (1 << 13))


def bf16_bits(b: Column) -> Column:
    return F.when(b.bitwiseAND(long(0xFFFF)) == 0, F.shiftright(b, 16))


def clear_low(b: Column, count: Column | int) -> Column:
    """Finite words with their `count` low mantissa bits cleared (23 and more: all of the mantissa)."""
    step = F.pow(F.lit(2.0), F.least(F.lit(23), F.lit(count) if isinstance(count, int) else count)).cast("long")
    return F.when(is_finite(b), b - F.pmod(b, step)).otherwise(b)


def adaptive_clear(b: Column, base: int, most: Column) -> Column:
    """How many bits to clear: base and one more for every two steps below the greatest exponent, 23 at most."""
    if base == 0:
        return long(0)
    extra = F.floor(F.greatest(most - exponent_of(b), long(0)) / 2)
    return F.when(is_finite(b), F.least(long(23), extra + base)).otherwise(long(0))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, F.shiftright(z, 1)).otherwise(-F.shiftright(z + 1, 1))


def wrap(v: Column, width: int) -> Column:
    return F.pmod(v, long(1 << width))


def signed_difference(a: Column, b: Column, width: int) -> Column:
    """a - b modulo 2^width, in -2^(width-1) .. 2^(width-1) - 1."""
    d = wrap(a - b, width)
    return F.when(d >= 1 << (width - 1), d - (1 << width)).otherwise(d)


def trailing_zeros(v: Column, width: int) -> Column:
    return F.when(v == 0, F.lit(width)).otherwise(F.least(F.lit(width), F.bit_count((v.bitwiseAND(-v)) - 1)))


def fold_hash(code: Column) -> Column:
    """An 18-bit feature code folded into 2^11 buckets."""
    mixed = code.bitwiseXOR(F.shiftright(code, 11)).bitwiseXOR(F.shiftright(code, 22))
    mixed = (mixed * long(0x9E3779B1)).bitwiseAND(long(WORD))
    return mixed.bitwiseXOR(F.shiftright(mixed, 16)).bitwiseAND(long(2047))


def _times(h: Column, k: int) -> Column:
    """h * k modulo 2^32 without leaving 63 bits: the high half of h is multiplied apart."""
    low = h.bitwiseAND(long(0xFFFF)) * k
    high = (F.shiftright(h, 16) * k).bitwiseAND(long(0xFFFF)) * 65536
    return (low + high).bitwiseAND(long(WORD))


def hash_noise(x: Column, y: Column, c: Column) -> Column:
    """Deterministic noise in [-0.5, 0.5) of a sample's place."""
    h = _times(x.cast("long"), 374761393).bitwiseXOR(_times(y.cast("long"), 668265263)).bitwiseXOR(_times(c.cast("long") + 1, 2246822519))
    h = _times(h.bitwiseXOR(F.shiftright(h, 13)), 1274126177)
    return h.bitwiseXOR(F.shiftright(h, 16)) / F.lit(4294967296.0) - 0.5


def decimal_exact(v: Column, k: int) -> Column:
    """Whether rounding to k decimals gives the same FLOAT."""
    scale = float(10**k)
    return (F.rint(v.cast("double") * scale) / scale).cast("float") == v


def varint_size(v: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7)).cast("long")
