"""64-bit multiplicative hash of node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mixing prime 1125899906842597 equals 2**50 - 27.
PRIME = 1125899906842597
SHIFT = PRIME.bit_length()
REST = (1 << SHIFT) - PRIME

# Modulus (a Mersenne prime) and coefficients, below 2**31, of the pair hash.
MODULUS = 2147483647
COEFFICIENTS = (1103515245, 1812433253, 1664525123, 1597334677)

LOW = (1 << 32) - 1
LONG_MIN = -(1 << 63)


def times_prime(value: Column) -> Column:
    """``value * PRIME`` wrapped to a signed 64-bit number.

    A plain product raises on overflow, and decimals are slow. As PRIME = 2**50 - 27
    the product is ``(value << 50) - 27 * value``; the subtraction is done on unsigned
    32-bit halves, none of which can overflow.
    """
    value = value.cast("bigint")
    low, high = value.bitwiseAND(LOW), F.shiftrightunsigned(value, 32)
    low27 = low * REST
    high27 = (high * REST + F.shiftrightunsigned(low27, 32)).bitwiseAND(LOW)
    low27 = low27.bitwiseAND(LOW)
    borrow = F.when(low27 > 0, F.lit(1)).otherwise(F.lit(0))
    top = (F.shiftleft(low, SHIFT - 32).bitwiseAND(LOW) - high27 - borrow).bitwiseAND(LOW)
    bottom = (F.lit(0).cast("bigint") - low27).bitwiseAND(LOW)
    return F.shiftleft(top, 32).bitwiseOR(bottom)


def wrapping_sum(a: Column, b: Column) -> Column:
    """``a + b`` wrapped to a signed 64-bit number, from unsigned 32-bit halves."""
    a, b = a.cast("bigint"), b.cast("bigint")
    low = a.bitwiseAND(LOW) + b.bitwiseAND(LOW)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(LOW), 32).bitwiseOR(low.bitwiseAND(LOW))


def wrapping_product(value: Column, factor: int) -> Column:
    """``value * factor`` wrapped to a signed 64-bit number, for any 64-bit ``value`` and ``factor``.

    The low half of ``value`` is multiplied in two pieces of 16 bits and only the low 32 bits of
    what goes to the upper half are kept, so no intermediate product reaches 2**49.
    """
    value = value.cast("bigint")
    low, high = value.bitwiseAND(LOW), F.shiftrightunsigned(value, 32)
    first, second = low.bitwiseAND(0xFFFF), F.shiftrightunsigned(low, 16)
    near, far = factor & LOW, (factor >> 32) & LOW
    upper = second * near
    bottom = first * near + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)

    def kept(half: Column, by: int) -> Column:
        """The low 32 bits of a product of two 32-bit numbers."""
        shifted = F.shiftleft((F.shiftrightunsigned(half, 16) * by).bitwiseAND(0xFFFF), 16)
        return (half.bitwiseAND(0xFFFF) * by + shifted).bitwiseAND(LOW)

    top = F.shiftrightunsigned(upper, 16) + F.shiftrightunsigned(bottom, 32) + kept(low, far) + kept(high, near)
    return F.shiftleft(top.bitwiseAND(LOW), 32).bitwiseOR(bottom.bitwiseAND(LOW))


def wrapping_abs(value: Column) -> Column:
    """``|value|``; the smallest 64-bit number, having none, stays."""
    return F.when(value == LONG_MIN, value).otherwise(F.abs(value))


def absolute_mod(value: Column, n: Column | int) -> Column:
    """``|value| mod n`` where the smallest 64-bit number, having no absolute value, gives its plain modulus."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(value == LONG_MIN, F.pmod(value, n)).otherwise(F.abs(value % n)).cast("int")


def hash_part(value: Column, n: Column | int) -> Column:
    """Partition number in ``0..n-1`` of an id."""
    return absolute_mod(times_prime(value), n)


def pair_part(first: Column, second: Column, n: int) -> Column:
    """Partition number in ``0..n-1`` of a pair of ids: universal hashing of their four
    32-bit halves. No intermediate product reaches 2**63."""
    halves = []
    for value in (first.cast("bigint"), second.cast("bigint")):
        halves += [value.bitwiseAND(LOW), F.shiftrightunsigned(value, 32)]
    total = F.lit(0)
    for half, coefficient in zip(halves, COEFFICIENTS):
        total = total + half * coefficient % MODULUS
    return F.pmod(total % MODULUS, F.lit(n)).cast("int")
