"""Column functions of the similarity kernel: finalisation, packing, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_BITS = 21
FIELD_MASK = (1 << FIELD_BITS) - 1


def finalise(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson similarity from six sums; 0 where the numerator or a variance vanishes.

    The built-in corr() is no substitute: it raises on a constant side under ANSI rules."""
    num = n * sxy - sx * sy
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    return F.when((num == 0) | (vx <= 0) | (vy <= 0), F.lit(0.0)).otherwise(num / F.sqrt(vx * vy))


def finite(v: Column) -> Column:
    """Neither null nor NaN nor infinite. Comparisons alone would let NaN pass, which sorts above
    every number here."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def emitted(sim: Column, eps: float) -> Column:
    return finite(sim) & (sim > F.lit(eps))


def packed_words(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column]:
    """Two bigints of three 21-bit fields; sums of words are words of sums while no field overflows."""
    def word(a, b, c):
        return F.shiftleft(a.cast("long"), 2 * FIELD_BITS).bitwiseOR(F.shiftleft(b.cast("long"), FIELD_BITS)).bitwiseOR(c.cast("long"))

    return word(n, sx, sy), word(sxx, syy, sxy)


def unpacked(w0: Column, w1: Column) -> list[Column]:
    def fields(w):
        return [F.shiftrightunsigned(w, s * FIELD_BITS).bitwiseAND(F.lit(FIELD_MASK)) for s in (2, 1, 0)]

    return [*fields(w0), *fields(w1)]


def bit_length(x: Column) -> Column:
    """Bits of a nonnegative integer: digits of its binary form, 0 for 0. Exact, unlike a logarithm."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))
