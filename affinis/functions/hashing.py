"""The MinHash family: k(a1 x + b1) + k(a2 x + b2) + k^2, modulo a prime, then modulo the dimensions.

The coefficients of hash k are the k-th primes from four fixed starts, so they are built, not listed.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
PRIME = 24251
STARTS = {"a1": 5003, "a2": 9127, "b1": 2, "b2": 1009}


@cache
def primes_from(start: int, count: int) -> tuple[int, ...]:
    out, x = [], start
    while len(out) < count:
        if x > 1 and all(x % d for d in range(2, int(x**0.5) + 1)):
            out.append(x)
        x += 1
    return tuple(out)


def coefficients(hashes: int) -> list[tuple[int, int]]:
    """(slope, offset) of each hash: the two linear parts add up to one."""
    a1, a2, b1, b2 = (primes_from(STARTS[k], hashes) for k in ("a1", "a2", "b1", "b2"))
    return [(k * (a1[k - 1] + a2[k - 1]), k * (b1[k - 1] + b2[k - 1]) + k * k) for k in range(1, hashes + 1)]


def hash_value(x: Column, k: tuple[int, int], m: int) -> Column:
    """One hash of a dimension index (bigint: products reach about 2e10)."""
    return (x.cast("long") * F.lit(k[0]).cast("long") + F.lit(k[1]).cast("long")) % F.lit(PRIME).cast("long") % F.lit(m).cast("long")
