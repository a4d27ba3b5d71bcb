"""Reproducible pseudo-random columns keyed by row, so no result depends on layout.

A draw is a hash of ``(seed, key parts)``.  The same row gets the same draw after
a retry or on another cluster size.  ``draws="xxhash"`` is the fast form;
``draws="md5"`` can be repeated by any SQL engine with an md5 function.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
TWO_52 = 4503599627370496.0


def hash_uint32(seed: int, *parts: Column) -> Column:
    """First 32 bits of md5 over ``seed|part|part...`` as a BIGINT."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed: int, *parts: Column, draws: str = "xxhash") -> Column:
    """Uniform draw strictly inside (0, 1)."""
    if draws == "md5":
        return (hash_uint32(seed, *parts) + F.lit(0.5)) / F.lit(TWO_32)
    if draws != "xxhash":
        raise ValueError(f"unknown draws {draws!r}")
    high = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12)
    return (high + F.lit(0.5)) / F.lit(TWO_52)


def hash_gaussian(seed: int, *parts: Column, draws: str = "xxhash") -> Column:
    """Standard normal draw from two uniforms (Box-Muller)."""
    u1 = hash_uniform(seed, *parts, F.lit("a"), draws=draws)
    u2 = hash_uniform(seed, *parts, F.lit("b"), draws=draws)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_uniform_value(seed: int, *parts: object) -> float:
    """The md5 draw of :func:`hash_uniform`, for constants computed on the driver."""
    text = "|".join(str(p) for p in (seed, *parts))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / TWO_32


def hash_gaussian_value(seed: int, *parts: object) -> float:
    u1 = hash_uniform_value(seed, *parts, "a")
    u2 = hash_uniform_value(seed, *parts, "b")
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)
