"""Hash columns and the seeded hash family of MinHash."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: modulus of the hash family, the Mersenne prime 2^31 - 1.
PRIME = 2147483647


def base_hash(key: Column) -> Column:
    """A string's first 32 digest bits reduced mod ``PRIME``; any SQL engine with md5 agrees."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(PRIME)


def fast_hash(key: Column) -> Column:
    """The same range from ``xxhash64``: cheaper, but only Spark computes it."""
    return F.pmod(F.xxhash64(key), F.lit(PRIME))


def family(size: int, seed: int = 1) -> list[tuple[int, int]]:
    """``size`` pairs (a, b) of the family ``(a*x + b) mod PRIME``; a longer family extends a shorter one."""
    draw = random.Random(seed)
    return [(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(size)]


def seeded(x: Column, a: int, b: int) -> Column:
    """One member of the family. ``x`` lies below 2^31, so the product fits a bigint."""
    return (F.lit(a) * x + F.lit(b)) % F.lit(PRIME)


def digest60(key: Column) -> Column:
    """The first 60 bits of a string's md5 as a bigint, for grouping keys."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def digest64(key: Column) -> Column:
    """The first 64 bits of a string's md5 as a signed bigint."""
    half = lambda at: F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hash_columns(key: Column, seed: int = 0) -> dict[str, Column]:
    """32-, 64- and 128-bit hashes of a column, unseeded and seeded, by name."""
    salted = F.concat(F.lit(f"{seed}:"), key)
    return {
        "h32": F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"),
        "h60": digest60(key),
        "h64": digest64(key),
        "h128": F.md5(key),
        "seeded_h128": F.md5(salted),
    }
