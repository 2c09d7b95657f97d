"""Seeded hash ordering: the repeatable stand-in for random choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def order_key(*parts) -> Column:
    """md5 over the parts, joined by '|'. Sorting by it is a seeded shuffle."""
    return F.md5(_text(*parts))


def hex_int(hexed: Column, start: int, length: int) -> Column:
    """`length` hex digits from 1-based `start` as a bigint."""
    return F.conv(F.substring(hexed, start, length), 16, 10).cast("bigint")


def hash_int(*parts) -> Column:
    """A number in [0, 2^32) drawn from the parts."""
    return hex_int(order_key(*parts), 1, 8)


def uniform(*parts) -> Column:
    """A double in (0, 1) drawn from the parts."""
    return (hash_int(*parts) + 0.5) / F.lit(4294967296.0)


def digest_mod(text: Column, n: Column) -> Column:
    """sha256(text), read as one 256-bit integer, modulo n (n < 2^31)."""
    digest = F.sha2(text, 256)
    words = [F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    rest = F.lit(0).cast("bigint")
    for word in words:
        rest = (rest * F.lit(4294967296) + word) % n
    return rest
