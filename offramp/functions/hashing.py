"""Seeded, partition-independent randomness.

Everything random in the library is a function of a seed and a row key, so that a retried
task, another partition count or another engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offramp.functions.columns import as_column


def seeded_digest(seed: int, key: Column | str) -> Column:
    """Hex md5 of ``seed:key``; also the sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(key).cast("string")))


def digest_number(digest: Column, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of a digest as BIGINT (uniform in [0, 16^digits))."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def hash_below(seed: int, key: Column | str, fraction: float) -> Column:
    """True for a seeded ``fraction`` of the keys."""
    return digest_number(seeded_digest(seed, key)) < F.lit(int(fraction * (1 << 32)))
