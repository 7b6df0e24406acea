"""Seeded hashes of keys, used in place of random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hash values are 60 bits wide: 15 hexadecimal digits of an MD5 digest.
HASH_RANGE = 1 << 60


def stable_hash(*keys: Column | str, seed: int = 0) -> Column:
    """A non-negative 60-bit hash of the keys, the same on every engine.

    It depends on the values only, never on partitioning, so that a sample or
    a shuffled order can be computed again after a lost task.
    """
    parts = [F.lit(str(seed))]
    for key in keys:
        column = F.col(key) if isinstance(key, str) else key
        parts.append(F.coalesce(column.cast("string"), F.lit("")))
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def unit_interval(*keys: Column | str, seed: int = 0) -> Column:
    """``stable_hash`` scaled to [0, 1)."""
    return stable_hash(*keys, seed=seed) / F.lit(float(HASH_RANGE))
