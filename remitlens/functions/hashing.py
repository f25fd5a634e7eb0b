"""Reproducible pseudo-random numbers: pure functions of a row key and a tag.

They do not depend on partitioning, retries or engine, unlike ``F.rand``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 52
KEY_SPAN = float(1 << KEY_BITS)
# A Mersenne prime: products of two residues fit in a signed 64-bit integer.
PRIME = 2147483647


def _digest(key, tag) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(str(tag))))


def hash_uniform(key, tag) -> Column:
    """Uniform double in [0, 1) from 32 digest bits."""
    return F.conv(F.substring(_digest(key, tag), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_key(key, tag) -> Column:
    """52-bit integer sort key, exact in a double."""
    return F.conv(F.substring(_digest(key, tag), 1, 13), 16, 10).cast("long")


def residue_key(key, tag) -> Column:
    """Residue modulo ``PRIME``, the seed of the replicate weights."""
    return hash_key(key, tag) % F.lit(PRIME)
