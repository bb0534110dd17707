"""Keyed randomness: hashes of (seed, epoch, purpose, key) instead of a sequential generator.

A draw depends on its key alone, so plans give the same rows whatever the partitioning, may be
recomputed after a lost executor, and can be repeated by another SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int, epoch: int, purpose: str, *keys: Column | str) -> Column:
    """32 hex digits; seed and epoch are separate parts, so no two epochs share an order."""
    parts = [F.lit(str(seed)), F.lit(str(epoch)), F.lit(purpose)]
    return F.md5(F.concat_ws(":", *parts, *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def hash_u60(seed: int, epoch: int, purpose: str, *keys: Column | str) -> Column:
    """A uniform integer of 60 bits (fits a signed BIGINT)."""
    return F.conv(F.substr(hash_hex(seed, epoch, purpose, *keys), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def hash_unit(seed: int, epoch: int, purpose: str, *keys: Column | str) -> Column:
    """A uniform double in (0, 1): 52 bits and a half."""
    bits = F.conv(F.substr(hash_hex(seed, epoch, purpose, *keys), F.lit(1), F.lit(13)), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
