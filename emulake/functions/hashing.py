"""Seeded hashes that any SQL engine can repeat: order, sampling and uniform draws come from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, the widest integer a double keeps exact.
UNIFORM_HEX = 13


def seeded_hash(seed: int | Column, *keys: str | Column) -> Column:
    """md5 hex of ``seed|key|...``; NULL keys hash as a marker so rows never vanish."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\\N")) for k in keys]
    return F.md5(F.concat_ws("|", seed.cast("string"), *parts).cast("binary"))


def uniform(seed: int | Column, *keys: str | Column) -> Column:
    """A double in [0, 1) fixed by seed and keys."""
    digits = F.substring(seeded_hash(seed, *keys), 1, UNIFORM_HEX)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(2**52))
