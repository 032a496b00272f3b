"""A seeded order of rows that depends on the id alone, never on partitioning or arrival."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(id_col: Column, seed: int) -> Column:
    """Hex digest that orders rows pseudo-randomly for a seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def hash_position(digest: Column) -> Column:
    """Where a digest lies in [0, 1). Non-decreasing in the digest's own order."""
    leading = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return leading / F.lit(float(16**8))
