"""Seeded, partition-independent pseudo-random numbers.

``portable_hash`` is the first 32 bits of the MD5 of a string, as a
non-negative BIGINT.  DuckDB computes the same number with
``('0x' || substr(md5(s), 1, 8))::BIGINT``, so sampling decisions can be
checked by SQL and do not depend on partitioning or task order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    s = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def unit_uniform(*parts) -> Column:
    """A value in [0, 1) derived from ``portable_hash``."""
    return portable_hash(*parts) / F.lit(float(1 << 32))
