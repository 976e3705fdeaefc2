"""128-bit keys as two 64-bit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes; the order and the lengths of the parts count."""
    return F.xxhash64(F.lit(0x5EED), *cols), F.xxhash64(F.lit(0xFACE), F.lit(1), *cols)
