"""Random draws that depend only on a seed and a row's identity.

``rand`` and ``randn`` depend on how rows are spread over partitions, so a
retried task could draw other numbers. These columns hash ``seed|key...`` and
give the same value on any layout, on any engine that has MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(digest: Column, start: int) -> Column:
    """Eight hex digits of a digest as a number in (0, 1)."""
    return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def _digest(seed, keys) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def uniform(seed, *keys) -> Column:
    """Uniform draw in (0, 1); ``keys`` are column names or Columns."""
    return _word(_digest(seed, keys), 1)


def normal(seed, *keys) -> Column:
    """Standard normal draw (Box-Muller on two words of one digest)."""
    digest = _digest(seed, keys)
    radius = F.sqrt(-2.0 * F.log(_word(digest, 1)))
    return radius * F.cos(2.0 * math.pi * _word(digest, 9))
