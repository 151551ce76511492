"""Row-key randomness: the draw depends on the key and a seed, never on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(2**32)


def digest(keys: Sequence[str], seed: int | str) -> Column:
    """Hex digest of the row key and a seed."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def uniform(hexdigest: Column, word: int = 0) -> Column:
    """Uniform in (0, 1) from one of the four 32-bit words of a digest."""
    number = F.conv(F.substring(hexdigest, 1 + 8 * word, 8), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(SPAN)


def normal(hexdigest: Column) -> Column:
    """Standard normal draw from two words of a digest (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(hexdigest, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(hexdigest, 1))
