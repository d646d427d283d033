"""Corpus counts looked up by skewed keys: the frequent ones are broadcast, the others shuffled.

Of n counted rows at most n / c keys are seen c times or more. So a level exists above which a bounded number of keys lies, and
below which no key has many rows: the first side is small by proof, the second without skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys counted as frequent at most; this bounds what is broadcast.
FREQUENT_KEYS = 1 << 18
_STEPS = 16


def level(n: Column) -> Column:
    """Counts in sixteenths of an octave; a greater count has no lower level."""
    return F.floor(F.log2(n.cast("double")) * _STEPS).cast("int")


def least_level(counts: DataFrame, n: str, most: int = FREQUENT_KEYS) -> int:
    """The least level from which at most ``most`` keys lie; the driver sees one row a level."""
    keys = 0
    rows = counts.groupBy(level(F.col(n)).alias("level")).agg(F.count(F.lit(1)).alias("keys")).collect()
    least = max((r["level"] for r in rows), default=0) + 1
    for r in sorted(rows, key=lambda r: -r["level"]):
        keys += r["keys"]
        if keys > most:
            break
        least = r["level"]
    return least
