"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str = "_rank"
) -> DataFrame:
    """The first ``n`` rows of every key, with their rank.

    Spark cuts each map task to its own first ``n`` rows per key before the
    exchange (a partial window group limit), so a key that holds a third of all
    rows still reaches its reducer as ``n`` rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]
) -> DataFrame:
    """The first row of every key in the given order."""
    return top_per_key(df, keys, order, 1).drop("_rank")
