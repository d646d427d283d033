"""Checks that stand in for enforced keys, references and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """One row: keys held by more than one row, and the rows beyond the first."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return counts.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_rows"),
    )


def orphans(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str
) -> DataFrame:
    """One row: distinct child keys without a parent, and the child rows that hold them."""
    held = child.filter(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    lost = held.join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return lost.agg(
        F.lit(name).alias("reference"),
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"),
    )


def domain_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule; a rule that evaluates to NULL is broken."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in rules.items()])
