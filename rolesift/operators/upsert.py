"""Key-based writes as joins: each returns the next version of the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import LABELS
from rolesift.operators.dedup import first_per_key


def new_rows(incoming: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the target does not have."""
    return incoming.join(target.select(*keys), list(keys), "left_anti")


def known_keys(incoming: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming keys the target already has."""
    return incoming.select(*keys).join(target.select(*keys), list(keys), "left_semi")


def upsert_ignore(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Add the rows with new keys and leave the others as they are.

    With ``order`` the first incoming row of a key wins; without it the caller
    states that incoming keys are unique and no exchange is spent on them.
    """
    if order is not None:
        incoming = first_per_key(incoming, keys, order)
    added = new_rows(incoming, target, keys).select(target.columns)
    return target.unionByName(added)


def upsert_update(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    set_columns: Sequence[str],
    where: tuple[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Insert new keys whole; on known keys replace the listed columns only.

    ``where`` = (flag, columns) names further columns that are replaced where the incoming flag is true.
    Keys are unique on both sides, so the full outer join is one co-partitioned
    exchange without fan-out.
    """
    old = target.select(*[F.col(c).alias(f"_t_{c}") for c in target.columns], F.lit(1).alias("_old"))
    new = incoming.select(*[F.col(c).alias(f"_i_{c}") for c in incoming.columns], F.lit(1).alias("_new"))
    on = [F.col(f"_t_{k}") == F.col(f"_i_{k}") for k in keys]
    joined = old.join(new, on, "full")
    have = set(incoming.columns)

    def value(c: str) -> Column:
        current, update = F.col(f"_t_{c}"), F.col(f"_i_{c}") if c in have else F.lit(None)
        if c in keys:
            return F.coalesce(current, update).alias(c)
        if c in set_columns:
            replaced = F.col("_new").isNotNull()
        elif where is not None and c in where[1]:
            replaced = F.coalesce(F.col(f"_i_{where[0]}"), F.lit(False))
        else:
            replaced = F.lit(False)
        return F.when(F.col("_old").isNull() | replaced, update).otherwise(current).alias(c)

    return joined.select([value(c) for c in target.columns])


def upsert_labels(labels: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Save labels: a known title takes the new label and note and counts one more sighting.

    Incoming rows with an unknown label are refused (see ``invalid_labels``).
    """
    keys = ["profile_id", "title_norm"]
    valid = incoming.filter(F.col("label").isin(*LABELS)).select(
        *keys, F.col("label").alias("_label"), F.col("note").alias("_note"),
        F.col("count_seen").alias("_count"), F.lit(True).alias("_new"),
    )
    joined = labels.withColumn("_old", F.lit(True)).join(valid, keys, "full")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    return joined.select(
        *keys,
        F.when(is_new, F.col("_label")).otherwise(F.col("label")).alias("label"),
        F.when(is_new, F.col("_note")).otherwise(F.col("note")).alias("note"),
        F.when(is_new & is_old, F.col("count_seen") + 1)
        .otherwise(F.coalesce("count_seen", "_count", F.lit(1)))
        .cast("int")
        .alias("count_seen"),
        F.coalesce(F.col("created_at"), now).alias("created_at"),
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def invalid_labels(incoming: DataFrame) -> DataFrame:
    return incoming.filter(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)))


def delete_by_key(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys), list(keys), "left_anti")


def replace_by_key(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows stand in whole for target rows of the same key."""
    return delete_by_key(target, incoming, keys).unionByName(incoming.select(target.columns))
