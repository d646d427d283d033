"""Search profiles: cleaning, ids, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import DEFAULT_PROFILE_ID, DEFAULT_PROFILE_NAME, DEFAULT_SITES
from rolesift.functions.keys import stable_key, strip
from rolesift.functions.normalize import (
    clean_names,
    clean_sites,
    parse_list,
    strip_or_null,
)
from rolesift.functions.text import slugify

# What a profile searches for when nothing else is known.
DEFAULT_KEYWORDS = ("Data Engineer",)
DEFAULT_LOCATIONS = ("London, UK",)


def clean_profiles(profiles: DataFrame) -> DataFrame:
    """Cleaned lists and ids; ``valid`` is false without a name or without keywords."""
    cleaned = profiles.select(
        F.coalesce(F.nullif("profile_id", F.lit("")), slugify(F.col("name"))).alias("profile_id"),
        strip(F.coalesce("name", F.lit(""))).alias("name"),
        strip_or_null(F.col("description")).alias("description"),
        clean_names(F.col("keywords")).alias("keywords"),
        F.coalesce(clean_names(F.col("locations")), F.array().cast("array<string>")).alias(
            "locations"
        ),
        clean_sites(F.col("sites")).alias("sites"),
    )
    valid = (F.col("name") != "") & (F.coalesce(F.size("keywords"), F.lit(0)) > 0)
    return cleaned.withColumn("valid", valid)


def unique_slugs(names: DataFrame, name: str, key: str) -> DataFrame:
    """A slug per row; rows that share one get a short, or if need be a long, key suffix.

    The row with the smallest key keeps the bare slug. Minimums are found by
    aggregation, so a slug shared by very many rows is never gathered.
    """
    hashed = stable_key(F.col(key))
    rows = names.withColumn("_slug", slugify(F.col(name))).withColumn("_hash", hashed)
    bare = rows.groupBy("_slug").agg(F.min("_hash").alias("_first"))
    short = rows.withColumn("_head", F.substring("_hash", 1, 4))
    heads = short.groupBy("_slug", "_head").agg(F.min("_hash").alias("_head_first"))
    joined = short.join(bare, "_slug", "left").join(heads, ["_slug", "_head"], "left")
    slug = (
        F.when(F.col("_hash") == F.col("_first"), F.col("_slug"))
        .when(F.col("_hash") == F.col("_head_first"), F.concat_ws("-", "_slug", "_head"))
        .otherwise(F.concat_ws("-", "_slug", "_hash"))
    )
    return joined.withColumn("slug", F.when(F.col("_slug").isNotNull(), slug)).select(
        *names.columns, "slug"
    )


def list_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy(F.col("updated_at").desc(), "profile_id")


def migrate_legacy(config: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Key/value settings as one profile row (per ``by``), with defaults for what is missing."""
    by = by or []
    wide = config.groupBy(*by).pivot("key", ["keywords", "locations", "sites"]).agg(F.max("value"))

    def listed(name: str, default: tuple[str, ...]) -> Column:
        values = parse_list(F.col(name))
        fallback = F.array(*(F.lit(v) for v in default))
        return F.when(F.size(values) > 0, values).otherwise(fallback).alias(name)

    return wide.select(
        *by,
        F.lit(DEFAULT_PROFILE_ID).alias("profile_id"),
        F.lit(DEFAULT_PROFILE_NAME).alias("name"),
        listed("keywords", DEFAULT_KEYWORDS),
        listed("locations", DEFAULT_LOCATIONS),
        listed("sites", DEFAULT_SITES),
    )
