"""Landing: what is new, what was loaded per request and board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import FRESH_HOURS
from rolesift.operators.joins import null_safe_join
from rolesift.operators.rules import verdict_rows
from rolesift.operators.upsert import new_rows


def request_matrix(profiles: DataFrame) -> DataFrame:
    """Every (keyword, location, site) a profile asks for; no location gives one NULL location."""
    return (
        profiles.select("profile_id", F.explode("keywords").alias("keyword"), "locations", "sites")
        .select("profile_id", "keyword", F.explode_outer("locations").alias("location"), "sites")
        .select("profile_id", "keyword", "location", F.explode("sites").alias("site"))
    )


def planned_workload(profiles: DataFrame) -> DataFrame:
    """Number of keyword x location requests, and of single-board calls, per profile."""
    requests = F.size("keywords") * F.greatest(F.coalesce(F.size("locations"), F.lit(0)), F.lit(1))
    sites = F.greatest(F.coalesce(F.size("sites"), F.lit(0)), F.lit(1))
    return profiles.select(
        "profile_id",
        requests.cast("bigint").alias("requests"),
        (requests * sites).cast("bigint").alias("site_calls"),
    )


def load_counts(requests: DataFrame, loaded: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Rows loaded per request and site, zero where a site gave nothing.

    ``status`` = (site, error), a row per site, adds the error of the site. Loaded rows are counted before the join, so a popular request stays one row.
    """
    keys = ["profile_id", "keyword", "location", "site"]
    counts = loaded.groupBy(
        "profile_id", F.col("search_keyword").alias("keyword"),
        F.col("search_location").alias("location"), "site",
    ).agg(F.count(F.lit(1)).alias("_n"))
    found = null_safe_join(requests, counts, keys, "left").select(
        *requests.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("rows_loaded")
    )
    return found if status is None else found.join(status, "site", "left")


def land_and_judge(
    staged: DataFrame, existing: DataFrame, labels: DataFrame | None, judged_at: Column
) -> tuple[DataFrame, DataFrame]:
    """New staging rows and their first verdicts."""
    fresh = new_rows(staged, existing, ["id"])
    return fresh, verdict_rows(fresh, labels, judged_at)


def fresh_rows(df: DataFrame, ts: str, hours: int = FRESH_HOURS) -> DataFrame:
    """Rows at most ``hours`` older than the newest one (a one-row aggregate, joined by value)."""
    newest = df.agg(F.max(ts).alias("_newest"))
    cutoff = newest.select(F.timestamp_add("HOUR", F.lit(-hours), F.col("_newest")))
    return df.filter(F.col(ts) >= cutoff.scalar())
