"""What a person decides, written back: labels, overridden verdicts, search profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.operators.profiles import clean_profiles
from rolesift.operators.triage import apply_labels
from rolesift.operators.upsert import delete_by_key, replace_by_key, upsert_labels
from rolesift.sources.tables import Tables


def save_labels(tables: Tables, incoming: DataFrame, now: Column) -> None:
    """Publish the labels with the incoming ones saved; unknown labels are refused."""
    labels = tables.read("profile_title_labels")
    tables.publish({"profile_title_labels": upsert_labels(labels, incoming, now)})


def apply_labels_to_judged(tables: Tables, now: Column, profile_id: str | None = None) -> int:
    """Publish the judged table with its verdicts overridden by the stored labels; returns how many changed."""
    judged, labels = tables.read("judged_job_offers"), tables.read("profile_title_labels")
    decided = apply_labels(judged, labels, now, profile_id)
    changed = decided.filter("changed").count()
    if changed:
        tables.publish({"judged_job_offers": decided.drop("changed")})
    return changed


def save_profiles(tables: Tables, profiles: DataFrame, now: Column) -> None:
    """Publish valid profiles in place of the known ones of their id, which keep their creation time."""
    known = tables.read("user_search_profiles")
    first = known.select("profile_id", F.col("created_at").alias("_created"))
    rows = clean_profiles(profiles).filter("valid and profile_id is not null").join(first, "profile_id", "left")
    stamped = rows.withColumns({"created_at": F.coalesce("_created", now), "updated_at": now})
    tables.publish({"user_search_profiles": replace_by_key(known, stamped.select(known.columns), ["profile_id"])})


def delete_profiles(tables: Tables, doomed: DataFrame) -> None:
    """Publish the profiles without those whose ``profile_id`` is listed."""
    known = tables.read("user_search_profiles")
    tables.publish({"user_search_profiles": delete_by_key(known, doomed, ["profile_id"])})
