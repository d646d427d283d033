"""Human triage of titles: candidates, metrics, label overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import TRIAGE_LIMIT
from rolesift.functions.keys import title_norm
from rolesift.operators.dedup import first_per_key

LABEL_KEYS = ["profile_id", "title_norm"]


def with_title_norm(judged: DataFrame, title: str = "job_title") -> DataFrame:
    return judged.withColumn("title_norm", title_norm(F.col(title)))


def match_labels(judged: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Judged rows with the label of their title in their own profile."""
    known = labels.select(*LABEL_KEYS, F.col("label").alias("user_label"))
    return with_title_norm(judged).join(known, LABEL_KEYS, how)


def apply_labels(
    judged: DataFrame, labels: DataFrame, now: Column, profile_id: str | None = None
) -> DataFrame:
    """Verdicts overridden by accept / reject labels; only changed rows get a new time."""
    if profile_id is not None:
        labels = labels.filter(F.col("profile_id") == profile_id)
    matched = match_labels(judged, labels, "left")
    decided = F.col("user_label").isin("accept", "reject")
    changed = F.coalesce(decided & (F.col("ensemble_verdict") != F.col("user_label")), F.lit(False))
    return matched.withColumns(
        {
            "judged_at": F.when(changed, now).otherwise(F.col("judged_at")),
            "ensemble_verdict": F.when(changed, F.col("user_label")).otherwise(
                F.col("ensemble_verdict")
            ),
            "changed": changed,
        }
    ).select(*judged.columns, "changed")


def label_match_count(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Per profile: judged rows whose title carries any label (``unsure`` included)."""
    titles = with_title_norm(judged).groupBy(*LABEL_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    known = labels.select(*LABEL_KEYS, "label")
    return titles.join(known, LABEL_KEYS).groupBy("profile_id").agg(
        F.sum("_n").alias("matched_rows"),
        F.sum(F.when(F.col("label") != "unsure", F.col("_n")).otherwise(0)).alias("decided_rows"),
    )


def triage_candidates(
    judged: DataFrame,
    staging: DataFrame,
    labels: DataFrame,
    profile_id: str,
    include_decided: bool = False,
    limit: int = TRIAGE_LIMIT,
) -> DataFrame:
    """Titles of a profile, most frequent first, with a sample of their attributes.

    Titles are grouped before the labels are joined: the label depends on the
    group key only.
    """
    mine = judged.filter(F.col("profile_id") == profile_id)
    companies = staging.select(F.col("id").alias("job_id"), "company")
    titles = (
        with_title_norm(mine).join(companies, "job_id")
        .groupBy("title_norm", F.col("job_title").alias("display_title"))
        .agg(
            F.min("company").alias("company_sample"),
            F.count(F.lit(1)).alias("count"),
            F.min("rule_verdict").alias("rule_verdict"),
            F.min("ensemble_verdict").alias("ensemble_verdict"),
        )
    )
    own = labels.filter(F.col("profile_id") == profile_id).select(
        "title_norm", F.col("label").alias("user_label")
    )
    joined = titles.join(own, "title_norm", "left")
    if not include_decided:
        joined = joined.filter("user_label is null or user_label = 'unsure'")
    order = [F.col("count").desc(), F.col("title_norm"), F.col("display_title")]
    return joined.orderBy(*order).limit(limit)


def _titles(judged: DataFrame) -> DataFrame:
    """One row per (profile, title) with the verdicts its postings have."""
    verdict = F.col("ensemble_verdict")
    return (
        with_title_norm(judged).filter("title_norm is not null")
        .groupBy(*LABEL_KEYS)
        .agg(
            *[
                F.max(F.coalesce(verdict == v, F.lit(False))).alias(f"_{v}")
                for v in ("accept", "reject", "review")
            ]
        )
    )


def triage_metrics(judged: DataFrame) -> DataFrame:
    """Distinct titles per profile: all, accepted, rejected (one grouping pass)."""
    return (
        _titles(judged).filter("profile_id is not null")
        .groupBy("profile_id")
        .agg(
            F.count(F.lit(1)).alias("total_titles"),
            F.count_if("_accept").alias("accepted"),
            F.count_if("_reject").alias("rejected"),
        )
    )


def triage_pending(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct titles per profile that have a review verdict and no label."""
    open_titles = _titles(judged).filter("profile_id is not null and _review")
    return (
        open_titles.join(labels.select(*LABEL_KEYS), LABEL_KEYS, "left_anti")
        .groupBy("profile_id")
        .agg(F.count(F.lit(1)).alias("pending"))
    )


def editor_view(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "display_title", "company_sample", "count", "rule_verdict", "ensemble_verdict",
        F.coalesce("user_label", F.lit("")).alias("label"),
    )


def bulk_label(editor: DataFrame, action: str) -> DataFrame:
    """Accept or reject every title the rule left for review, or clear all labels."""
    if action == "clear":
        return editor.withColumn("label", F.lit(""))
    if action not in ("accept", "reject"):
        raise ValueError(f"unknown action: {action}")
    label = F.when(F.col("rule_verdict") == "review", action).otherwise(F.col("label"))
    return editor.withColumn("label", label)


def changed_labels(edited: DataFrame, original: DataFrame) -> DataFrame:
    """Non-blank labels that differ from the stored one, matched on the display title."""
    stored = first_per_key(
        original.select("display_title", F.trim(F.coalesce("user_label", F.lit(""))).alias("_old")),
        ["display_title"], [F.col("_old")],
    )
    new = edited.withColumn("label", F.trim(F.coalesce("label", F.lit(""))))
    joined = new.filter("label <> ''").join(stored, "display_title", "left")
    return joined.filter(F.col("label") != F.coalesce("_old", F.lit(""))).select(
        title_norm(F.col("display_title")).alias("title_norm"), "display_title", "label"
    )


def list_labels(labels: DataFrame, profile_id: str | None = None) -> DataFrame:
    if profile_id is not None:
        labels = labels.filter(F.col("profile_id") == profile_id)
    return labels.select(
        "profile_id", "title_norm", "label", "note", "count_seen", "updated_at"
    ).orderBy("profile_id", F.col("count_seen").desc(), "title_norm")


def label_summary(labels: DataFrame) -> DataFrame:
    """Label counts per profile with zeros filled in; unknown labels do not count."""
    counts = {v: F.count_if(F.col("label") == v) for v in ("accept", "reject", "unsure")}
    return labels.groupBy("profile_id").agg(
        *[c.alias(v) for v, c in counts.items()],
        F.count_if(F.col("label").isin(*counts)).alias("total"),
    )
