"""The title rule over frames: blocklist, overlap score, verdict rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.functions.keys import norm
from rolesift.functions.text import rule_reason, rule_verdict, title_score


def with_blocked_flag(postings: DataFrame, labels: DataFrame, title: str = "title") -> DataFrame:
    """Add ``blocked``: the title is on the reject list of the posting's own profile."""
    rejected = labels.filter(F.col("label") == "reject").select(
        F.col("profile_id").alias("_profile"), F.col("title_norm").alias("_title"),
        F.lit(True).alias("_hit"),
    )
    keyed = postings.withColumn("_norm", F.nullif(norm(F.col(title)), F.lit("")))
    joined = keyed.join(
        rejected,
        (keyed["profile_id"] == rejected["_profile"]) & (keyed["_norm"] == rejected["_title"]),
        "left",
    )
    return joined.withColumn("blocked", F.col("_hit").isNotNull()).drop(
        "_norm", "_profile", "_title", "_hit"
    )


def judge_titles(
    postings: DataFrame, labels: DataFrame | None = None, title: str = "title"
) -> DataFrame:
    """Add ``title_overlap``, ``rule_verdict`` and ``rule_reason`` to posting rows."""
    flagged = (
        postings.withColumn("blocked", F.lit(False))
        if labels is None
        else with_blocked_flag(postings, labels, title)
    )
    score = title_score(F.col(title), F.col("search_keyword"))
    blocked = F.col("blocked")
    return flagged.withColumn("title_overlap", score).withColumns(
        {
            "rule_verdict": rule_verdict(F.col("title_overlap"), blocked),
            "rule_reason": rule_reason(F.col("title_overlap"), blocked),
        }
    )


def verdict_rows(staging: DataFrame, labels: DataFrame | None, judged_at) -> DataFrame:
    """First-pass rows of the judged table: the ensemble verdict starts as the rule's."""
    judged = judge_titles(staging, labels)
    return judged.select(
        F.col("id").alias("job_id"),
        "profile_id",
        "search_keyword",
        F.col("title").alias("job_title"),
        "rule_verdict",
        "rule_reason",
        F.col("rule_verdict").alias("ensemble_verdict"),
        judged_at.alias("judged_at"),
    )
