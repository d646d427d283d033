"""Run registry: state, history, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.normalize import coerce_list
from rolesift.functions.timing import duration_seconds, format_duration
from rolesift.operators.dedup import first_per_key


def run_registry(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Current state of every run: its start row updated by its finish row, if any."""
    done = finishes.select(
        "run_id", "finished_at", F.col("status").alias("_status"), "scraped_count",
        "enriched_count", "error_message",
    )
    return starts.join(done, "run_id", "left").select(
        "run_id", "profile_id", "started_at", "finished_at",
        F.coalesce("_status", F.lit("running")).alias("status"),
        F.coalesce("scraped_count", F.lit(0)).cast("bigint").alias("scraped_count"),
        F.coalesce("enriched_count", F.lit(0)).cast("bigint").alias("enriched_count"),
        "error_message",
    )


def latest_run(runs: DataFrame, profile_id: str | None = None) -> DataFrame:
    if profile_id is not None:
        runs = runs.filter(F.col("profile_id") == profile_id)
    return recent_runs(runs, 1).select(*_STATUS)


def latest_run_per_profile(runs: DataFrame) -> DataFrame:
    return first_per_key(runs.select(*_STATUS), ["profile_id"], _newest())


_STATUS = ("run_id", "started_at", "finished_at", "status", "profile_id")


def _newest() -> list[Column]:
    return [F.col("started_at").desc(), F.col("run_id").desc()]


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(*_newest()).limit(limit)


def history_filter(
    runs: DataFrame,
    statuses: Sequence[str] | None = None,
    profile_id: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Runs of the chosen statuses and profile that started between two days, both included.

    The day bounds are put on the timestamp itself, so they reach the scan.
    """
    if statuses:
        runs = runs.filter(F.col("status").isin(*statuses))
    if profile_id is not None:
        runs = runs.filter(F.col("profile_id") == profile_id)
    day = lambda text: F.lit(text).cast("date").cast("timestamp_ntz")
    if start is not None:
        runs = runs.filter(F.col("started_at") >= day(start))
    if end is not None:
        runs = runs.filter(F.col("started_at") < F.timestamp_add("DAY", F.lit(1), day(end)))
    return runs


def with_durations(runs: DataFrame) -> DataFrame:
    timed = runs.withColumn(
        "duration_seconds", duration_seconds(F.col("started_at"), F.col("finished_at"))
    )
    return timed.withColumn("duration", format_duration(F.col("duration_seconds")))


def history_view(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Runs as the history table shows them: short id, profile name, duration, keyword text."""
    names = profiles.select("profile_id", F.col("name").alias("_name"))
    joined = with_durations(runs).join(names, "profile_id", "left")
    return joined.select(
        F.substring("run_id", 1, 8).alias("run_id"),
        F.coalesce("_name", F.nullif("profile_id", F.lit("")), F.lit("-")).alias("profile"),
        "started_at",
        "duration",
        "status",
        F.array_join(coerce_list(F.col("keywords")), ", ").alias("keywords"),
        F.col("scraped_count").alias("scraped"),
        F.col("enriched_count").alias("enriched"),
        F.col("error_message").alias("error"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals over runs; the success rate of no runs is 0 %."""
    timed = with_durations(runs)
    success = F.count_if(F.col("status") == "success")
    total = F.count(F.lit(1))
    return timed.agg(
        total.alias("total_runs"),
        F.when(total > 0, success * 100.0 / total).otherwise(0.0).alias("success_pct"),
        F.avg("duration_seconds").alias("avg_duration"),
        F.coalesce(F.sum("scraped_count"), F.lit(0)).alias("total_scraped"),
    )
