"""Reads behind the dashboard: wide fact rows, filters, filter options, counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.constants import FACT_LIMIT_DEFAULT, FACT_LIMIT_MAX
from rolesift.session import written


def newest_first() -> list:
    return [F.col("date_posted").desc_nulls_last(), F.col("scraped_at").desc(), F.col("job_id")]


def fact_with_dims(
    fact: DataFrame,
    dim_location: DataFrame,
    dim_salary: DataFrame,
    enriched: DataFrame | Callable[[DataFrame], DataFrame],
    *,
    keyword: str | None = None,
    profile_id: str | None = None,
    limit: int = FACT_LIMIT_DEFAULT,
    limit_max: int = FACT_LIMIT_MAX,
) -> DataFrame:
    """The newest facts with their location, salary and skills (runs one job for the top-k).

    All three lookups keep every fact, so the top-k is taken on the fact alone and
    written. It has at most ``limit_max`` rows (a larger limit raises): its keys are broadcast to thin out
    each lookup table in place, and so are the lookup rows found, one per key. ``enriched`` is a table, or
    makes the enriched rows of the postings it is given (job_id).
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if limit > limit_max:
        raise ValueError(f"limit {limit} is above the reader's maximum of {limit_max}")
    if keyword:
        fact = fact.filter(F.col("search_keyword") == keyword)
    if profile_id:
        fact = fact.filter(F.col("profile_id") == profile_id)
    top = fact.orderBy(*newest_first()).limit(limit)
    wide = top = written(top, "newest-facts")
    salary = dim_salary.select(
        "salary_key",
        F.col("min_amount").alias("salary_min"), F.col("max_amount").alias("salary_max"),
        F.col("currency").alias("salary_currency"), F.col("period").alias("salary_period"),
    )
    found = enriched(top.select("job_id")) if callable(enriched) else enriched
    skills = found.select("job_id", "tech_skills", "soft_skills", "domain_skills")
    for lookup, key in (
        (dim_location, "location_key"), (salary, "salary_key"), (skills, "job_id")
    ):
        needed = lookup.join(F.broadcast(top.select(key)), key, "left_semi")
        wide = wide.join(F.broadcast(needed), key, "left")
    columns = [
        "job_id", "run_id", "profile_id", "site", "search_keyword", "company", "title", "job_url",
        "date_posted", "work_mode", "city", "country", "country_code", "salary_min", "salary_max",
        "salary_currency", "salary_period", "tech_skills", "soft_skills", "domain_skills",
        "scraped_at", "enriched_at",
    ]
    return wide.select(columns).orderBy(*newest_first())


def apply_filters(df: DataFrame, **choices: Sequence[str] | None) -> DataFrame:
    """Keep rows whose columns are among the chosen values; an empty choice filters nothing."""
    for column, values in choices.items():
        if values and column in df.columns:
            df = df.filter(F.col(column).isin(*values))
    return df


def filter_options(fact: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Sorted distinct keywords and countries that occur in the facts."""
    keywords = fact.select(F.lit("keyword").alias("kind"), F.col("search_keyword").alias("value"))
    used = fact.select("location_key").distinct()
    countries = dim_location.join(used, "location_key", "left_semi").select(
        F.lit("country").alias("kind"), F.col("country").alias("value")
    )
    return (
        keywords.dropna().distinct()
        .unionByName(countries.dropna().distinct())
        .orderBy("kind", "value")
    )


def count_jobs(fact: DataFrame, profile_id: str | None = None) -> DataFrame:
    if profile_id is not None:
        fact = fact.filter(F.col("profile_id") == profile_id)
    return fact.agg(F.count(F.lit(1)).alias("jobs"))
