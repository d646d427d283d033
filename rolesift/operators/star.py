"""Star schema from gated enriched postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import SKILL_TYPES
from rolesift.functions.keys import location_key, norm, salary_key, skill_key
from rolesift.operators.dedup import first_per_key
from rolesift.schemas import schema_of


def passes_gate(verdict: Column) -> Column:
    """Whether a posting with that verdict, null if never judged, goes on to the star."""
    return F.coalesce(verdict == "accept", F.lit(True))


def load_enriched(staging: DataFrame, enriched: DataFrame, judged: DataFrame) -> DataFrame:
    """Enriched postings that were accepted or never judged (``review`` is left out)."""
    s = staging.select(
        F.col("id").alias("job_id"), "run_id", "profile_id", "scraped_at", "site",
        "search_keyword", "company", "title", "job_url", "date_posted",
    )
    e = enriched.select(
        "job_id", "enriched_at", "tech_skills", "soft_skills", "domain_skills", "city", "country",
        "country_code", "work_mode", "salary_min", "salary_max", "salary_currency",
        "salary_period",
    )
    verdict = judged.select("job_id", "ensemble_verdict")
    joined = s.join(e, "job_id").join(verdict, "job_id", "left")
    return joined.filter(passes_gate(F.col("ensemble_verdict"))).drop("ensemble_verdict")


def _kept_if(x: str, test: Column) -> Column:
    return F.when(norm(test) != "", F.col(x))


def build_dim_location(enriched: DataFrame) -> DataFrame:
    """One row per (city, country code), spelled as in the posting seen first.

    Equal spellings are counted down by a hash aggregate before the ordered
    choice, so the ordering only sees distinct spellings.
    """
    spellings = enriched.groupBy("city", "country", "country_code").agg(
        F.min("scraped_at").alias("_seen")
    )
    keyed = spellings.withColumn("location_key", location_key(F.col("city"), F.col("country_code")))
    order = [F.col(c).asc_nulls_last() for c in ("_seen", "city", "country", "country_code")]
    first = first_per_key(keyed, ["location_key"], order)
    return first.select(
        "location_key",
        *[_kept_if(c, F.col(c)).alias(c) for c in ("city", "country", "country_code")],
    )


def build_dim_salary(enriched: DataFrame) -> DataFrame:
    """One row per (min, max, currency, period); the all-NULL salary is a row too."""
    spellings = enriched.groupBy(
        "salary_min", "salary_max", "salary_currency", "salary_period"
    ).agg(F.min("scraped_at").alias("_seen"))
    keyed = spellings.withColumn(
        "salary_key",
        salary_key(*(F.col(c) for c in spellings.columns if c != "_seen")),
    )
    order = [F.col(c).asc_nulls_last() for c in ("_seen", "salary_currency", "salary_period")]
    first = first_per_key(keyed, ["salary_key"], order)
    return first.select(
        "salary_key",
        F.nanvl("salary_min", F.lit(None).cast("double")).alias("min_amount"),
        F.nanvl("salary_max", F.lit(None).cast("double")).alias("max_amount"),
        _kept_if("salary_currency", F.col("salary_currency")).alias("currency"),
        _kept_if("salary_period", F.col("salary_period")).alias("period"),
    )


def skill_rows(enriched: DataFrame) -> DataFrame:
    """(job_id, name, skill_type), each once per posting.

    A posting's lists are merged and made distinct inside its row; ``job_id`` is
    unique, so no exchange is needed for that.
    """

    def typed(kind: str):
        names = F.coalesce(F.col(f"{kind}_skills"), F.array().cast("array<string>"))
        return F.transform(
            names, lambda n: F.struct(norm(n).alias("name"), F.lit(kind).alias("skill_type"))
        )

    merged = F.concat(*(typed(kind) for kind in SKILL_TYPES))
    distinct = F.array_distinct(F.filter(merged, lambda s: s["name"] != ""))
    return enriched.select("job_id", F.inline(distinct))


def build_dim_skill(skills: DataFrame) -> DataFrame:
    names = skills.select("name", "skill_type").distinct()
    return names.select(
        skill_key(F.col("name"), F.col("skill_type")).alias("skill_key"), "name", "skill_type"
    )


def build_bridge(skills: DataFrame) -> DataFrame:
    return skills.select(
        "job_id", skill_key(F.col("name"), F.col("skill_type")).alias("skill_key")
    )


def build_fact(enriched: DataFrame) -> DataFrame:
    """Fact rows; surrogate keys are recomputed from the natural ones, no join needed."""
    keyed = enriched.withColumns(
        {
            "location_key": location_key(F.col("city"), F.col("country_code")),
            "salary_key": salary_key(
                F.col("salary_min"), F.col("salary_max"),
                F.col("salary_currency"), F.col("salary_period"),
            ),
            "work_mode": _kept_if("work_mode", F.col("work_mode")),
        }
    )
    return keyed.select(schema_of("fact_job_offers").names)


STAR = ("dim_location", "dim_salary", "dim_skill", "fact_job_offers", "job_skill_bridge")
#: The lists of a posting, and the star tables that are built from them.
SKILL_LISTS = tuple(f"{kind}_skills" for kind in SKILL_TYPES)
SKILL_TABLES = ("dim_skill", "job_skill_bridge")


def star_frame(gated: DataFrame, table: str) -> DataFrame:
    """Candidate rows of one star table."""
    if table == "dim_skill":
        return build_dim_skill(skill_rows(gated))
    if table == "job_skill_bridge":
        return build_bridge(skill_rows(gated))
    build = {
        "dim_location": build_dim_location,
        "dim_salary": build_dim_salary,
        "fact_job_offers": build_fact,
    }
    return build[table](gated)


def star_frames(gated: DataFrame) -> dict[str, DataFrame]:
    return {table: star_frame(gated, table) for table in STAR}
