"""Star schema and marts from gated enriched postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators import marts as M
from rolesift.operators import star as S
from rolesift.operators.upsert import new_rows
from rolesift.schemas import MARTS, PRIMARY_KEYS
from rolesift.session import written
from rolesift.sources.tables import Tables

MART_INPUTS = {
    "mart_jobs_by_country": (M.jobs_by_country, ("fact_job_offers", "dim_location")),
    "mart_skills_by_keyword": (
        M.skills_by_keyword, ("fact_job_offers", "job_skill_bridge", "dim_skill")
    ),
    "mart_salary_by_keyword": (M.salary_by_keyword, ("fact_job_offers", "dim_salary")),
    "mart_work_mode_distribution": (M.work_mode_distribution, ("fact_job_offers",)),
}


def mart_frames(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four marts of a star."""
    return {m: make(*(star[t] for t in inputs)) for m, (make, inputs) in MART_INPUTS.items()}


#: What the verdict gate joins.
SOURCES = ("staging_job_offers", "int_enriched_job_info", "judged_job_offers")

# The fact comes last: a posting without one is offered again in full by the next pass.
WRITE_ORDER = ("dim_location", "dim_salary", "dim_skill", "job_skill_bridge", "fact_job_offers")


def add_to_star(tables: Tables, candidates: dict[str, DataFrame]) -> dict[str, int]:
    """Append the rows with new keys to each star table; files that are there stay untouched."""
    return {
        t: tables.append(t, new_rows(candidates[t], tables.read(t), PRIMARY_KEYS[t])) for t in WRITE_ORDER
    }


def pending_sources(tables: Tables) -> list[DataFrame]:
    """Staging, enriched and judged rows of the postings that have no fact yet.

    Their ids come first, from two id columns, and are written: while they are few Spark broadcasts
    them, and the three tables are scanned but not exchanged. A posting with a fact has all its star
    rows, as the fact is written last.
    """
    facts = tables.read("fact_job_offers").select("job_id")
    if facts.isEmpty():
        return [tables.read(t) for t in SOURCES]
    ids = written(new_rows(tables.read("int_enriched_job_info").select("job_id"), facts, ["job_id"]), "transform-ids")
    key = {t: PRIMARY_KEYS[t][0] for t in SOURCES}
    return [tables.read(t).join(ids.withColumnRenamed("job_id", key[t]), key[t], "left_semi") for t in SOURCES]


def run_transform(spark: SparkSession, tables: Tables, rebuild: bool = False, only_new: bool = False) -> DataFrame:
    """Bring star and marts up to date with the written tables; returns a summary row.

    The three-way join of the verdict gate is written once and feeds all five star
    tables. Existing rows stay as they are and new keys are appended; ``rebuild`` starts
    from nothing. ``only_new`` leaves postings that have a fact out of the join: history is scanned
    for ids but not exchanged, the candidates of the summary are those of new postings, and new skills of a
    posting enriched anew wait for a pass without it. Marts read the written star. An empty input still refreshes the marts.
    """
    sources = pending_sources(tables) if only_new and not rebuild else [tables.read(t) for t in SOURCES]
    gated = S.load_enriched(*sources)
    candidates = S.star_frames(written(gated, "gated"))
    if rebuild:
        before = {t: tables.read(t).count() for t in S.STAR}
        tables.publish(candidates)
        added = {t: tables.read(t).count() - n for t, n in before.items()}
    else:
        added = add_to_star(tables, candidates)
    after = {t: tables.read(t) for t in S.STAR}
    now = F.current_timestamp().cast("timestamp_ntz")
    refreshed = tables.refresh_marts(
        {n: df.withColumn("refreshed_at", now) for n, df in mart_frames(after).items()}
    )
    assert refreshed == len(MARTS)
    return transform_summary(candidates, added)


def transform_summary(
    candidates: dict[str, DataFrame], added: dict[str, int] | None = None
) -> DataFrame:
    """One row per star table: candidate rows, and rows really added where they are known."""
    out = None
    for table in S.STAR:
        row = candidates[table].agg(
            F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("candidates")
        )
        if added is not None:
            row = row.withColumn("added", F.lit(added[table]).cast("bigint"))
        out = row if out is None else out.unionByName(row)
    return out
