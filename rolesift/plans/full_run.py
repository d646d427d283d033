"""A whole run: register, land, judge, enrich, correct, transform, close the registry row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators.corrective import Proposer
from rolesift.operators.relevance import FewShot, fewshot_scores
from rolesift.operators.rules import verdict_rows
from rolesift.operators.upsert import new_rows, replace_by_key
from rolesift.plans.cascade import CascadeResult, pending_rows, relevance_cascade
from rolesift.plans.corrective import corrective_pass
from rolesift.plans.transform import run_transform
from rolesift.schemas import align_table
from rolesift.session import written
from rolesift.sources.tables import Tables


def _now():
    return F.current_timestamp().cast("timestamp_ntz")


def start_run(
    tables: Tables, run_id: str, profile_id: str | None, requests: DataFrame | None = None
) -> None:
    """Add the run as ``running``; its request lists are read from the request frame."""
    lists = ("keyword", "location", "site")
    if requests is None:
        row = tables.spark.range(1).select(
            *[F.array().cast("array<string>").alias(f"{c}s") for c in lists]
        )
    else:
        row = requests.agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in lists])
    started = row.select(
        "*", F.lit(run_id).alias("run_id"),
        F.lit(profile_id).cast("string").alias("profile_id"), _now().alias("started_at"),
        F.lit("running").alias("status"),
        F.lit(0).cast("bigint").alias("scraped_count"),
        F.lit(0).cast("bigint").alias("enriched_count"),
    )
    tables.append("pipeline_runs", started)


def finish_run(
    tables: Tables, run_id: str, status: str, scraped: int, enriched: int, error: str | None = None
) -> None:
    """Close the run's registry row."""
    runs = tables.read("pipeline_runs")
    closed = runs.filter(F.col("run_id") == run_id).withColumns(
        {
            "finished_at": _now(),
            "status": F.lit(status),
            "scraped_count": F.lit(scraped).cast("bigint"),
            "enriched_count": F.lit(enriched).cast("bigint"),
            "error_message": F.lit(error).cast("string"),
        }
    )
    tables.publish({"pipeline_runs": replace_by_key(runs, closed, ["run_id"])})


def land(tables: Tables, staged: DataFrame) -> int:
    """Append the new postings of a batch and their first verdicts; returns how many landed.

    Verdicts are given to the batch's written postings that have none, so a batch that died
    between the two writes is completed by landing it again. Where there is history, the batch's ids are written
    first: while they are few, Spark broadcasts them and history is not exchanged. Where there is none, the
    batch is the table and neither its ids nor its rows are exchanged.
    """
    history = tables.read("staging_job_offers")
    judged = tables.read("judged_job_offers").select(F.col("job_id").alias("id"))
    if history.isEmpty():
        landed = tables.append("staging_job_offers", staged)
        mine = tables.read("staging_job_offers")
    else:
        ids = written(staged.select("id").distinct(), "landing-ids")
        landed = tables.append("staging_job_offers", new_rows(staged, history.join(ids, "id", "left_semi"), ["id"]))
        mine = tables.read("staging_job_offers").join(ids, "id", "left_semi")
        judged = judged.join(ids, "id", "left_semi")
    labels = tables.read("profile_title_labels")
    tables.append("judged_job_offers", verdict_rows(new_rows(mine, judged, ["id"]), labels, _now()))
    return landed


def train_classifiers(tables: Tables) -> FewShot | None:
    """Train the title classifiers on the stored labels and publish them for later sessions.

    Without a profile that has enough labels the published ones are replaced by none.
    """
    model = FewShot.train(tables.read("profile_title_labels"))
    if model is None:
        if FewShot.load(tables) is not None:
            tables.publish({t: tables.read(t).limit(0) for t in ("fewshot_profiles", "fewshot_weights")})
        return None
    model.save(tables)
    return FewShot.load(tables)


def enrich(
    tables: Tables,
    extract: Callable[[DataFrame], DataFrame],
    run_id: str | None = None,
    limit: int | None = None,
    learn: bool = False,
    recall: bool = False,
    **scorers,
) -> dict[str, int]:
    """Run the cascade over pending postings and write its verdicts and enriched rows.

    ``learn`` trains and publishes the title classifiers on the stored labels first and lets
    them veto; ``recall`` lets the published ones veto, without training.
    """
    if learn or recall:
        model = train_classifiers(tables) if learn else FewShot.load(tables)
        scorers["fewshot"] = lambda rows: fewshot_scores(model, rows, "id")
    staging, judged = tables.read("staging_job_offers"), tables.read("judged_job_offers")
    known = tables.read("int_enriched_job_info")
    todo = pending_rows(staging, known, judged, run_id=run_id, limit=limit)
    result: CascadeResult = relevance_cascade(todo, extract, _now(), **scorers)
    updated = result.update(judged)
    enriched = new_rows(align_table(result.enriched, "int_enriched_job_info"), known, ["job_id"])
    counts = result.status.groupBy().agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    ).first()
    # verdicts first: a pass that dies between the writes finds its postings pending again
    tables.publish({"judged_job_offers": updated})
    tables.append("int_enriched_job_info", enriched)
    return counts.asDict()


def full_run(
    spark: SparkSession,
    tables: Tables,
    run_id: str,
    staged: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    *,
    profile_id: str | None = None,
    requests: DataFrame | None = None,
    fetch: Callable[[DataFrame], DataFrame | None] | None = None,
    propose: Callable[[], Proposer] | None = None,
    limit: int | None = None,
    learn: bool = False,
    by: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Run all steps over one batch of staged postings and return the transform summary.

    ``fetch`` turns corrective requests into further staged postings; there is at most
    one corrective round. ``propose`` makes the model that names alternatives, else counts do. A failure closes the run as ``failed`` and is raised again.
    """
    start_run(tables, run_id, profile_id, requests)
    scraped = enriched = 0
    try:
        scraped = land(tables, staged)
        enriched = enrich(tables, extract, limit=limit, learn=learn)["succeeded"]
        if fetch is not None:
            found = corrective_pass(
                tables.read("judged_job_offers"), tables.read("staging_job_offers"),
                run_id=run_id, profile_id=profile_id, propose=propose, by=by,
            )
            more = fetch(found.requests)
            if more is not None:
                scraped += land(tables, more)
                enriched += enrich(tables, extract, limit=limit, learn=learn)["succeeded"]
        summary = run_transform(spark, tables, only_new=True)
    except Exception as problem:
        finish_run(
            tables, run_id, "failed", scraped, enriched, f"{type(problem).__name__}: {problem}"
        )
        raise
    finish_run(tables, run_id, "success", scraped, enriched)
    return summary
