"""The relevance cascade: cheap checks first, extraction only for what is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import SEMANTIC_THRESHOLD
from rolesift.functions.normalize import ensemble_verdict
from rolesift.functions.text import relevance_doc
from rolesift.operators.relevance import lexical_semantic, pair_score_bm25
from rolesift.operators.upsert import upsert_update
from rolesift.session import written

ENRICHED_COLUMNS = (
    "tech_skills", "soft_skills", "domain_skills", "city", "country", "country_code",
    "work_mode", "salary_min", "salary_max", "salary_currency", "salary_period",
)

_PENDING = ("id", "title", "description", "search_keyword", "profile_id", "rule_verdict")

# Columns an update of a known verdict row may change, per kind of row.
SCORE_COLUMNS = (
    "biencoder_score", "crossencoder_score", "setfit_score", "ensemble_verdict", "judged_at",
)
EXTRACTOR_COLUMNS = ("llm_is_relevant", "llm_confidence", "llm_reason")


def pending_rows(
    staging: DataFrame,
    enriched: DataFrame,
    judged: DataFrame,
    *,
    run_id: str | None = None,
    limit: int | None = None,
    skip_rejected: bool = False,
) -> DataFrame:
    """Postings to enrich: not enriched yet and not rejected by the title rule.

    ``skip_rejected`` also leaves out rows an earlier pass has rejected; without it
    they are scored again in every pass. A limit of zero or less selects nothing.
    """
    if run_id is not None:
        staging = staging.filter(F.col("run_id") == run_id)
    verdicts = judged.select(
        F.col("job_id").alias("id"), "rule_verdict", F.col("ensemble_verdict").alias("_ensemble")
    )
    todo = staging.join(enriched.select(F.col("job_id").alias("id")), "id", "left_anti").join(
        verdicts, "id", "left"
    )
    todo = todo.filter(F.coalesce(F.col("rule_verdict") != "reject", F.lit(True)))
    if skip_rejected:
        todo = todo.filter(F.coalesce(F.col("_ensemble") != "reject", F.lit(True)))
    todo = todo.drop("_ensemble")
    if limit is None:
        return todo
    if limit <= 0:
        return todo.filter(F.lit(False))
    return todo.orderBy("scraped_at", "id").limit(limit)


@dataclass(frozen=True)
class CascadeResult:
    """What one pass found: verdicts, new enriched rows, one status row per posting."""

    judged: DataFrame
    prerejected: DataFrame
    enriched: DataFrame
    status: DataFrame

    def verdicts(self) -> DataFrame:
        return self.judged.unionByName(self.prerejected)

    def update(self, target: DataFrame) -> DataFrame:
        """The judged table after this pass; title and rule columns of known rows stay.

        A posting is judged or rejected before, never both, so one merge takes them all.
        """
        both = self.judged.withColumn("_read", F.lit(True)).unionByName(
            self.prerejected.withColumn("_read", F.lit(False))
        )
        return upsert_update(target, both, ["job_id"], SCORE_COLUMNS, ("_read", EXTRACTOR_COLUMNS))


def relevance_cascade(
    pending: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    now: Column,
    *,
    semantic: Callable[[DataFrame], DataFrame] | None = None,
    pair: Callable[[DataFrame], DataFrame] | None = None,
    fewshot: Callable[[DataFrame], DataFrame] | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = written,
    provider: tuple[str, str] = ("rules", "v1"),
) -> CascadeResult:
    """Score pending postings in order of cost and judge those that survive.

    ``semantic`` adds ``semantic_score``; ``pair`` and ``fewshot`` return (id, score) for
    the survivors; ``extract`` returns (id, fields, is_relevant, relevance_confidence,
    relevance_reason) for the records it could read. ``keep`` holds the stages that are
    read more than once, the scored rows and the outcome, in the shared folder, so
    no scorer or extractor runs twice.
    """
    title_only = lambda df: lexical_semantic(df, "search_keyword", "title")
    low = F.col("semantic_score") < SEMANTIC_THRESHOLD
    # only survivors keep their text
    text = F.when(low, None).otherwise(F.col("description")).alias("description")
    columns = [text if c == "description" else F.col(c) for c in _PENDING]
    scored = keep((semantic or title_only)(pending).select(*columns, "semantic_score"), "scored")
    rejected, survivors = scored.filter(low), scored.filter(~low)

    doc = relevance_doc(F.col("title"), F.col("description"))
    by_text = lambda df: pair_score_bm25(
        df.withColumn("_doc", doc), "id", "search_keyword", "_doc"
    )
    ranked = survivors.join((pair or by_text)(survivors), "id", "left")
    if fewshot is not None:
        ranked = ranked.join(fewshot(survivors), "id", "left")
    else:
        ranked = ranked.withColumn("fewshot_score", F.lit(1.0))
    read = extract(survivors).withColumn("_read", F.lit(True))
    outcome = keep(ranked.drop("description").join(read, "id", "left"), "outcome")
    done = outcome.filter("_read")

    enriched = done.select(
        F.col("id").alias("job_id"), now.alias("enriched_at"),
        F.lit(provider[0]).alias("llm_provider"), F.lit(provider[1]).alias("llm_model"),
        *ENRICHED_COLUMNS, _record().alias("raw_response"),
    )
    # a row rejected by its semantic score counts as dealt with
    status = rejected.select("id", F.lit("succeeded").alias("status")).unionByName(
        outcome.select("id", F.when(F.col("_read"), "succeeded").otherwise("failed").alias("status"))
    )
    return CascadeResult(_judged(done, now), _prerejected(rejected, now), enriched, status)


def _record() -> Column:
    """The normalised record of a posting as JSON text, nested as extractors give it."""

    def renamed(**columns: str) -> Column:
        return F.struct(*[F.col(old).alias(new) for new, old in columns.items()])

    location = renamed(city="city", country="country", country_code="country_code")
    salary = renamed(
        min_amount="salary_min", max_amount="salary_max",
        currency="salary_currency", period="salary_period",
    )
    fields = F.struct(
        "tech_skills", "soft_skills", "domain_skills", location.alias("location"), "work_mode",
        salary.alias("salary"), "is_relevant", "relevance_confidence", "relevance_reason",
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def _common() -> list[Column]:
    return [
        F.col("id").alias("job_id"), F.col("profile_id"), F.col("search_keyword"),
        F.col("title").alias("job_title"),
        F.coalesce("rule_verdict", F.lit("accept")).alias("rule_verdict"),
    ]


def _prerejected(rejected: DataFrame, now: Column) -> DataFrame:
    return rejected.select(
        *_common(),
        F.lit(None).cast("boolean").alias("llm_is_relevant"),
        F.lit(None).cast("double").alias("llm_confidence"),
        F.lit(None).cast("string").alias("llm_reason"),
        F.lit("reject").alias("ensemble_verdict"),
        F.col("semantic_score").alias("biencoder_score"),
        F.lit(0.0).alias("crossencoder_score"),
        F.lit(1.0).alias("setfit_score"),
        now.alias("judged_at"),
    )


def _judged(done: DataFrame, now: Column) -> DataFrame:
    verdict = ensemble_verdict(
        F.col("rule_verdict"), F.col("semantic_score"), F.col("pair_score"),
        F.col("fewshot_score"), F.col("is_relevant"),
    )
    return done.select(
        *_common(),
        F.col("is_relevant").alias("llm_is_relevant"),
        F.col("relevance_confidence").alias("llm_confidence"),
        F.col("relevance_reason").alias("llm_reason"),
        verdict.alias("ensemble_verdict"),
        F.col("semantic_score").alias("biencoder_score"),
        F.coalesce("pair_score", F.lit(0.0)).alias("crossencoder_score"),
        F.coalesce("fewshot_score", F.lit(1.0)).alias("setfit_score"),
        now.alias("judged_at"),
    )


def enrichment_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
