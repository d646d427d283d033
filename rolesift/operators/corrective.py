"""Acceptance rates, sample titles, keyword suggestions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.constants import (
    CORRECTIVE_MAX_ALTERNATIVES,
    CORRECTIVE_RATE,
    CORRECTIVE_SAMPLE_TITLES,
    STOPWORDS,
)
from rolesift.functions.text import tokenize, words
from rolesift.operators.dedup import top_per_key
from rolesift.operators.extraction import phrases
from rolesift.operators.joins import null_safe_join


def judged_in_run(judged: DataFrame, staging: DataFrame, run_id: str | None = None) -> DataFrame:
    """Judged rows with the run that landed them (of one run, if given)."""
    landed = staging.select(F.col("id").alias("job_id"), "run_id")
    if run_id is not None:
        landed = landed.filter(F.col("run_id") == run_id)
    return judged.join(landed, "job_id")


def acceptance_rates(
    in_run: DataFrame, by: Sequence[str] = ("run_id",), profile_id: str | None = None
) -> DataFrame:
    """Accepted share per keyword; NULL profile means all profiles together."""
    if profile_id is not None:
        in_run = in_run.filter(F.col("profile_id") == profile_id)
    accepted = F.count_if(F.col("ensemble_verdict") == "accept")
    total = F.count(F.lit(1))
    return (
        in_run.filter("search_keyword is not null")
        .groupBy(*by, "search_keyword")
        .agg(
            total.alias("total"), accepted.alias("accepted"),
            (accepted / total).alias("acceptance_rate"),
        )
    )


def sample_titles(
    in_run: DataFrame, by: Sequence[str] = ("run_id",), n: int = CORRECTIVE_SAMPLE_TITLES
) -> DataFrame:
    """The ``n`` most recently judged titles per keyword and verdict, newest first."""
    order = [F.col("judged_at").desc(), F.col("job_id")]
    keys = [*by, "search_keyword", "ensemble_verdict"]
    ranked = top_per_key(in_run.filter("job_title is not null"), keys, order, n, rank="position")
    return ranked.select(*keys, "position", "job_title")


def _terms(titles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct words and neighbouring word pairs of every title."""
    plain = F.filter(words(F.col("job_title")), lambda w: ~w.isin(*STOPWORDS))
    spelled = titles.select(*by, "search_keyword", "ensemble_verdict", plain.alias("_w"))
    return spelled.select(
        *by, "search_keyword", "ensemble_verdict",
        F.explode(phrases(F.col("_w"), 2)).alias("term"),
    )


def suggest_keywords(
    in_run: DataFrame,
    by: Sequence[str] = ("run_id",),
    max_alternatives: int = CORRECTIVE_MAX_ALTERNATIVES,
) -> DataFrame:
    """Words and word pairs that set accepted titles of a keyword apart from rejected ones.

    Smoothed log-odds over all titles of the keyword; terms made of the
    keyword's own words only are no alternatives. Counts are aggregated before
    they are compared, so a frequent term or keyword travels as one row per task.
    """
    keys = [*by, "search_keyword"]
    seen = in_run.filter(
        F.col("job_title").isNotNull() & F.col("ensemble_verdict").isin("accept", "reject")
    )
    accept = F.col("ensemble_verdict") == "accept"
    counts = _terms(seen, by).groupBy(*keys, "term").agg(
        F.count_if(accept).alias("accepted"), F.count_if(~accept).alias("rejected")
    )
    totals = seen.groupBy(*keys).agg(
        F.count_if(accept).alias("_a"), F.count_if(~accept).alias("_r")
    )
    odds = F.log(
        (F.col("accepted") + 0.5) / (F.col("_a") - F.col("accepted") + 0.5)
    ) - F.log((F.col("rejected") + 0.5) / (F.col("_r") - F.col("rejected") + 0.5))
    own = tokenize(F.col("search_keyword"))
    is_new = F.size(F.array_except(F.split("term", " "), own)) > 0
    scored = null_safe_join(counts, totals, keys).select(
        *keys, "term", "accepted", "rejected",
        F.round(odds, 6).alias("score"),
    )
    good = scored.filter(is_new & (F.col("score") > 0))
    order = [F.col("score").desc(), F.col("accepted").desc(), F.col("term")]
    return top_per_key(good, keys, order, max_alternatives, rank="position")


def title_evidence(
    in_run: DataFrame, rates: DataFrame, by: Sequence[str] = ("run_id",), n: int = CORRECTIVE_SAMPLE_TITLES
) -> DataFrame:
    """Each keyword below the rate with its newest accepted and rejected titles, ``n`` of each at most.

    A keyword without a titled verdict keeps its row, with empty lists.
    """
    keys = [*by, "search_keyword"]
    low = rates.filter(F.col("acceptance_rate") < CORRECTIVE_RATE).select(*keys)
    titles = sample_titles(in_run.join(low, keys, "left_semi"), by, n)

    def newest(verdict: str):
        placed = F.when(F.col("ensemble_verdict") == verdict, F.struct("position", "job_title"))
        return F.transform(F.array_sort(F.collect_list(placed)), lambda s: s["job_title"])

    lists = titles.groupBy(*keys).agg(newest("accept").alias("accepted_titles"), newest("reject").alias("rejected_titles"))
    none = F.array().cast("array<string>")
    return low.join(lists, keys, "left").select(
        *keys, *[F.coalesce(c, none).alias(c) for c in ("accepted_titles", "rejected_titles")]
    )


Proposer = Callable[[str, list[str], list[str]], "list[str] | None"]


def run_proposer(
    evidence: DataFrame,
    make: Callable[[], Proposer],
    by: Sequence[str] = ("run_id",),
    max_alternatives: int = CORRECTIVE_MAX_ALTERNATIVES,
) -> DataFrame:
    """(keys, position, term): the alternatives of a plugged-in model, one call a keyword below the rate.

    ``make`` loads the model once per Python worker task; it is given the keyword and its sampled titles.
    Blank and repeated proposals and the keyword itself are dropped, the first ``max_alternatives``
    of the rest count. A model that proposes nothing (None or an empty list) leaves the keyword without alternatives.
    """
    keys = [*by, "search_keyword"]
    schema = T.StructType([*evidence.select(*keys).schema, T.StructField("_terms", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        propose = make()
        for batch in batches:
            rows = zip(batch["search_keyword"], batch["accepted_titles"], batch["rejected_titles"], strict=True)
            terms = [[str(t) for t in propose(k, list(a), list(r)) or [] if t] for k, a, r in rows]
            yield batch[keys].assign(_terms=pd.Series(terms, index=batch.index, dtype="object"))

    plain = F.array_distinct(F.transform("_terms", lambda t: F.trim(t)))
    usable = F.filter(plain, lambda t: (t != "") & (F.lower(t) != F.lower("search_keyword")))
    listed = evidence.mapInPandas(run, schema).select(*keys, F.posexplode(F.slice(usable, 1, max_alternatives)).alias("_at", "term"))
    return listed.select(*keys, (F.col("_at") + 1).alias("position"), "term")


def corrective_report(rates: DataFrame, suggestions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every keyword with its rate, whether it falls short, and its alternatives if so."""
    keys = [*by, "search_keyword"]
    listed = suggestions.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "term"))), lambda s: s["term"]
        ).alias("_terms")
    )
    joined = rates.join(listed, keys, "left")
    triggered = F.col("acceptance_rate") < CORRECTIVE_RATE
    none = F.array().cast("array<string>")
    return joined.select(
        *keys, "total", "accepted", "acceptance_rate", triggered.alias("triggered"),
        F.when(triggered, F.coalesce("_terms", none)).otherwise(none).alias("alternatives"),
    )


def corrective_requests(report: DataFrame, locations: DataFrame, by: Sequence[str]) -> DataFrame:
    """New (keyword, location) requests of the triggered keywords in their run's locations."""
    alternatives = report.filter("triggered").select(
        *by, "search_keyword", F.explode("alternatives").alias("alternative")
    )
    joined = alternatives.join(locations, list(by), "left")
    return joined.select(*by, "search_keyword", "alternative", "search_location")


def distinct_locations(staging: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    return staging.select(*by, "search_location").distinct()


def count_accepted(in_run: DataFrame, keywords: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accepted rows per run whose keyword is one of the given (run, keyword) rows."""
    wanted = keywords.select(*by, "search_keyword").distinct()
    return (
        in_run.filter(F.col("ensemble_verdict") == "accept")
        .groupBy(*by, "search_keyword")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(wanted, [*by, "search_keyword"], "left_semi")
        .groupBy(*by)
        .agg(F.sum("_n").alias("accepted"))
    )


def corrective_outcome(report: DataFrame, in_run: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per triggered keyword: postings its alternatives have landed, and how many were accepted."""
    loads = in_run.groupBy(*by, F.col("search_keyword").alias("alternative")).agg(
        F.count(F.lit(1)).alias("_landed"),
        F.count_if(F.col("ensemble_verdict") == "accept").alias("_accepted"),
    )
    alternatives = report.filter("triggered").select(
        *by, "search_keyword", F.explode_outer("alternatives").alias("alternative")
    )
    return (
        alternatives.join(loads, [*by, "alternative"], "left")
        .groupBy(*by, "search_keyword")
        .agg(
            F.coalesce(F.sum("_landed"), F.lit(0)).alias("new_rows_landed"),
            F.coalesce(F.sum("_accepted"), F.lit(0)).alias("new_rows_accepted"),
        )
    )
