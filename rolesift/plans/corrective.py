"""One corrective pass over all keywords of a run at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rolesift.operators import corrective as C
from rolesift.session import written


@dataclass(frozen=True)
class CorrectivePass:
    """Rates with alternatives, and the requests that follow from them."""

    report: DataFrame
    requests: DataFrame


def corrective_pass(
    judged: DataFrame,
    staging: DataFrame,
    *,
    run_id: str | None = None,
    profile_id: str | None = None,
    suggestions: DataFrame | None = None,
    propose: Callable[[], C.Proposer] | None = None,
    by: Sequence[str] = ("run_id",),
) -> CorrectivePass:
    """Find keywords with a low acceptance rate and what to search for instead.

    ``suggestions`` (keys, position, term) replaces the built-in proposals; ``propose`` makes
    a model that is asked about every keyword with a low rate (``operators.corrective.run_proposer``), and its
    answers are written, so that it is asked once.
    """
    in_run = C.judged_in_run(judged, staging, run_id)
    rates = C.acceptance_rates(in_run, by, profile_id)
    if profile_id is not None:
        in_run = in_run.filter(in_run["profile_id"] == profile_id)
    if propose is not None:
        rates = written(rates, "corrective-rates")
        suggestions = written(C.run_proposer(C.title_evidence(in_run, rates, by), propose, by), "proposals")
    elif suggestions is None:
        suggestions = C.suggest_keywords(in_run, by)
    if run_id is not None:
        staging = staging.filter(staging["run_id"] == run_id)
    report = C.corrective_report(rates, suggestions, by)
    return CorrectivePass(
        report, C.corrective_requests(report, C.distinct_locations(staging, by), by)
    )
