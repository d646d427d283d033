"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolesift.catalog import QUERIES  # noqa: E402
from rolesift.session import local_session  # noqa: E402
from rolesift.sources.views import Views  # noqa: E402

HEADLINE = (
    "stage_postings", "dedup_first", "rule_verdicts", "land_and_judge", "upsert_update_verdicts",
    "verdict_gated", "dim_location", "dim_salary", "job_skill_bridge", "fact_job_offers",
    "mart_jobs_by_country", "mart_skills_by_keyword", "mart_salary_by_keyword",
    "mart_work_mode_distribution", "fact_with_dims", "top_skills_per_keyword",
    "normalize_records", "semantic_score", "pair_score_bm25", "extract_skills", "extract_salary",
    "relevance_cascade", "triage_candidates_all", "apply_labels", "acceptance_rates",
    "suggest_keywords", "corrective_report", "run_transform", "stream_daily_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, "rolesift-bench")
    times: dict[str, float] = {}

    start = time.time()
    views = Views(spark, folder)
    for view in (views.feed, views.staging, views.enriched, views.judged, views.labels, views.records):
        view()
    views.star("dim_location", "dim_salary", "dim_skill", "fact_job_offers", "job_skill_bridge")
    times["derive_views"] = round(time.time() - start, 3)

    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    found = re.search(r"sf([0-9.]+)/?$", folder)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
