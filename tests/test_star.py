"""Star schema and marts on the seeded four-posting star."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rolesift.operators import marts as M
from rolesift.operators import star as S
from rolesift.plans import transform as TF
from rolesift.schemas import MARTS, PRIMARY_KEYS, align_table
from rolesift.session import shared_folder
from rolesift.sources.tables import Tables
from tests.conftest import values

AT = dt.datetime(2026, 1, 1)
POSTINGS = [  # id, site, keyword, city, cc, mode, tech, soft, min, max, currency
    ("1", "linkedin", "data engineer", "London", "GB", "remote", ["python", "sql"],
     ["communicative"], 80000.0, 100000.0, "GBP"),
    ("2", "linkedin", "data engineer", "London", "GB", "hybrid", ["python", "airflow"],
     ["collaborative"], 80000.0, 100000.0, "GBP"),
    ("3", "indeed", "ml engineer", "Berlin", "DE", "on-site", ["python", "pytorch"],
     ["analytical"], 70000.0, 90000.0, "EUR"),
    ("4", "indeed", "ml engineer", "Berlin", "DE", "remote", ["pytorch", "kubernetes"],
     ["analytical"], 90000.0, 110000.0, "EUR"),
]


def seed(spark, tables, verdicts=()):
    staging = spark.createDataFrame(
        [(p[0], AT + dt.timedelta(hours=int(p[0])), "run", p[1], p[2], f"u{p[0]}") for p in POSTINGS],
        "id string, scraped_at timestamp_ntz, run_id string, site string, search_keyword string, "
        "job_url string",
    )
    enriched = spark.createDataFrame(
        [(p[0], AT, p[6], p[7], p[3], "x", p[4], p[5], p[8], p[9], p[10], "yearly") for p in POSTINGS],
        "job_id string, enriched_at timestamp_ntz, tech_skills array<string>, "
        "soft_skills array<string>, city string, country string, country_code string, "
        "work_mode string, salary_min double, salary_max double, salary_currency string, "
        "salary_period string",
    )
    judged = spark.createDataFrame(list(verdicts), "job_id string, ensemble_verdict string")
    tables.publish(
        {
            "staging_job_offers": staging,
            "int_enriched_job_info": enriched,
            "judged_job_offers": judged,
        }
    )


@pytest.fixture
def tables(spark):
    return Tables(spark, shared_folder(spark, "test"))


def counts(tables):
    return [tables.read(t).count() for t in S.STAR]


def test_end_to_end_and_idempotent(spark, tables):
    seed(spark, tables)
    summary = {r["table_name"]: (r["candidates"], r["added"])
               for r in TF.run_transform(spark, tables).collect()}
    assert counts(tables) == [2, 3, 8, 4, 12]
    assert summary["fact_job_offers"] == (4, 4)
    again = {r["table_name"]: (r["candidates"], r["added"])
             for r in TF.run_transform(spark, tables).collect()}
    assert counts(tables) == [2, 3, 8, 4, 12]
    assert again["fact_job_offers"] == (4, 0)
    mart = tables.load_mart("mart_jobs_by_country")
    assert values(mart, "country_code", "search_keyword", "job_count") == [
        ("DE", "ml engineer", 2), ("GB", "data engineer", 2)
    ]
    pay = tables.load_mart("mart_salary_by_keyword").filter("search_keyword = 'data engineer'")
    assert values(pay, "p25_min", "p50_min", "p75_min", "p25_max", "p75_max") == [
        (80000.0, 80000.0, 80000.0, 100000.0, 100000.0)
    ]
    skills = tables.load_mart("mart_skills_by_keyword").filter("skill_name = 'python'")
    assert skills.agg(F.sum("demand_count")).first()[0] == 3
    modes = tables.load_mart("mart_work_mode_distribution")
    assert modes.agg(F.sum("job_count")).first()[0] == 4
    assert tables.load_mart("mart_jobs_by_country", "nobody").count() == 0


def test_a_second_pass_leaves_old_files_untouched(spark, tables):
    seed(spark, tables, [(str(k), "review") for k in (3, 4)])
    TF.run_transform(spark, tables)
    old = {t: set(tables.read(t).inputFiles()) for t in S.STAR}
    assert tables.read("fact_job_offers").count() == 2
    seed(spark, tables)
    TF.run_transform(spark, tables)
    assert counts(tables) == [2, 3, 8, 4, 12]
    assert all(old[t] <= set(tables.read(t).inputFiles()) for t in S.STAR)


def test_only_new_postings_are_joined(spark, tables):
    seed(spark, tables, [("1", "review"), ("3", "reject")])
    first = {r["table_name"]: r for r in TF.run_transform(spark, tables, only_new=True).collect()}
    assert first["fact_job_offers"]["candidates"] == first["fact_job_offers"]["added"] == 2
    seed(spark, tables)
    second = {r["table_name"]: r for r in TF.run_transform(spark, tables, only_new=True).collect()}
    assert second["fact_job_offers"]["candidates"] == second["fact_job_offers"]["added"] == 2
    assert counts(tables) == [2, 3, 8, 4, 12]
    rows = {t: values(tables.read(t).drop("scraped_at")) for t in S.STAR}
    third = TF.run_transform(spark, tables, only_new=True)
    assert third.agg(F.sum("candidates"), F.sum("added")).first() == (0, 0)
    TF.run_transform(spark, tables, rebuild=True)
    assert {t: values(tables.read(t).drop("scraped_at")) for t in S.STAR} == rows


def test_verdict_gate(spark, tables):
    seed(spark, tables, [("1", "accept"), ("2", "reject"), ("3", "review")])
    TF.run_transform(spark, tables)
    assert values(tables.read("fact_job_offers"), "job_id") == [("1",), ("4",)]


def test_empty_input_still_refreshes_marts(spark, tables):
    TF.run_transform(spark, tables)
    assert counts(tables) == [0, 0, 0, 0, 0]
    assert all(tables.load_mart(m).count() == 0 for m in MARTS)
    assert all(m in tables._paths for m in MARTS)


def test_facts_stay_until_rebuilt(spark, tables):
    seed(spark, tables)
    TF.run_transform(spark, tables)
    seed(spark, tables, [("1", "reject")])
    TF.run_transform(spark, tables)
    assert tables.read("fact_job_offers").count() == 4
    TF.run_transform(spark, tables, rebuild=True)
    assert tables.read("fact_job_offers").count() == 3


def test_first_seen_spelling_wins(spark):
    rows = spark.createDataFrame(
        [("london ", "gb", AT + dt.timedelta(days=1)), ("London", "GB", AT), (" ", None, AT)],
        "city string, country_code string, scraped_at timestamp_ntz",
    ).withColumn("country", F.lit("UK"))
    assert values(S.build_dim_location(rows), "city", "country_code") == [
        ("London", "GB"), (None, None)
    ]


def test_tables_reject_unknown_names_and_append_by_name(spark, tables):
    with pytest.raises(ValueError):
        tables.read("other")
    with pytest.raises(ValueError):
        tables.load_mart("fact_job_offers")
    frame = spark.createDataFrame([("a", "k1")], "name string, skill_key string")
    assert tables.append("dim_skill", frame) == 1
    assert tables.append("dim_skill", frame.limit(0)) == 0
    assert values(tables.read("dim_skill")) == [("k1", "a", None)]
    assert Tables(spark, tables.root).read("dim_skill").count() == 1


def test_align_fills_missing_columns(spark):
    df = spark.createDataFrame([("p", "t", 1)], "profile_id string, title_norm string, extra int")
    aligned = align_table(df, "profile_title_labels", {"count_seen": 1})
    assert values(aligned, "profile_id", "label", "count_seen") == [("p", None, 1)]
    assert set(PRIMARY_KEYS["profile_title_labels"]) <= set(aligned.columns)


def _percentile(sorted_values, p):
    pos = p * (len(sorted_values) - 1)
    low = int(pos)
    high = min(low + 1, len(sorted_values) - 1)
    return sorted_values[low] + (sorted_values[high] - sorted_values[low]) * (pos - low)


def test_percentiles_against_brute_force(spark):
    rng = random.Random(7)
    rows = [("hot", "min", float(rng.choice([5, 10, 10, 1e6, -3, 0, rng.random() * 100])), 1 + i % 3)
            for i in range(600)]
    rows += [(None, "max", float(i), 1) for i in range(4)] + [("one", "min", 7.5, 1)]
    df = spark.createDataFrame(rows, "g string, side string, x double, n long")
    out = {r["g"]: r for r in M.weighted_percentiles(
        df, ["g"], "side", ("min", "max"), "x", "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    ).collect()}
    hot = sorted(x for g, _, x, n in rows if g == "hot" for _ in range(n))
    for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert out["hot"][f"{name}_min"] == pytest.approx(_percentile(hot, p))
        assert out["one"][f"{name}_min"] == 7.5
    assert out["hot"]["p50_min"] == pytest.approx(statistics.median(hot))
    assert out[None]["p50_max"] == 1.5 and out[None]["p50_min"] is None


def test_iso_codes_and_country_map(spark):
    codes = M.iso_codes(spark)
    assert codes.count() > 240
    totals = spark.createDataFrame(
        [("gb", "UK", 2), ("", None, 1), ("ZZ", "?", 1)],
        "country_code string, country string, job_count long",
    )
    assert values(M.country_iso3(totals, codes), "iso3", "job_count") == [("GBR", 2)]
