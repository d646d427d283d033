"""Landing, staging, judging."""

import datetime as dt

from pyspark.sql import functions as F

from rolesift.operators import landing as L
from rolesift.operators.rules import judge_titles
from rolesift.operators.upsert import new_rows
from rolesift.schemas import FEED_SCHEMA, align
from rolesift.sources.postings import (
    land_sites,
    raw_payload,
    read_postings,
    to_staging,
    with_missing_columns,
    write_postings,
)
from tests.conftest import values

KW = "Store Development Manager"


def feed(spark, rows):
    """Feed rows from (site, url, title); the rest is NULL."""
    small = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], "n int, site string, job_url string, title string"
    )
    return small.select(
        "n",
        *[
            F.col(f.name) if f.name in small.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in FEED_SCHEMA
        ],
    )


def stage(df):
    return to_staging(
        df, run_id=F.lit("run-1"), profile_id=F.lit("p"), keyword=F.lit(KW),
        location=F.lit("London"), scraped_at=F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"),
        arrival=[F.col("n")],
    )


def test_duplicates_in_and_across_batches(spark):
    first = stage(feed(spark, [("a", "u1", "x"), ("a", "u1", "y"), ("a", "u2", "z")]))
    assert values(first, "job_url", "title") == [("u1", "x"), ("u2", "z")]
    second = stage(feed(spark, [("a", "u1", "later")]))
    assert new_rows(second, first, ["id"]).count() == 0


def test_blank_urls_and_missing_sites(spark):
    rows = [("a", None, "t"), ("a", "", "t"), ("a", " \t", "t"), (None, "keep", "t")]
    assert values(stage(feed(spark, rows)), "site", "job_url") == [("linkedin", "keep")]


def test_a_third_of_all_rows_sharing_one_key(spark):
    rows = [("a", "hot", f"t{i}") for i in range(500)] + [("a", f"u{i}", "t") for i in range(1000)]
    staged = stage(feed(spark, rows).repartition(4))
    assert staged.count() == 1001
    assert values(staged.filter("job_url = 'hot'"), "title") == [("t0",)]
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_nan_becomes_null(spark):
    df = feed(spark, [("a", "u", "t")]).withColumn("min_amount", F.lit(float("nan")))
    assert values(stage(df), "min_amount") == [(None,)]


def test_raw_payload_keeps_nulls_and_drops_description(spark):
    df = feed(spark, [("a", "u", "t")]).withColumn("date_posted", F.lit(dt.date(2026, 1, 2)))
    text = df.select(raw_payload()).first()[0]
    assert '"company":null' in text and '"date_posted":"2026-01-02"' in text
    assert "description" not in text


def test_formats_round_trip_with_missing_columns(spark, tmp_path):
    rows = feed(spark, [("a", "u1", 'say "hi", twice\nover'), ("a", "   ", None)]).drop("n")
    for fmt in ("parquet", "json", "csv"):
        write_postings(rows.drop("description"), f"{tmp_path}/{fmt}", fmt)
    frames = [read_postings(spark, f"{tmp_path}/{f}", f) for f in ("parquet", "json", "csv")]
    merged = with_missing_columns(frames)
    assert merged.columns == FEED_SCHEMA.names
    assert values(merged.distinct(), "job_url", "title") == [
        ("   ", None), ("u1", 'say "hi", twice\nover')
    ]


def test_verdict_rows_and_blocklist(spark):
    staged = stage(feed(spark, [("a", "1", KW), ("a", "2", "Lawn Operative")]))
    labels = spark.createDataFrame(
        [("p", KW.lower(), "reject")], "profile_id string, title_norm string, label string"
    )
    fresh, verdicts = L.land_and_judge(
        staged, staged.limit(0), labels, F.current_timestamp().cast("timestamp_ntz")
    )
    assert fresh.count() == 2
    assert values(verdicts, "job_title", "rule_verdict", "rule_reason", "ensemble_verdict") == [
        ("Lawn Operative", "reject", "title_overlap=0.00", "reject"),
        (KW, "reject", "user_blocked", "reject"),
    ]
    other = judge_titles(staged.withColumn("profile_id", F.lit("q")), labels)
    assert ("accept",) in values(other, "rule_verdict")


def test_requests_and_zero_counts(spark):
    profiles = spark.createDataFrame(
        [("p", ["k1", "k2"], ["x", "y"], ["a", "b"]), ("q", ["k"], [], ["a"])],
        "profile_id string, keywords array<string>, locations array<string>, sites array<string>",
    )
    matrix = L.request_matrix(profiles)
    assert matrix.count() == 9
    assert values(matrix.filter("profile_id = 'q'")) == [("q", "k", None, "a")]
    loaded = spark.createDataFrame(
        [("q", "k", None, "a")] * 3,
        "profile_id string, search_keyword string, search_location string, site string",
    )
    counts = L.load_counts(matrix, loaded)
    assert counts.agg(F.sum("rows_loaded")).first()[0] == 3
    assert counts.filter("rows_loaded = 0").count() == 8
    assert values(L.planned_workload(profiles)) == [("p", 4, 8), ("q", 1, 1)]


def test_one_bad_source_does_not_end_the_landing(spark, tmp_path):
    rows = spark.createDataFrame([("linkedin", "u1"), ("linkedin", "u2")], "site string, job_url string")
    write_postings(align(rows, FEED_SCHEMA, lenient=True), f"{tmp_path}/good")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    sources = {"linkedin": (f"{tmp_path}/good", "parquet"), "indeed": (f"{tmp_path}/none", "parquet"), "glassdoor": (f"{tmp_path}/bad", "parquet")}
    landed, status = land_sites(spark, sources, f"{tmp_path}/landed")
    assert values(landed, "job_url") == [("u1",), ("u2",)]
    found = {r["site"]: r["error"] for r in status.collect()}
    assert found["linkedin"] is None and "PATH_NOT_FOUND" in found["indeed"] and found["glassdoor"]
