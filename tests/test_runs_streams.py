"""Run registry, profiles, whole runs, streams, and queries against SQL."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from checks.oracle import ORACLE
from rolesift.catalog import QUERIES
from rolesift.operators import profiles as P
from rolesift.operators import runs as RUN
from rolesift.operators.landing import fresh_rows
from rolesift.plans import full_run as FULL
from rolesift.session import shared_folder
from rolesift.sources.tables import Tables
from rolesift.streaming import jobs as ST
from tests.conftest import values
from tests.test_landing import KW, feed, stage

AT = dt.datetime(2026, 1, 1)
SMALL = "/root/testdata/sf0.001"


def runs(spark):
    return spark.createDataFrame(
        [("run-00000001", "p", AT, AT + dt.timedelta(seconds=6.5), "success", '["a","b"]', 3),
         ("run-00000002", None, AT + dt.timedelta(days=2), None, "running", None, None)],
        "run_id string, profile_id string, started_at timestamp_ntz, finished_at timestamp_ntz, "
        "status string, keywords string, scraped_count long",
    ).withColumns({"enriched_count": F.lit(1), "error_message": F.lit(None).cast("string")})


def test_history(spark):
    names = spark.createDataFrame([("p", "Profile")], "profile_id string, name string")
    view = RUN.history_view(runs(spark), names)
    assert values(view, "run_id", "profile", "duration", "keywords") == [
        ("run-0000", "-", "-", ""), ("run-0000", "Profile", "6.5s", "a, b")
    ]
    kept = RUN.history_filter(runs(spark), start="2026-01-01", end="2026-01-02")
    assert values(kept, "run_id") == [("run-00000001",)]
    assert RUN.history_filter(runs(spark), ["failed"]).count() == 0
    assert values(RUN.run_summary(runs(spark))) == [(2, 50.0, 6.5, 3)]
    assert values(RUN.run_summary(runs(spark).limit(0)), "total_runs", "success_pct") == [(0, 0.0)]
    assert values(RUN.latest_run(runs(spark)), "run_id") == [("run-00000002",)]
    assert values(RUN.latest_run(runs(spark), "p"), "run_id") == [("run-00000001",)]


def test_profiles(spark):
    raw = spark.createDataFrame(
        [(None, " My Profile ", " ", [" a ", " "], None, ["indeed", "other"]), ("x", " ", None, ["a"], [], None)],
        "profile_id string, name string, description string, keywords array<string>, "
        "locations array<string>, sites array<string>",
    )
    assert values(P.clean_profiles(raw)) == [
        ("my-profile", "My Profile", None, ["a"], [], ["indeed"], True),
        ("x", "", None, ["a"], [], ["linkedin", "indeed"], False),
    ]
    names = spark.createDataFrame([(i, "Same") for i in range(300)] + [(999, "!")], "id int, name string")
    slugs = [r[0] for r in P.unique_slugs(names, "name", "id").select("slug").collect()]
    assert len(set(slugs)) == 301 and "same" in slugs and None in slugs
    legacy = spark.createDataFrame([("keywords", '["k"]'), ("sites", "oops")], "key string, value string")
    assert values(P.migrate_legacy(legacy)) == [
        ("default", "Default", ["k"], ["London, UK"], ["linkedin", "indeed"])
    ]


def test_whole_run_and_failed_run(spark):
    tables = Tables(spark, shared_folder(spark, "test-run"))
    staged = stage(feed(spark, [("a", "1", KW), ("a", "2", "Lawn Operative")]))

    def extract(rows):
        from rolesift.operators.records import normalize_records

        raw = rows.select(F.col("id").alias("job_id"), F.lit("{}").alias("raw_response"))
        return normalize_records(raw).withColumnRenamed("job_id", "id").drop("raw_response")

    added = {r["table_name"]: r["added"] for r in
             FULL.full_run(spark, tables, "r1", staged, extract, profile_id="p").collect()}
    assert added["fact_job_offers"] == 1
    columns = ("run_id", "status", "scraped_count", "enriched_count")
    assert values(tables.read("pipeline_runs"), *columns) == [("r1", "success", 2, 1)]
    stored = tables.read("int_enriched_job_info").first()["raw_response"]
    assert '"salary":{"min_amount":null' in stored and '"is_relevant":true' in stored
    FULL.full_run(spark, tables, "r2", staged, extract, profile_id="p", learn=True)
    assert tables.read("staging_job_offers").count() == 2

    def broken(rows):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        more = stage(feed(spark, [("a", "3", KW)]))
        FULL.full_run(spark, tables, "r3", more, broken, profile_id="p")
    failed = tables.read("pipeline_runs").filter("status = 'failed'")
    assert values(failed, "run_id", "scraped_count", "error_message") == [
        ("r3", 1, "RuntimeError: no model")
    ]


def _files(spark, folder, batches):
    schema = "id string, k long, at timestamp_ntz"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


def test_stream_landing_equals_batch_over_several_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    hour = lambda h: AT + dt.timedelta(hours=h)
    batches = [[("a", 2, hour(1)), ("a", 1, hour(0)), ("b", 3, hour(2))],
               [("b", 4, hour(-900)), ("c", 5, hour(3))]]
    schema = _files(spark, folder, batches)
    target, progress = f"{tmp_path}/out", f"{tmp_path}/progress"
    stream = lambda: ST.table_stream(spark, folder, schema, 1)
    landed = ST.land_stream(stream(), target, progress, "id", [F.col("at"), F.col("k")])
    assert [r[0] for r in values(landed, "id")] == ["a", "b", "c"]
    _files(spark, folder, [[("c", 6, hour(4)), ("d", 7, hour(5))]])
    again = ST.land_stream(stream(), target, progress, "id", [F.col("at"), F.col("k")])
    assert [r[0] for r in values(again, "id")] == ["a", "b", "c", "d"]


def test_stream_upsert_and_counts(spark, tmp_path):
    folder = f"{tmp_path}/in"
    schema = _files(spark, folder, [[("a", 1, AT)], [("a", 2, AT + dt.timedelta(hours=1)), ("b", 3, AT)]])
    stream = lambda: ST.table_stream(spark, folder, schema, 1)
    newest = ST.upsert_stream(stream(), f"{tmp_path}/u", f"{tmp_path}/up", ["id"], [F.col("at").desc()])
    assert values(newest, "id", "k") == [("a", 2), ("b", 3)]
    counts = ST.windowed_counts(stream(), f"{tmp_path}/w", f"{tmp_path}/wp", "at", ["id"])
    assert values(counts) == [(AT, "a", 2), (AT, "b", 1)]


@pytest.mark.parametrize("files", [0, 1, 5])
def test_streams_read_files_and_folders_alike(spark, tmp_path, files):
    """The three stream queries on a table of one file, one part file and many part files."""
    expected = {}
    for name in ("events", "orders"):
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if files:
            table.repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            shutil.copy(f"{SMALL}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    for name in ("stream_daily_counts", "stream_land_dedup", "stream_upsert_verdicts"):
        expected[name] = values(QUERIES[name](spark, SMALL))
        assert expected[name] and values(QUERIES[name](spark, str(tmp_path))) == expected[name], name


def test_a_stream_without_files_raises(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no Parquet file"):
        ST.table_stream(spark, f"{tmp_path}/empty", schema)


def test_late_rows_count_unless_a_delay_is_asked_for(spark, tmp_path):
    folder = f"{tmp_path}/in"
    batches = [[("a", 1, AT)], [("a", 2, AT + dt.timedelta(days=30))], [("a", 3, AT)]]
    schema = _files(spark, folder, batches)
    every = ST.windowed_counts(ST.table_stream(spark, folder, schema, 1), f"{tmp_path}/w", f"{tmp_path}/wp", "at", ["id"])
    assert sum(r["n"] for r in every.collect()) == 3


def test_fresh_rows(spark):
    df = spark.createDataFrame([(AT,), (AT - dt.timedelta(hours=72),), (AT - dt.timedelta(hours=73),)], "at timestamp_ntz")
    assert fresh_rows(df, "at").count() == 2


def test_every_sql_names_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize(
    "name",
    ["stage_postings", "rule_verdicts", "mart_jobs_by_country", "mart_salary_by_keyword",
     "fact_with_dims_by_keyword", "apply_labels", "normalize_records", "relevance_cascade",
     "corrective_requests", "stream_daily_counts", "check_fk"],
)
def test_against_sql(spark, name):
    ok, text = compare(spark, connect(SMALL), SMALL, name)
    assert ok, text


def test_plans_push_filters_and_keep_texts_in_place(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    scan = plan(QUERIES["mart_scan_profile"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(profile_id), EqualTo(profile_id,building)]" in scan
    assert "Exchange hashpartitioning" not in plan(QUERIES["pair_score_bm25"](spark, SMALL))
    for name in ("dedup_first", "sample_titles", "latest_run_per_profile", "semantic_topk"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "WindowGroupLimit" in text and "Partial" in text, name
    narrow = plan(QUERIES["mart_work_mode_distribution"](spark, SMALL))
    assert "ReadSchema: struct<profile_id:string,search_keyword:string,work_mode:string>" in narrow
