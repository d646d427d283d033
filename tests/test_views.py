"""The staging view against the plain mapping of the whole feed."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rolesift.catalog import QUERIES
from rolesift.operators.upsert import new_rows
from rolesift.plans import full_run as FULL
from rolesift.sources import views as V
from rolesift.sources.postings import to_staging
from rolesift.sources.tables import Tables

SMALL = "/root/testdata/sf0.001"


def plain_staging(v):
    return to_staging(
        v.feed(), run_id=F.col("run_id"), profile_id=F.col("profile_id"), keyword=F.col("search_keyword"),
        location=F.col("search_location"), scraped_at=F.col("scraped_at"), arrival=[F.col("scraped_at"), F.col("k")],
        keep=["k", "part_name", "salary_interval"],
    )


def test_staging_moves_and_writes_each_text_once(spark):
    v = V.Views(spark, SMALL + "/")
    before = set(V._WRITTEN)
    staged, plain = v.staging(), plain_staging(v)
    assert not any(name == "feed" for *_, name in set(V._WRITTEN) - before)
    path, schema = V._WRITTEN[spark.sparkContext.applicationId, SMALL, "staging"]
    assert "raw_payload" not in schema.names
    assert staged.columns == plain.columns
    assert staged.exceptAll(plain).isEmpty() and plain.exceptAll(staged).isEmpty()


def test_repeated_rows_of_a_posting_are_staged_once(spark, tmp_path):
    for name in V.GIVEN:
        if name not in ("orders", "documents"):
            os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    for name in ("orders", "documents"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.unionAll(rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    v = V.Views(spark, str(tmp_path))
    staged = v.staging()
    ids = staged.select("id", "raw_payload", "k")
    assert staged.count() == staged.select("id").distinct().count() == plain_staging(v).count()
    assert ids.exceptAll(plain_staging(v).select("id", "raw_payload", "k")).isEmpty()


def test_a_query_without_texts_writes_none(spark, tmp_path):
    for name in V.GIVEN:
        os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    v = V.Views(spark, str(tmp_path))
    plain = v.staging(texts=False)
    assert "description" not in plain.columns
    assert {name for app, folder, name in V._WRITTEN if folder == str(tmp_path)} == {"staging-plain"}
    whole = v.staging()
    assert whole.select("description").dropna().count() > 0
    rest = whole.drop("description")
    assert sorted(plain.columns) == sorted(rest.columns)
    assert plain.exceptAll(rest.select(plain.columns)).isEmpty() and rest.select(plain.columns).exceptAll(plain).isEmpty()


def test_the_gate_is_joined_once_for_several_star_tables(spark, tmp_path):
    for name in V.GIVEN:
        os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    v = V.Views(spark, str(tmp_path))
    written = lambda: {name for app, folder, name in V._WRITTEN if folder == str(tmp_path)}
    v.star("fact_job_offers", "dim_location")
    assert written() == {"staging-plain", "gated-plain", "fact_job_offers", "dim_location"}
    plain = v.gated(skills=False)
    assert not set(V.SKILL_LISTS) & set(plain.columns)
    whole = V.load_enriched(v.staging(), v.enriched(), v.judged())
    kept = v.kept_gated()
    assert sorted(kept.columns) == sorted(whole.columns) and kept.filter("size(tech_skills) > 0").count() > 0
    assert kept.exceptAll(whole.select(kept.columns)).isEmpty() and whole.select(kept.columns).exceptAll(kept).isEmpty()
    assert plain.exceptAll(whole.select(plain.columns)).isEmpty()


def test_parts_meet_the_facts_of_an_order(spark):
    assert V.POSTINGS.endswith(V.PART_JOIN)
    v = V.Views(spark, SMALL)
    given = {name: v.given(name) for name in ("orders", "customer", "part")}
    places = v._sql(V.PLACES, nation=v.given("nation"), region=v.given("region"))
    facts = v._sql(V.ORDER_FACTS, lineitem=v.given("lineitem"))
    plain, mine = v._sql(V.POSTINGS, places=places, order_facts=facts, **given), v.postings()
    assert mine.columns == plain.columns
    assert mine.exceptAll(plain).isEmpty() and plain.exceptAll(mine).isEmpty()


def test_the_second_transform_writes_the_rows_of_the_first_no_more(spark, monkeypatch):
    written, append, publish = {}, Tables.append, Tables.publish

    def appended(self, table, df):
        rows = append(self, table, df)
        written[table] = written.get(table, 0) + rows
        return rows

    def published(self, frames):
        publish(self, frames)
        for table in frames:
            written[table] = written.get(table, 0) + self.read(table).count()

    monkeypatch.setattr(Tables, "append", appended)
    monkeypatch.setattr(Tables, "publish", published)
    facts, v = QUERIES["run_transform"](spark, SMALL), V.Views(spark, SMALL)
    assert written["staging_job_offers"] == v.staging().count()
    assert written["judged_job_offers"] == v.judged().count()
    assert written["int_enriched_job_info"] == v.enriched().count()
    assert facts.count() == v.gated().count()


def test_the_newest_facts_gather_their_own_skills_only(spark, tmp_path):
    for name in V.GIVEN:
        os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    v = V.Views(spark, str(tmp_path))
    few = v.star("fact_job_offers")[0].orderBy("job_id").limit(20).select("job_id")
    mine = v.enriched_of(few)
    assert not any(folder == str(tmp_path) and name == "enriched" for _, folder, name in V._WRITTEN)
    wide = QUERIES["fact_with_dims"](spark, str(tmp_path)).collect()
    assert not any(folder == str(tmp_path) and name == "enriched" for _, folder, name in V._WRITTEN)
    whole = v.enriched().join(few, "job_id", "left_semi")
    assert whole.count() == 20 and whole.filter("size(tech_skills) > 0").count() > 0
    assert mine.exceptAll(whole).isEmpty() and whole.exceptAll(mine).isEmpty()
    assert QUERIES["fact_with_dims"](spark, str(tmp_path)).collect() == wide


def test_a_first_landing_exchanges_neither_rows_nor_ids(spark, tmp_path, monkeypatch):
    tables, staged = Tables(spark, str(tmp_path / "lake")), V.Views(spark, SMALL).staging(texts=False)
    for name in ("staging_job_offers", "judged_job_offers"):
        rows = tables.read(name)
        plan = new_rows(rows.sparkSession.range(3).selectExpr("cast(id as string) as run_id"), rows.selectExpr("job_id as run_id" if name[0] == "j" else "run_id"), ["run_id"])
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    ids = []
    monkeypatch.setattr(FULL, "written", lambda df, purpose, plain=FULL.written: ids.append(purpose) or plain(df, purpose))
    early, n = staged.filter("run_id <= 'run-1997'"), staged.count()
    assert FULL.land(tables, early) == early.count() and ids == []
    assert FULL.land(tables, staged) == n - early.count() and ids == ["landing-ids"]
    for name, key in (("staging_job_offers", "id"), ("judged_job_offers", "job_id")):
        assert tables.read(name).count() == tables.read(name).select(key).distinct().count() == n


def test_the_cascade_gathers_no_skills_for_ids(spark, tmp_path):
    for name in V.GIVEN:
        os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    v = V.Views(spark, str(tmp_path))
    kept = lambda: {name for _, folder, name in V._WRITTEN if folder == str(tmp_path)}
    found = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("enrichment_summary", "pending_rows", "anti_unenriched")}
    assert "enriched" not in kept()
    ids = v.enriched_ids()
    assert "l_partkey" not in ids._jdf.queryExecution().optimizedPlan().toString()
    whole = v.enriched().select("job_id")
    assert ids.exceptAll(whole).isEmpty() and whole.exceptAll(ids).isEmpty()
    for name, rows in found.items():
        assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(str, rows))


def test_refused_postings_gather_no_skills_for_the_gate(spark, tmp_path, monkeypatch):
    for name in V.GIVEN:
        os.symlink(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    v, made = V.Views(spark, str(tmp_path)), []
    monkeypatch.setattr(V, "load_enriched", lambda s, e, j, plain=V.load_enriched: made.append(e) or plain(s, e, j))
    mine = v.gated()
    assert mine.filter("size(tech_skills) > 0").count() > 0
    listed = made[0].filter("tech_skills is not null").select("job_id")
    assert listed.join(mine, "job_id", "left_anti").isEmpty()
    whole = V.load_enriched(v.staging(texts=False), v.enriched(), v.judged())
    assert mine.exceptAll(whole).isEmpty() and whole.exceptAll(mine).isEmpty()
