"""Key-based writes, labels, triage."""

import datetime as dt

from pyspark.sql import functions as F

from rolesift.operators import quality as Q
from rolesift.operators import triage as TRI
from rolesift.operators import upsert as U
from rolesift.operators.joins import null_safe_join
from rolesift.plans import write_back as WB
from rolesift.sources.tables import Tables
from tests.conftest import values

def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")

OLD = dt.datetime(2020, 1, 1)


def test_upsert_ignore_keeps_target_and_first_incoming(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    incoming = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    merged = U.upsert_ignore(target, incoming, ["k"], [F.col("v")])
    assert values(merged) == [("a", 1), ("b", 2)]


def test_upsert_update_changes_listed_columns_only(spark):
    target = spark.createDataFrame([("a", "t", "x"), ("b", "t", "x")], "k string, title string, v string")
    incoming = spark.createDataFrame([("a", "new", None), ("c", "new", "y")], "k string, title string, v string")
    merged = U.upsert_update(target, incoming, ["k"], ["v"])
    assert values(merged) == [("a", "t", None), ("b", "t", "x"), ("c", "new", "y")]


def labels(spark):
    return spark.createDataFrame(
        [("p", "lead", "unsure", None, 2, OLD, OLD)],
        "profile_id string, title_norm string, label string, note string, count_seen int, "
        "created_at timestamp_ntz, updated_at timestamp_ntz",
    )


def test_label_upsert_counts_sightings_and_refuses_unknown(spark):
    incoming = spark.createDataFrame(
        [("p", "lead", "accept", "n", 50), ("p", "new", "reject", None, 3), ("p", "x", "maybe", None, 1)],
        "profile_id string, title_norm string, label string, note string, count_seen int",
    )
    merged = U.upsert_labels(labels(spark), incoming, now())
    assert values(merged, "title_norm", "label", "count_seen") == [
        ("lead", "accept", 3), ("new", "reject", 3)
    ]
    assert values(merged.filter("title_norm = 'lead'"), "created_at") == [(OLD,)]
    assert values(U.invalid_labels(incoming), "title_norm") == [("x",)]


def judged(spark):
    return spark.createDataFrame(
        [("1", "p", "Lead ", "review", "review", OLD), ("2", "p", "LEAD", "review", "reject", OLD),
         ("3", "p", "Cook", "reject", "reject", OLD), ("4", "q", "Lead", "review", "review", OLD),
         ("5", "p", None, "review", "review", OLD)],
        "job_id string, profile_id string, job_title string, rule_verdict string, "
        "ensemble_verdict string, judged_at timestamp_ntz",
    )


def test_apply_labels_changes_only_what_differs(spark):
    known = labels(spark).withColumn("label", F.lit("reject"))
    out = TRI.apply_labels(judged(spark), known, now())
    assert values(out, "job_id", "ensemble_verdict", "changed") == [
        ("1", "reject", True), ("2", "reject", False), ("3", "reject", False),
        ("4", "review", False), ("5", "review", False),
    ]
    assert values(out.filter("changed"), "judged_at") == [(dt.datetime(2030, 1, 1),)]
    counts = TRI.label_match_count(judged(spark), labels(spark))
    assert values(counts) == [("p", 2, 0)]


def test_triage_list_shrinks_and_grows(spark):
    staging = spark.createDataFrame([(str(i), f"c{i}") for i in range(1, 6)], "id string, company string")
    rows = judged(spark)
    shown = TRI.triage_candidates(rows, staging, labels(spark), "p")
    assert values(shown.filter("title_norm = 'lead'"), "display_title", "user_label") == [
        ("LEAD", "unsure"), ("Lead ", "unsure")
    ]
    decided = labels(spark).withColumn("label", F.lit("accept"))
    assert TRI.triage_candidates(rows, staging, decided, "p").filter("title_norm = 'lead'").count() == 0
    assert TRI.triage_candidates(rows, staging, decided, "p", True).filter("title_norm = 'lead'").count() == 2
    assert values(TRI.triage_metrics(rows)) == [("p", 2, 0, 2), ("q", 1, 0, 0)]
    assert values(TRI.triage_pending(rows, labels(spark))) == [("q", 1)]


def test_editor_round(spark):
    shown = spark.createDataFrame(
        [("Lead", "c", 2, "review", "review", None), ("Cook", "c", 1, "reject", "reject", "reject")],
        "display_title string, company_sample string, count long, rule_verdict string, "
        "ensemble_verdict string, user_label string",
    )
    editor = TRI.editor_view(shown)
    accepted = TRI.bulk_label(editor, "accept")
    assert values(accepted, "display_title", "label") == [("Cook", "reject"), ("Lead", "accept")]
    assert values(TRI.changed_labels(accepted, shown), "title_norm", "label") == [("lead", "accept")]
    assert values(TRI.bulk_label(accepted, "clear"), "label") == [("",), ("",)]
    assert TRI.changed_labels(TRI.bulk_label(accepted, "clear"), shown).count() == 0


def test_label_summary_fills_zeros(spark):
    rows = spark.createDataFrame([("p", "accept"), ("p", "odd")], "profile_id string, label string")
    assert values(TRI.label_summary(rows)) == [("p", 1, 0, 0, 1)]


def test_delete_and_replace(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    one = spark.createDataFrame([("a", 7)], "k string, v int")
    assert values(U.delete_by_key(target, one, ["k"])) == [("b", 2)]
    assert values(U.replace_by_key(target, one, ["k"])) == [("a", 7), ("b", 2)]


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10)], "k string, y int")
    assert values(null_safe_join(left, right, ["k"], "left"), "k", "y") == [("a", None), (None, 10)]


def test_checks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "k string, v string")
    assert values(Q.duplicate_keys(df, ["k"], "t")) == [("t", 1, 1)]
    parent = spark.createDataFrame([("x",)], "v string")
    assert values(Q.orphans(df, parent, "v", "v", "r")) == [("r", 1, 1)]
    rules = {"k_missing": F.col("k").isNotNull(), "v_bad": F.col("v").isin("x")}
    assert values(Q.domain_violations(df, rules)) == [(1, 1)]


def test_write_back_of_labels_and_profiles(spark, tmp_path):
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    tables = Tables(spark, f"{tmp_path}/tables")
    judged = spark.createDataFrame(
        [("1", "p", "Cook", "accept"), ("2", "p", "Data Lead", "accept"), ("3", "q", "Cook", "accept")],
        "job_id string, profile_id string, job_title string, ensemble_verdict string",
    )
    tables.publish({"judged_job_offers": judged})
    labels = spark.createDataFrame(
        [("p", "cook", "reject", None, 1), ("p", "data lead", "nonsense", None, 1)],
        "profile_id string, title_norm string, label string, note string, count_seen int",
    )
    WB.save_labels(tables, labels, now)
    assert WB.apply_labels_to_judged(tables, now) == 1 and WB.apply_labels_to_judged(tables, now) == 0
    assert values(tables.read("judged_job_offers"), "job_id", "ensemble_verdict") == [
        ("1", "reject"), ("2", "accept"), ("3", "accept")
    ]
    schema = "profile_id string, name string, description string, keywords array<string>, locations array<string>, sites array<string>"
    rows = [("a", " A ", None, ["x", " "], None, ["indeed"]), (None, "B b", None, ["y"], None, None), ("c", "", None, ["z"], None, None)]
    WB.save_profiles(tables, spark.createDataFrame(rows, schema), now)
    assert values(tables.read("user_search_profiles"), "profile_id", "name") == [("a", "A"), ("b-b", "B b")]
    WB.save_profiles(tables, spark.createDataFrame([("a", "New", None, ["x"], None, None)], schema), now)
    assert values(tables.read("user_search_profiles"), "profile_id", "name") == [("a", "New"), ("b-b", "B b")]
    WB.delete_profiles(tables, spark.createDataFrame([("a",)], "profile_id string"))
    assert values(tables.read("user_search_profiles"), "profile_id") == [("b-b",)]
