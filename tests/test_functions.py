"""Scalar functions, case by case."""

import pytest
from pyspark.sql import functions as F

from rolesift.functions import keys as K
from rolesift.functions import normalize as N
from rolesift.functions import text as X
from rolesift.functions import timing as T


def apply(spark, fn, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("location", "expected"),
    [
        ("London, UK", "uk"), ("London, United Kingdom", "uk"), ("Berlin, Germany", "germany"),
        ("Spain", "spain"), ("Hong Kong", "hongkong"), ("San Francisco, USA", "usa"),
        ("", None), (None, None), ("Atlantis", None), ("Some City, Nowhere", None),
    ],
)
def test_country_from_location(spark, location, expected):
    assert apply(spark, X.country_from_location, location) == expected


@pytest.mark.parametrize(
    ("title", "verdict", "reason"),
    [
        ("Store Development Manager", "accept", "title_overlap=1.00"),
        ("Restaurant Assistant Manager", "review", "title_overlap=0.20"),
        ("Lawn Operative", "reject", "title_overlap=0.00"),
        (None, "review", "title_overlap=0.00"),
        ("", "review", "title_overlap=0.00"),
        ("   ", "reject", "title_overlap=0.00"),
    ],
)
def test_title_rule(spark, title, verdict, reason):
    df = spark.createDataFrame([(title, "Store Development Manager")], "t string, k string")
    score = X.title_score(F.col("t"), F.col("k"))
    row = df.select(
        X.rule_verdict(score, F.lit(False)).alias("v"), X.rule_reason(score, F.lit(False)).alias("r")
    ).first()
    assert (row["v"], row["r"]) == (verdict, reason)


def test_keyword_of_stopwords_only_needs_review(spark):
    df = spark.createDataFrame([("Clerk", "the of")], "t string, k string")
    score = X.title_score(F.col("t"), F.col("k"))
    assert df.select(X.rule_verdict(score, F.lit(False)).alias("v")).first()["v"] == "review"


def test_reason_rounds_ties_to_even(spark):
    df = spark.range(1)
    text = df.select(*[X.overlap_reason(F.lit(v)).alias(str(i)) for i, v in enumerate((1 / 8, 3 / 8))])
    assert list(text.first()) == ["title_overlap=0.12", "title_overlap=0.38"]


def test_tokens_join_over_punctuation(spark):
    assert sorted(apply(spark, X.tokenize, "A.B of the R&D team, team")) == ["ab", "rd", "team"]


@pytest.mark.parametrize(
    ("name", "slug"),
    [("My Profile", "my-profile"), ("  C++ & Co. ", "c-co"), ("!!!", None), ("", None)],
)
def test_slugify(spark, name, slug):
    assert apply(spark, X.slugify, name) == slug


def test_quote_keyword(spark):
    assert apply(spark, X.quote_keyword, " data engineer ") == '"data engineer"'
    assert apply(spark, X.quote_keyword, "engineer") == "engineer"


def test_parse_lines(spark):
    assert apply(spark, X.parse_lines, " a \r\n\n  b\n \t") == ["a", "b"]


def test_relevance_doc_uses_whole_text_unless_bounded(spark):
    long = "x" * 900
    df = spark.createDataFrame([("T", f" {long} "), ("T", "  "), ("T", None)], "t string, d string")
    whole = [r[0] for r in df.select(X.relevance_doc(F.col("t"), F.col("d"))).collect()]
    assert whole == [f"T. {long}", "T", "T"]
    assert len(df.select(X.model_input(F.col("t"), F.col("d"))).first()[0]) == len("T. ") + 499


def test_extraction_input_defaults(spark):
    df = spark.createDataFrame([(None, " ", None)], "t string, d string, k string")
    text = df.select(X.extraction_input(F.col("t"), F.col("d"), F.col("k"))).first()[0]
    assert text == "Job title: (untitled)\n\nJob description:\n(no description)"


def test_stable_key(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    keys = [r[0] for r in df.select(K.stable_key(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert all(len(k) == 24 for k in keys)
    assert keys[0] != keys[1]


def test_salary_key_does_not_depend_on_number_spelling(spark):
    df = spark.createDataFrame([(1e7, "10000000")], "a double, b string")
    nothing = F.lit(None).cast("double")
    row = df.select(
        K.salary_key(F.col("a"), nothing, F.lit("EUR"), F.lit(None)).alias("a"),
        K.salary_key(F.col("b"), F.lit(float("nan")), F.lit(" eur "), F.lit("")).alias("b"),
    ).first()
    assert row["a"] == row["b"]


def test_norm_strips_every_kind_of_white_space(spark):
    assert apply(spark, K.norm, "\t  Ab C \n") == "ab c"
    assert apply(spark, K.norm, None) == ""


def test_clean_skills_keeps_first_seen_order(spark):
    raw = ["Python", "python", "SQL", " sql ", None, "", "Docker"]
    assert apply(spark, N.clean_skills, raw, "array<string>") == ["python", "sql", "docker"]
    assert apply(spark, N.clean_skills, None, "array<string>") == []


@pytest.mark.parametrize(
    ("fn", "value", "expected"),
    [
        (N.country_code, "gb", "GB"), (N.country_code, "USA", None), (N.country_code, "g1", None),
        (N.currency, "eur", "EUR"), (N.currency, "DOLLARS", None), (N.currency, " usd ", "USD"),
        (N.period, "Yearly ", "yearly"), (N.period, "weekly", None), (N.period, "daily", None),
        (N.work_mode, "WFH", None), (N.work_mode, "onsite", "on-site"),
        (N.work_mode, " In Office ", "on-site"), (N.work_mode, "Remote", "remote"),
        (N.work_mode, None, None), (N.strip_or_null, " \t", None), (N.strip_or_null, " a ", "a"),
        (N.is_empty_sentinel, " N/A ", True), (N.is_empty_sentinel, "Paris", False),
        (N.is_empty_sentinel, None, True),
    ],
)
def test_normal_forms(spark, fn, value, expected):
    assert apply(spark, fn, value) == expected


@pytest.mark.parametrize(
    ("raw", "parsed", "coerced"),
    [
        ('["a", null, "b"]', ["a", "b"], ["a", "b"]),
        ('{"a": 1}', [], ['{"a":1}']),
        ("plain text", [], ["plain text"]),
        ("42", [], ["42"]),
        ('"x"', [], ["x"]),
        ("  ", [], []),
        (None, [], []),
        ('["a"', [], ['["a"']),
    ],
)
def test_lists(spark, raw, parsed, coerced):
    assert apply(spark, N.parse_list, raw) == parsed
    assert apply(spark, N.coerce_list, raw) == coerced


@pytest.mark.parametrize(
    ("seconds", "text"), [(None, "-"), (6.54, "6.5s"), (59.96, "60.0s"), (125.9, "2m 5s")]
)
def test_format_duration(spark, seconds, text):
    assert apply(spark, T.format_duration, seconds, "double") == text


@pytest.mark.parametrize(
    ("scores", "verdict"),
    [
        (("accept", 0.9, 1.0, 0.9, True), "accept"),
        (("accept", 0.34, 1.0, 0.9, True), "reject"),
        (("accept", 0.9, -0.1, 0.9, True), "reject"),
        (("accept", 0.9, 1.0, 0.49, True), "reject"),
        (("accept", 0.9, 1.0, 0.9, False), "reject"),
        (("reject", 0.9, 1.0, 0.9, True), "reject"),
        ((None, None, None, None, True), "accept"),
    ],
)
def test_ensemble(spark, scores, verdict):
    df = spark.createDataFrame([scores], "r string, b double, c double, f double, l boolean")
    out = df.select(N.ensemble_verdict(*(F.col(c) for c in df.columns)).alias("v"))
    assert out.first()["v"] == verdict
