"""Records, extraction, scores, cascade, corrective pass."""

import json
import math

import pytest
from pyspark.sql import functions as F

from rolesift.operators import corrective as C
from rolesift.operators import extraction as E
from rolesift.operators import records as R
from rolesift.operators import relevance as REL
from rolesift.plans import cascade as CAS
from rolesift.plans.corrective import corrective_pass
from rolesift.plans.full_run import train_classifiers
from rolesift.sources.tables import Tables
from tests.conftest import values

def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")



def parse(spark, record):
    text = record if isinstance(record, str) else json.dumps(record)
    df = spark.createDataFrame([("1", text)], "job_id string, raw_response string")
    return R.parse_records(df).first()


@pytest.mark.parametrize(
    ("record", "valid"),
    [
        ({}, True),
        ({"tech_skills": ["a", None]}, True),
        ({"tech_skills": "not-a-list"}, False),
        ({"tech_skills": ["a", 5]}, False),
        ({"salary": "null", "location": "null"}, True),
        ({"salary": None, "location": {}}, True),
        ({"salary": "lots"}, False),
        ({"salary": []}, False),
        ({"salary": {"min_amount": "80000"}}, True),
        ({"salary": {"min_amount": "many"}}, False),
        ({"location": {"city": 5}}, False),
        ({"work_mode": 7}, True),
        ({"is_relevant": "no"}, True),
        ({"is_relevant": None}, False),
        ({"relevance_confidence": 1.0}, True),
        ({"relevance_confidence": 1.5}, False),
        ({"relevance_confidence": None}, False),
        ({"relevance_reason": 3}, False),
        ("{bad", False),
        ("[1]", False),
    ],
)
def test_record_validity(spark, record, valid):
    assert parse(spark, record)["valid"] is valid


def test_record_values(spark):
    row = parse(
        spark,
        {
            "tech_skills": ["Python", "python", "SQL", " sql ", "Docker"],
            "location": {"city": " Paris ", "country": " ", "country_code": "fr"},
            "salary": {"min_amount": 5, "max_amount": 7.5, "currency": "eur", "period": "weekly"},
            "work_mode": "onsite",
            "is_relevant": False,
        },
    )
    assert row["tech_skills"] == ["python", "sql", "docker"] and row["soft_skills"] == []
    assert (row["city"], row["country"], row["country_code"]) == ("Paris", None, "FR")
    assert (row["salary_min"], row["salary_max"]) == (5.0, 7.5)
    assert (row["salary_currency"], row["salary_period"]) == ("EUR", None)
    assert row["work_mode"] == "on-site" and row["is_relevant"] is False
    assert row["relevance_confidence"] == 1.0


def test_extraction_from_text(spark):
    df = spark.createDataFrame(
        [("1", "Senior Red Widget maker. EUR 50k - 70k per year, hybrid or remote"),
         ("2", "pay £12 to 15 an hour, work from home"), ("3", None)],
        "id string, text string",
    )
    pay = E.extract_salary(df, "text")
    assert values(pay, "id", "salary_min", "salary_max", "salary_currency", "salary_period") == [
        ("1", 50000.0, 70000.0, "EUR", "yearly"), ("2", 12.0, 15.0, "GBP", "hourly"),
        ("3", None, None, None, None),
    ]
    modes = df.select("id", E.extract_work_mode(F.col("text")).alias("m"))
    assert values(modes) == [("1", "hybrid"), ("2", "remote"), ("3", None)]
    vocabulary = spark.createDataFrame(
        [("red widget", "domain"), ("maker", "soft"), ("absent", "tech")], "name string, skill_type string"
    )
    found = E.extract_skills(df, "id", "text", vocabulary)
    assert values(found) == [("1", "maker", "soft"), ("1", "red widget", "domain")]
    assert values(E.skill_lists(found, "id")) == [("1", [], ["maker"], ["red widget"])]


@pytest.mark.parametrize(
    ("text", "low", "high", "currency", "period"),
    [
        ("12.50 to 15 an hour", 12.5, 15.0, None, "hourly"),
        ("1,000 - 2000 per month", 1000.0, 2000.0, None, "monthly"),
        ("we pay $120,000 - $150,000 per year", 120000.0, 150000.0, "USD", "yearly"),
        ("120,000 - 150,000 per year.", 120000.0, 150000.0, None, "yearly"),
        ("£30k-£40k per year", 30000.0, 40000.0, "GBP", "yearly"),
        ("50-70k a year", 50000.0, 70000.0, None, "yearly"),
        ("EUR 40 000? no: EUR 45000–50000 / year", 45000.0, 50000.0, "EUR", "yearly"),
        ("9 to 12 an hour", 9.0, 12.0, None, "hourly"),
        ("from $85,000 per year", 85000.0, 85000.0, "USD", "yearly"),
        ("€9.50 an hour", 9.5, 9.5, "EUR", "hourly"),
        ("meets 3 per month", None, None, None, None),
        ("room B12 per hour", None, None, None, None),
        ("ref 1.234567 per year", None, None, None, None),
        ("$60 000 per year", 60000.0, 60000.0, "USD", "yearly"),
        ("pay 1 000 000 per year", 1000000.0, 1000000.0, None, "yearly"),
        ("120,000 EUR per year", 120000.0, 120000.0, "EUR", "yearly"),
        ("50,000 € per month", 50000.0, 50000.0, "EUR", "monthly"),
        ("$25/hr", 25.0, 25.0, "USD", "hourly"),
        ("USD 120000-150000 annually", 120000.0, 150000.0, "USD", "yearly"),
        ("€45.000 - €55.000 per year", 45000.0, 55000.0, "EUR", "yearly"),
        ("₹12,00,000 per year", 1200000.0, 1200000.0, "INR", "yearly"),
        ("₹12,00,000 - ₹15,50,000 p.a.", 1200000.0, 1550000.0, "INR", "yearly"),
        ("$800 per week", 800.0, 800.0, "USD", None),
        ("£350-£400 per day", 350.0, 400.0, "GBP", None),
        ("40 000 to 50 000 per year", 40000.0, 50000.0, None, "yearly"),
        ("60\u00a0000 CHF per year", 60000.0, 60000.0, "CHF", "yearly"),
        ("CHF 90'000 - 110'000 per annum", 90000.0, 110000.0, "CHF", "yearly"),
        ("1.234,50 € per month", 1234.5, 1234.5, "EUR", "monthly"),
        ("€1.234.567 yearly", 1234567.0, 1234567.0, "EUR", "yearly"),
        ("12,50 € an hour", 12.5, 12.5, "EUR", "hourly"),
        ("$1,234.56 monthly", 1234.56, 1234.56, "USD", "monthly"),
        ("80k USD a year", 80000.0, 80000.0, "USD", "yearly"),
        ("80K-95K GBP per year", 80000.0, 95000.0, "GBP", "yearly"),
        ("60 k - 70 k EUR per year", 60000.0, 70000.0, "EUR", "yearly"),
        ("¥5,000,000 per year", 5000000.0, 5000000.0, "JPY", "yearly"),
        ("in 2024 we pay $60 000 per year", 60000.0, 60000.0, "USD", "yearly"),
        ("3 EUR an hour", 3.0, 3.0, "EUR", "hourly"),
        ("$20 - 25 / h", 20.0, 25.0, "USD", "hourly"),
        ("1500/mo", 1500.0, 1500.0, None, "monthly"),
        ("weekly meetings, 30 days, $15 hourly", 15.0, 15.0, "USD", "hourly"),
        ("EUROPE 12000 per year", 12000.0, 12000.0, None, "yearly"),
        ("call 555 1234 per year", None, None, None, None),
        ("12345678901 per year", None, None, None, None),
        ("0.5k EUR per month", 500.0, 500.0, "EUR", "monthly"),
        ("", None, None, None, None),
    ],
)
def test_pay_texts(spark, text, low, high, currency, period):
    row = E.extract_salary(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert tuple(row)[1:] == (low, high, currency, period)


def test_only_hits_leave_their_row(spark):
    long = " ".join(f"part{k}" for k in range(50))
    vocabulary = spark.createDataFrame([(long, "tech"), ("gear", "soft"), ("fine gear", "domain"), (None, "soft")], "name string, skill_type string")
    texts = [(k, " ".join(f"word{k}x{j}" for j in range(100)) + (" Fine gear!" if k % 10 == 0 else "") + (f" {long}" if k == 7 else "")) for k in range(300)]
    found = E.extract_skills(spark.createDataFrame([*texts, (300, None), (301, "")], "id long, text string"), "id", "text", vocabulary)
    expected = [(k, n, t) for k in range(0, 300, 10) for n, t in (("fine gear", "domain"), ("gear", "soft"))] + [(7, long, "tech")]
    assert values(found) == sorted(expected, key=repr)
    # the rows that meet the vocabulary: 100 words x 50 lengths x 300 texts without the index
    lengths, may_begin = E.first_words(vocabulary)
    assert lengths == [1, 2, 50]
    every = spark.createDataFrame([(f"word{k}x{j}",) for k in range(30) for j in range(100)], "w string")
    passed = every.select(sum(may_begin(F.col("w"), n).cast("int") for n in lengths).alias("n")).agg(F.sum("n")).first()[0]
    assert passed < 0.02 * 3 * 3000
    assert E.extract_skills(every.withColumn("id", F.lit(1)), "id", "w", vocabulary.limit(0)).isEmpty()
    assert E.extract_skills(spark.createDataFrame(texts, "id long, text string"), "id", "text", vocabulary, max_words=1).select("name").distinct().count() == 1


def test_phrases_of_any_length_and_whole_records(spark):
    vocabulary = spark.createDataFrame(
        [("machine learning engineer", "tech"), ("machine learning", "tech"), ("patient", "soft")], "name string, skill_type string"
    )
    rows = spark.createDataFrame(
        [("1", "Senior machine learning engineer wanted, remote, 50k - 60k per year", "Berlin, Germany"), ("2", None, None),
         ("3", "be patient", "Hong Kong"), ("4", "", "Atlantis")],
        "id string, text string, place string",
    )
    found = E.extract_skills(rows, "id", "text", vocabulary)
    assert set(values(found.filter("id = '1'"), "name")) == {("machine learning",), ("machine learning engineer",)}
    record = {r["id"]: r.asDict() for r in E.extract_fields(rows, "id", "text", "place", vocabulary).collect()}
    assert len(record) == 4
    assert record["1"] == {
        "id": "1", "tech_skills": ["machine learning", "machine learning engineer"], "soft_skills": [], "domain_skills": [],
        "city": "Berlin", "country": "Germany", "country_code": "DE", "work_mode": "remote", "salary_min": 50000.0,
        "salary_max": 60000.0, "salary_currency": None, "salary_period": "yearly",
    }
    assert record["2"]["tech_skills"] == [] and record["2"]["city"] is None
    assert (record["3"]["city"], record["3"]["country"], record["3"]["country_code"]) == (None, "Hong Kong", "HK")
    assert (record["4"]["city"], record["4"]["country_code"]) == ("Atlantis", None)


def test_plugged_in_extractor_counts_failures(spark):
    df = spark.createDataFrame(
        [("1", "good", "d", "k"), ("2", "bad", "d", "k")],
        "id string, title string, description string, search_keyword string",
    )

    def make():
        def extract(batch):
            if (batch["title"] == "bad").any():
                raise ValueError("no")
            return [("{}", None)] * len(batch)

        return extract

    out = E.run_extractor(df.coalesce(1), "id", make)
    assert values(out) == [("1", "{}", None), ("2", None, "ValueError: no")]


def test_plugged_in_scorer(spark):
    df = spark.createDataFrame([("1", "abc"), ("2", "a")], "id string, title string")
    out = REL.run_scorer(df, "id", ["title"], lambda: lambda b: b["title"].str.len(), "pair_score")
    assert values(out) == [("1", 3.0), ("2", 1.0)]


def test_cosine_is_clamped_and_meets_own_query_only(spark):
    items = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (2, 0, [-1.0, 0.0]), (3, 1, [1.0, 1.0])],
        "vec_id long, label int, embedding array<float>",
    )
    queries = spark.createDataFrame(
        [(0, [2.0, 0.0]), (1, [0.0, 1.0])], "query_label int, query_embedding array<float>"
    )
    scored = REL.semantic_score(items, queries, ("label", "query_label"))
    got = dict(values(scored.select("vec_id", F.round("semantic_score", 6))))
    assert got == {1: 1.0, 2: 0.0, 3: round(math.sqrt(0.5), 6)}
    assert values(REL.semantic_topk(scored, "label", "vec_id", 1), "label", "vec_id") == [(0, 1), (1, 3)]


def _bm25(docs):
    words = {k: t.lower().split() for k, (_, t) in docs.items()}
    avg = sum(map(len, words.values())) / len(words)
    out = {}
    for k, (query, _) in docs.items():
        total = 0.0
        for term in sorted(set(query.split())):
            df = sum(term in w for w in words.values())
            idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
            tf = words[k].count(term)
            length = 1.2 * (0.25 + 0.75 * len(words[k]) / avg)
            total += idf * (tf * 2.2 / (tf + length) - 0.5)
        out[k] = total
    return out


def test_bm25_against_brute_force(spark):
    docs = {
        f"d{i}": (("red gear", "red gear red plate")[0] if i % 3 else "plate", " ".join(
            ["red", "gear", "plate", "bolt"][(i + j) % 4] for j in range(1 + i % 7))) for i in range(30)
    }
    df = spark.createDataFrame([(k, q, t) for k, (q, t) in docs.items()], "id string, q string, t string")
    got = dict(values(REL.pair_score_bm25(df, "id", "q", "t")))
    assert got == pytest.approx(_bm25(docs))


def test_fewshot(spark):
    good, bad = ["data engineer", "data lead", "data analyst", "data scientist"], ["cook", "chef cook", "sous cook", "line cook"]
    rows = [("p", t, "accept") for t in good] + [("p", t, "reject") for t in bad] + [("q", "x", "accept")]
    labels = spark.createDataFrame(rows, "profile_id string, title_norm string, label string")
    assert values(REL.trainable_profiles(labels)) == [("p", 4, 4)]
    model = REL.FewShot.train(labels)
    posts = spark.createDataFrame(
        [("1", "p", "data wizard"), ("2", "p", "cook"), ("3", "q", "cook"), ("4", None, "cook")],
        "id string, profile_id string, title string",
    )
    scores = dict(values(model.predict(posts, "id")))
    assert scores["1"] > 0.5 > scores["2"] and scores["3"] == scores["4"] == 1.0
    assert REL.FewShot.train(labels.filter("profile_id = 'q'")) is None
    assert values(REL.fewshot_scores(None, posts, "id"), "fewshot_score") == [(1.0,)] * 4


def test_fewshot_outlives_its_session(spark, tmp_path):
    good, bad = ["data engineer", "data lead", "data analyst", "data scientist"], ["cook", "chef cook", "sous cook", "line cook"]
    rows = [("p", t, "accept") for t in good] + [("p", t, "reject") for t in bad] + [("q", "x", "accept")]
    tables = Tables(spark, str(tmp_path))
    assert REL.FewShot.load(tables) is None and train_classifiers(tables) is None
    labels = spark.createDataFrame(rows, "profile_id string, title_norm string, label string")
    tables.publish({"profile_title_labels": labels})
    trained = train_classifiers(tables)
    posts = spark.createDataFrame(
        [("1", "p", "data wizard"), ("2", "p", "cook"), ("3", "q", "cook"), ("4", None, "cook"), ("5", "p", None)],
        "id string, profile_id string, title string",
    )
    stored = REL.FewShot.load(Tables(spark, str(tmp_path)))  # another reader
    assert values(stored.profiles, "profile_id", "n_accept", "n_reject") == [("p", 4, 4)]
    assert values(stored.predict(posts, "id")) == values(trained.predict(posts, "id"))
    assert values(stored.predict(posts, "id")) == values(REL.FewShot.train(labels).predict(posts, "id"))
    tables.publish({"profile_title_labels": labels.limit(0)})
    assert train_classifiers(tables) is None and REL.FewShot.load(Tables(spark, str(tmp_path))) is None


def staging(spark):
    return spark.createDataFrame(
        [("1", "run", "p", "red widget", "Red Widget", "t"), ("2", "run", "p", "red widget", "cook", "t"),
         ("3", "run", "p", "red widget", "red widget maker", None), ("4", "old", "p", "red widget", "x", "t")],
        "id string, run_id string, profile_id string, search_keyword string, title string, "
        "description string",
    ).withColumn("scraped_at", F.lit("2026-01-01").cast("timestamp_ntz"))


def test_pending_rows(spark):
    done = spark.createDataFrame([("1",)], "job_id string")
    judged = spark.createDataFrame(
        [("2", "reject", "reject"), ("3", "review", "reject")],
        "job_id string, rule_verdict string, ensemble_verdict string",
    )
    pend = lambda **kw: values(CAS.pending_rows(staging(spark), done, judged, **kw), "id")
    assert pend() == [("3",), ("4",)]
    assert pend(run_id="run") == [("3",)]
    assert pend(limit=1) == [("3",)]
    assert pend(limit=0) == []
    assert pend(skip_rejected=True) == [("4",)]


def test_cascade(spark):
    none = spark.createDataFrame([], "job_id string, rule_verdict string, ensemble_verdict string")
    todo = CAS.pending_rows(staging(spark), none.select("job_id"), none)

    def extract(rows):
        records = rows.filter("id <> '3'").select(
            F.col("id").alias("job_id"), F.lit('{"tech_skills":["a"]}').alias("raw_response")
        )
        return R.normalize_records(records).withColumnRenamed("job_id", "id").drop("raw_response")

    result = CAS.relevance_cascade(todo, extract, now(), pair=lambda df: df.select("id", F.lit(1.0).alias("pair_score")))
    assert values(result.verdicts(), "job_id", "ensemble_verdict", "llm_is_relevant") == [
        ("1", "accept", True), ("2", "reject", None), ("4", "reject", None)
    ]
    assert values(CAS.enrichment_summary(result.status)) == [(4, 3, 1)]
    assert values(result.enriched, "job_id", "tech_skills") == [("1", ["a"])]


def judged(spark, accepted, rejected):
    rows = [(f"a{i}", "p", "kw", f"red lead {i}", "accept") for i in range(accepted)]
    rows += [(f"r{i}", "p", "kw", f"cook {i}", "reject") for i in range(rejected)]
    frame = spark.createDataFrame(
        rows, "job_id string, profile_id string, search_keyword string, job_title string, "
        "ensemble_verdict string"
    ).withColumn("judged_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    landed = frame.select(
        F.col("job_id").alias("id"), F.lit("run").alias("run_id"), F.lit("London").alias("search_location")
    )
    return frame, landed


def test_acceptance_rate_and_trigger(spark):
    frame, landed = judged(spark, 2, 3)
    rates = C.acceptance_rates(C.judged_in_run(frame, landed, "run"))
    assert values(rates, "acceptance_rate") == [(0.4,)]
    assert corrective_pass(frame, landed).requests.count() == 0
    frame, landed = judged(spark, 1, 9)
    found = corrective_pass(frame, landed, run_id="run", profile_id="p")
    report = found.report.first()
    assert report["triggered"] and 0 < len(report["alternatives"]) <= 3
    assert "red" in report["alternatives"][0] or "lead" in report["alternatives"][0]
    assert found.requests.count() == len(report["alternatives"])
    assert corrective_pass(frame, landed, run_id="other").report.count() == 0


def test_sample_titles_are_the_newest(spark):
    frame, landed = judged(spark, 0, 9)
    frame = frame.withColumn("judged_at", F.timestamp_add(
        "HOUR", F.substring("job_id", 2, 1).cast("int"), F.col("judged_at")))
    sample = C.sample_titles(C.judged_in_run(frame, landed), n=2)
    assert values(sample, "position", "job_title") == [(1, "cook 8"), (2, "cook 7")]


def test_proposed_alternatives(spark):
    verdicts = [
        ("1", "low", "Good One", "accept"), ("2", "low", "bad", "reject"), ("3", "low", "worse", "reject"), ("4", "low", "worst", "reject"),
        ("5", "low", None, "reject"), ("6", "fine", "good", "accept"), ("7", "untitled", None, "reject"), ("8", None, "x", "reject"),
    ]
    judged = spark.createDataFrame(
        [(i, "p", k, t, v) for i, k, t, v in verdicts],
        "job_id string, profile_id string, search_keyword string, job_title string, ensemble_verdict string",
    ).withColumn("judged_at", now())
    landed = spark.createDataFrame(
        [(i, "run", place) for (i, *_), place in zip(verdicts, "abababab", strict=True)] + [("9", "other", "far")],
        "id string, run_id string, search_location string",
    )

    def make():
        def propose(keyword, accepted, rejected):
            if keyword == "untitled":
                assert accepted == [] and rejected == []
                return None
            assert accepted == ["Good One"] and rejected == ["bad", "worse", "worst"]
            return [" new ", "", None, "LOW", "new", "newer", "newest", "too many"]

        return propose

    for run in (None, "run"):
        found = corrective_pass(judged, landed, run_id=run, propose=make)
        assert {(r[0], r[1]) for r in values(found.report, "search_keyword", "triggered")} == {("low", True), ("fine", False), ("untitled", True)}
        assert values(found.requests, "alternative", "search_location") == [(t, p) for t in ("new", "newer", "newest") for p in "ab"]
    assert corrective_pass(judged.limit(0), landed, propose=make).requests.isEmpty()
