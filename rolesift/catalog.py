"""Every job as a named query over a folder of the given tables.

``QUERIES[name](spark, folder)`` returns a frame. Lists come out as joined text and
times as fixed-format text, so results can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.constants import LABELS, VERDICTS, WORK_MODES
from rolesift.functions import keys as K
from rolesift.functions import normalize as N
from rolesift.functions import text as X
from rolesift.operators import corrective as C
from rolesift.operators import extraction as E
from rolesift.operators import landing as L
from rolesift.operators import marts as M
from rolesift.operators import profiles as P
from rolesift.operators import quality as Q
from rolesift.operators import readers as R
from rolesift.operators import records as REC
from rolesift.operators import relevance as REL
from rolesift.operators import rules as RULES
from rolesift.operators import runs as RUN
from rolesift.operators import star as S
from rolesift.operators import triage as TRI
from rolesift.operators import upsert as U
from rolesift.operators.dedup import first_per_key
from rolesift.plans import cascade as CAS
from rolesift.plans import full_run as FULL
from rolesift.plans import transform as TF
from rolesift.plans import write_back as WB
from rolesift.plans.corrective import corrective_pass
from rolesift.schemas import PRIMARY_KEYS, align_table
from rolesift.session import shared_folder, tune
from rolesift.sources.postings import (
    drop_blank_url,
    land_sites,
    raw_payload,
    read_postings,
    with_missing_columns,
    write_postings,
)
from rolesift.sources.tables import Tables, scan_mart
from rolesift.sources.views import Views
from rolesift.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
NOW = "2030-01-01 00:00:00"


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable values: rounded numbers, 64-bit integers, text for lists and times."""

    def shown(field: T.StructField) -> Column:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            value = F.round(value.cast("double"), digits)
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            value = value.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            value = F.array_join(value, "|")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            value = F.date_format(value, TIME_FORMAT)
        elif isinstance(kind, T.DateType):
            value = value.cast("string")
        return value.alias(field.name)

    return df.select([shown(field) for field in df.schema])


def query(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a function of the views under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(make(Views(tune(spark), folder)))

    QUERIES[make.__name__] = run
    return make


def now() -> Column:
    """A fixed time, so that written times can be compared."""
    return F.lit(NOW).cast("timestamp_ntz")


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


# === shared inputs ===============================================================
def mart(v: Views, name: str) -> DataFrame:
    """A mart computed from the written star tables."""
    make, inputs = TF.MART_INPUTS[f"mart_{name}"]
    return make(*v.star(*inputs))


def kept_mart(v: Views, name: str) -> DataFrame:
    """A mart as readers find it: a written table."""
    return v.kept(f"mart_{name}", lambda: mart(v, name))


def in_run(v: Views) -> DataFrame:
    return C.judged_in_run(v.judged(), v.staging(texts=False))


def profiles(v: Views) -> DataFrame:
    """Profiles as a user would type them: padded lists, one unknown board."""
    return v.profiles().select(
        "profile_id", "name", F.lit("  ").alias("description"),
        F.array_append("keywords", F.lit("  ")).alias("keywords"), "locations",
        F.array(F.lit("linkedin"), F.lit("indeed"), F.lit("not_a_site")).alias("sites"),
        "updated_at",
    )


def cleaned_profiles(v: Views) -> DataFrame:
    return P.clean_profiles(profiles(v))


# === sources and sinks ===========================================================
@query
def src_postings(v: Views) -> DataFrame:
    """Land the feed as files, one format per board, and read them back as one feed."""
    feed = v.kept("feed", v.feed)
    folder = shared_folder(v.spark, "landed")
    columns = [c for c in read_schema_names() if c != "description"]
    for site, fmt in (("linkedin", "parquet"), ("indeed", "json"), ("glassdoor", "csv")):
        rows = feed.filter(F.col("site") == site)
        # the CSV board gives no descriptions
        rows = rows.select(columns if fmt == "csv" else read_schema_names())
        write_postings(rows, f"{folder}/{fmt}", fmt)
    frames = [read_postings(v.spark, f"{folder}/{f}", f) for f in ("parquet", "json", "csv")]
    return with_missing_columns(frames).select(
        "site", "job_url", "title", "company", "location", "date_posted", "job_type",
        "min_amount", "max_amount", "currency", "interval", "is_remote", "salary_source",
        sha(F.col("description")).alias("description_sha"),
    )


def read_schema_names() -> list[str]:
    from rolesift.schemas import FEED_SCHEMA

    return FEED_SCHEMA.names


@query
def stage_postings(v: Views) -> DataFrame:
    return v.staging().select(
        "id", "scraped_at", "run_id", "profile_id", "site", "search_keyword", "search_location",
        "job_url", "job_url_direct", "title", "company", "location_raw", "date_posted", "job_type",
        "salary_raw", "min_amount", "max_amount", "currency", "interval", "is_remote",
        "company_url", "company_industry", sha(F.col("description")).alias("description_sha"),
    )


@query
def raw_payload_json(v: Views) -> DataFrame:
    """Payload text of every feed row, read back field by field."""
    payload = v.feed().select("k", raw_payload().alias("payload"))

    def part(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}")

    return payload.select(
        "k", part("site").alias("site"), part("job_url").alias("job_url"),
        part("title").alias("title"), part("date_posted").alias("date_posted"),
        part("min_amount").cast("double").alias("min_amount"),
        part("salary_source").alias("salary_source"), part("is_remote").alias("is_remote"),
        F.col("payload").contains('"title":null').alias("title_null_kept"),
        F.col("payload").contains('"description"').alias("has_description"),
    )


@query
def schema_align(v: Views) -> DataFrame:
    """Older rows without skills, provider or profile, brought to today's columns."""
    old = v.enriched().drop("domain_skills", "llm_provider").withColumn("extra", F.lit(1))
    aligned = align_table(old, "int_enriched_job_info", {"llm_provider": "unknown"})
    return aligned.drop("raw_response")


@query
def drop_blank_urls(v: Views) -> DataFrame:
    return drop_blank_url(v.feed()).select("k", "site", "job_url")


QUERIES["drop_blank_url"] = QUERIES.pop("drop_blank_urls")


@query
def upsert_ignore_dim(v: Views) -> DataFrame:
    """Locations of all runs added to those of the first three years."""
    rows = v.gated(skills=False)
    first = rows.filter(F.col("run_id") <= "run-1997")
    target = S.build_dim_location(first).withColumn("country", F.lit("kept"))
    return U.upsert_ignore(target, S.build_dim_location(rows), ["location_key"])


@query
def upsert_ignore_fact(v: Views) -> DataFrame:
    fact = S.build_fact(v.gated(skills=False))
    target = fact.filter(F.col("run_id") <= "run-1997").withColumn("title", F.lit("kept"))
    merged = U.upsert_ignore(target, fact, ["job_id"])
    return merged.select("job_id", "run_id", "title", "location_key", "salary_key")


def _new_verdicts(v: Views) -> DataFrame:
    """Second-pass verdicts for full-time postings, known to the judged table or not."""
    fulltime = v.staging(texts=False).filter("job_type in ('fulltime', 'contract')")
    return fulltime.select(
        F.col("id").alias("job_id"), "profile_id", "search_keyword",
        F.lit("new title").alias("job_title"), F.lit("accept").alias("rule_verdict"),
        (F.col("search_keyword") == "hot plate").alias("llm_is_relevant"),
        F.lit(0.75).alias("llm_confidence"),
        F.when(F.col("search_keyword") == "hot plate", "accept").otherwise("reject").alias(
            "ensemble_verdict"
        ),
        now().alias("judged_at"),
    )


@query
def upsert_update_verdicts(v: Views) -> DataFrame:
    target = align_table(v.judged(), "judged_job_offers")
    merged = U.upsert_update(
        target, _new_verdicts(v), ["job_id"],
        ["llm_is_relevant", "llm_confidence", "ensemble_verdict", "judged_at"],
    )
    return merged.select(
        "job_id", "job_title", "rule_verdict", "llm_is_relevant", "llm_confidence",
        "ensemble_verdict", "judged_at",
    )


def _label_edits(v: Views) -> DataFrame:
    """Edits for every judged title with a red part, some with a label that does not exist."""
    titles = TRI.with_title_norm(v.judged()).filter(
        F.col("profile_id").isNotNull() & F.col("title_norm").startswith("red")
    )
    return titles.select("profile_id", "title_norm").distinct().select(
        "profile_id", "title_norm",
        F.when(F.col("title_norm").contains("remote"), "maybe").otherwise("accept").alias("label"),
        F.lit("edited").alias("note"), F.lit(7).alias("count_seen"),
    )


@query
def upsert_label_counts(v: Views) -> DataFrame:
    return U.upsert_labels(v.labels(), _label_edits(v), now())


@query
def delete_labels(v: Views) -> DataFrame:
    return U.delete_by_key(v.labels(), _label_edits(v), TRI.LABEL_KEYS).select(
        "profile_id", "title_norm", "label", "count_seen"
    )


@query
def replace_profiles(v: Views) -> DataFrame:
    stored = cleaned_profiles(v).select("profile_id", "name", "keywords", "locations")
    edited = stored.filter("name < 'C'").withColumn("locations", F.array(F.lit("Spain")))
    return U.replace_by_key(stored, edited, ["profile_id"])


@query
def mart_scan_profile(v: Views) -> DataFrame:
    return scan_mart(kept_mart(v, "jobs_by_country"), "building")


@query
def run_registry(v: Views) -> DataFrame:
    runs = v.runs()
    starts = runs.select("run_id", "profile_id", "started_at")
    finishes = runs.filter("finished_at is not null").select(
        "run_id", "finished_at", "status", "scraped_count", "enriched_count", "error_message"
    )
    return RUN.run_registry(starts, finishes)


# === projections, filters ========================================================
PENDING = ("id", "title", "search_keyword", "profile_id", "rule_verdict")


@query
def pending_rows(v: Views) -> DataFrame:
    return CAS.pending_rows(v.staging(texts=False), v.enriched_ids(), v.judged()).select(*PENDING)


@query
def pending_rows_limited(v: Views) -> DataFrame:
    todo = CAS.pending_rows(
        v.staging(texts=False), v.enriched_ids(), v.judged(), run_id="run-1998", limit=100
    )
    return todo.select(*PENDING)


@query
def verdict_gated(v: Views) -> DataFrame:
    return v.gated().select(
        "job_id", "run_id", "profile_id", "search_keyword", "title", "tech_skills", "city",
        "country_code", "work_mode", "salary_min", "salary_max", "enriched_at",
    )


def _wide(v: Views, **options) -> DataFrame:
    star = v.star("fact_job_offers", "dim_location", "dim_salary")
    return R.fact_with_dims(*star, v.enriched_of, **options)


@query
def fact_with_dims(v: Views) -> DataFrame:
    return _wide(v)


@query
def fact_with_dims_by_keyword(v: Views) -> DataFrame:
    return _wide(v, keyword="hot plate", limit=50)


@query
def fact_with_dims_by_profile(v: Views) -> DataFrame:
    return _wide(v, profile_id="building", limit=5000)


@query
def filter_multi_isin(v: Views) -> DataFrame:
    fact, dim_location = v.star("fact_job_offers", "dim_location")
    facts = fact.join(dim_location, "location_key", "left")
    picked = R.apply_filters(
        facts, search_keyword=["hot plate", "blue ring"], country=[], work_mode=["remote", "hybrid"]
    )
    return picked.select("job_id", "search_keyword", "country", "work_mode")


@query
def filter_mart_keywords(v: Views) -> DataFrame:
    return R.apply_filters(
        kept_mart(v, "work_mode_distribution"), search_keyword=["hot plate"], no_column=["x"]
    )


@query
def run_history_filter(v: Views) -> DataFrame:
    runs = RUN.history_filter(
        v.runs(), ["success", "failed"], "p2", "2024-01-05", "2024-01-20"
    )
    return runs.select("run_id", "profile_id", "status", "started_at")


def _profile_names(v: Views) -> DataFrame:
    ids = v.runs().select("profile_id").distinct()
    return ids.filter("profile_id < 'p4'").select(
        "profile_id", F.concat(F.lit("Profile "), "profile_id").alias("name")
    )


@query
def run_history_view(v: Views) -> DataFrame:
    return RUN.history_view(v.runs(), _profile_names(v))


@query
def salary_bands_long(v: Views) -> DataFrame:
    return M.salary_bands_long(kept_mart(v, "salary_by_keyword"))


def _candidates(v: Views, include_decided: bool) -> DataFrame:
    return TRI.triage_candidates(
        v.judged(), v.staging(texts=False), v.labels(), "machinery", include_decided
    )


@query
def triage_editor_view(v: Views) -> DataFrame:
    return TRI.editor_view(_candidates(v, True))


@query
def bulk_label_review(v: Views) -> DataFrame:
    return TRI.bulk_label(TRI.editor_view(_candidates(v, False)), "accept")


@query
def changed_labels(v: Views) -> DataFrame:
    stored = _candidates(v, True)
    edited = TRI.bulk_label(TRI.editor_view(stored), "reject")
    return TRI.changed_labels(edited, stored)


# === joins =======================================================================
@query
def anti_unenriched(v: Views) -> DataFrame:
    done = v.enriched_ids().select(F.col("job_id").alias("id"))
    return U.new_rows(v.staging(texts=False), done, ["id"]).select("id", "run_id", "title")


def _seen_before(v: Views) -> DataFrame:
    return v.staging(texts=False).filter(F.col("run_id") <= "run-1997").select("id")


@query
def semi_existing_ids(v: Views) -> DataFrame:
    return U.known_keys(v.staging(texts=False), _seen_before(v), ["id"])


@query
def anti_new_ids(v: Views) -> DataFrame:
    return U.new_rows(v.staging(texts=False), _seen_before(v), ["id"]).select("id", "site", "job_url")


@query
def label_match_join(v: Views) -> DataFrame:
    return TRI.match_labels(v.judged(), v.labels()).select(
        "job_id", "profile_id", "title_norm", "ensemble_verdict", "user_label"
    )


@query
def apply_labels(v: Views) -> DataFrame:
    return TRI.apply_labels(v.judged(), v.labels(), now()).select(
        "job_id", "ensemble_verdict", "judged_at", "changed"
    )


@query
def label_write_back(v: Views) -> DataFrame:
    """Labels saved, verdicts overridden and read back from the published table."""
    tables = Tables(v.spark, shared_folder(v.spark, "write-back"))
    tables.publish({"judged_job_offers": v.judged()})
    WB.save_labels(tables, v.labels(), now())
    WB.apply_labels_to_judged(tables, now())
    return tables.read("judged_job_offers").select("job_id", "ensemble_verdict", "judged_at")


@query
def label_match_count(v: Views) -> DataFrame:
    return TRI.label_match_count(v.judged(), v.labels())


@query
def count_accepted_for_keywords(v: Views) -> DataFrame:
    wanted = v.staging(texts=False).select("run_id", "search_keyword").distinct().filter(
        "search_keyword in ('hot plate', 'small gear')"
    )
    return C.count_accepted(in_run(v), wanted, ["run_id"])


@query
def request_matrix(v: Views) -> DataFrame:
    return L.request_matrix(cleaned_profiles(v))


@query
def blocked_titles(v: Views) -> DataFrame:
    flagged = RULES.with_blocked_flag(v.staging(texts=False), v.labels())
    return flagged.select("id", "profile_id", "title", "blocked")


@query
def country_totals(v: Views) -> DataFrame:
    return M.country_totals(kept_mart(v, "jobs_by_country"))


@query
def country_iso3(v: Views) -> DataFrame:
    totals = M.country_totals(kept_mart(v, "jobs_by_country"))
    return M.country_iso3(totals, M.iso_codes(v.spark)).select("iso3", "country", "job_count")


# === aggregations ================================================================
@query
def mart_jobs_by_country(v: Views) -> DataFrame:
    return mart(v, "jobs_by_country")


@query
def mart_skills_by_keyword(v: Views) -> DataFrame:
    return mart(v, "skills_by_keyword")


@query
def mart_salary_by_keyword(v: Views) -> DataFrame:
    return mart(v, "salary_by_keyword")


@query
def mart_work_mode_distribution(v: Views) -> DataFrame:
    return mart(v, "work_mode_distribution")


@query
def acceptance_rates(v: Views) -> DataFrame:
    return C.acceptance_rates(in_run(v))


@query
def acceptance_rates_profile(v: Views) -> DataFrame:
    return C.acceptance_rates(in_run(v), profile_id="building")


@query
def triage_candidates(v: Views) -> DataFrame:
    return _candidates(v, False)


@query
def triage_candidates_all(v: Views) -> DataFrame:
    return _candidates(v, True)


@query
def triage_metrics(v: Views) -> DataFrame:
    return TRI.triage_metrics(v.judged())


@query
def triage_pending(v: Views) -> DataFrame:
    return TRI.triage_pending(v.judged(), v.labels())


@query
def count_jobs(v: Views) -> DataFrame:
    (fact,) = v.star("fact_job_offers")
    both = [
        R.count_jobs(fact, p).withColumn("scope", F.lit(p or "all")) for p in (None, "building")
    ]
    return both[0].unionByName(both[1])


@query
def run_summary(v: Views) -> DataFrame:
    return RUN.run_summary(v.runs())


@query
def label_summary(v: Views) -> DataFrame:
    return TRI.label_summary(v.labels())


@query
def trainable_profiles(v: Views) -> DataFrame:
    return REL.trainable_profiles(v.labels())


@query
def load_counts_by_site(v: Views) -> DataFrame:
    return L.load_counts(L.request_matrix(cleaned_profiles(v)), v.staging(texts=False))


@query
def load_counts_with_errors(v: Views) -> DataFrame:
    """One board's files are missing: its requests load nothing and say why, the others land."""
    folder = shared_folder(v.spark, "boards")
    sites = ("linkedin", "glassdoor", "indeed")
    for site in sites[:2]:
        write_postings(v.kept("feed", v.feed).filter(F.col("site") == site).select(read_schema_names()), f"{folder}/{site}")
    sources = {site: (f"{folder}/{site}", "parquet") for site in sites}
    landed, status = land_sites(v.spark, sources, shared_folder(v.spark, "landed-boards"))
    keys = landed.select("site", "job_url").distinct()
    loaded = v.staging(texts=False).join(keys, ["site", "job_url"], "left_semi")
    counts = L.load_counts(L.request_matrix(cleaned_profiles(v)), loaded, status)
    return counts.select(
        "profile_id", "keyword", "location", "site", "rows_loaded",
        F.regexp_extract("error", r"\[(\w+)\]", 1).alias("error"),
    )


@query
def enrichment_summary(v: Views) -> DataFrame:
    return CAS.enrichment_summary(_cascade(v).status)


@query
def transform_summary(v: Views) -> DataFrame:
    return TF.transform_summary(S.star_frames(v.kept_gated()))


@query
def distinct_locations(v: Views) -> DataFrame:
    return C.distinct_locations(v.staging(texts=False))


@query
def filter_options(v: Views) -> DataFrame:
    return R.filter_options(*v.star("fact_job_offers", "dim_location"))


@query
def planned_workload(v: Views) -> DataFrame:
    return L.planned_workload(cleaned_profiles(v))


# === windows, order ==============================================================
@query
def dedup_first(v: Views) -> DataFrame:
    keyed = drop_blank_url(v.feed()).withColumn("id", K.posting_id(F.col("site"), F.col("job_url")))
    first = first_per_key(keyed, ["id"], [F.col("scraped_at"), F.col("k")])
    return first.select("id", "k", "scraped_at")


@query
def top_skills_per_keyword(v: Views) -> DataFrame:
    return M.top_skills(kept_mart(v, "skills_by_keyword"))


@query
def sample_titles(v: Views) -> DataFrame:
    return C.sample_titles(in_run(v))


@query
def latest_run(v: Views) -> DataFrame:
    every = RUN.latest_run(v.runs()).withColumn("scope", F.lit("all"))
    return every.unionByName(RUN.latest_run(v.runs(), "p3").withColumn("scope", F.lit("p3")))


@query
def latest_run_per_profile(v: Views) -> DataFrame:
    return RUN.latest_run_per_profile(v.runs())


@query
def list_labels(v: Views) -> DataFrame:
    return TRI.list_labels(v.labels())


@query
def recent_runs(v: Views) -> DataFrame:
    return RUN.recent_runs(v.runs(), 100).select(
        "run_id", "profile_id", "started_at", "status", "scraped_count"
    )


@query
def list_profiles(v: Views) -> DataFrame:
    return P.list_profiles(profiles(v)).select("profile_id", "name", "keywords", "updated_at")


# === scalar functions ============================================================
@query
def stable_key(v: Views) -> DataFrame:
    return v.feed().select(
        "k",
        K.stable_key(F.col("site"), F.col("title"), F.col("currency")).alias("text_key"),
        K.salary_key(
            F.col("min_amount"), F.col("max_amount"), F.col("currency"), F.col("interval")
        ).alias("salary_key"),
        K.location_key(F.col("location"), F.col("currency")).alias("location_key"),
    )


@query
def norm_text(v: Views) -> DataFrame:
    return v.given("documents").select(
        "doc_id", sha(K.norm(F.col("text"))).alias("norm_sha"),
        F.length(K.norm(F.col("text"))).alias("norm_chars"),
    )


@query
def tokenize_titles(v: Views) -> DataFrame:
    return v.feed().select("k", F.array_sort(X.tokenize(F.col("title"))).alias("tokens"))


@query
def title_jaccard(v: Views) -> DataFrame:
    score = X.jaccard(
        X.tokenize(F.coalesce("title", F.lit(""))), X.tokenize(F.col("search_keyword"))
    )
    return v.feed().select("k", score.alias("score"))


@query
def rule_verdicts(v: Views) -> DataFrame:
    return RULES.judge_titles(v.staging(texts=False), v.labels()).select(
        "id", "title_overlap", "rule_verdict", "rule_reason"
    )


@query
def quote_keywords(v: Views) -> DataFrame:
    return v.feed().select(
        "k", X.quote_keyword(F.col("search_keyword")).alias("phrase"),
        X.quote_keyword(F.concat(F.lit(" "), F.col("job_type"), F.lit("\t"))).alias("word"),
    )


@query
def location_country(v: Views) -> DataFrame:
    return v.feed().select("k", X.country_from_location(F.col("location")).alias("country"))


@query
def slugify(v: Views) -> DataFrame:
    return v.feed().select("k", X.slugify(F.col("title")).alias("slug"))


@query
def unique_slugs(v: Views) -> DataFrame:
    return P.unique_slugs(v.given("part").select("p_partkey", "p_name"), "p_name", "p_partkey")


def _skill_text() -> Column:
    """Skill lists as JSON text, some of it broken or of another type."""
    return (
        F.when(F.col("job_type") == "contract", F.concat(F.lit('{"a":"'), "part_name", F.lit('"}')))
        .when(F.col("currency") == "JPY", F.concat(F.lit('["'), "part_name"))
        .when(F.col("currency").isNull(), F.lit(None))
        .otherwise(F.concat(F.lit('["'), "part_name", F.lit('", null, " SQL "]')))
    )


@query
def parse_json_lists(v: Views) -> DataFrame:
    return v.feed().select("k", N.parse_list(_skill_text()).alias("skills"))


@query
def coerce_lists(v: Views) -> DataFrame:
    return v.runs().select("run_id", N.coerce_list(F.col("keywords")).alias("keywords"))


@query
def clean_skills(v: Views) -> DataFrame:
    raw = F.array(
        F.upper("part_name"), F.col("part_name"), F.lit(" SQL "), F.lit("sql"), F.lit("  "),
        F.col("currency"), F.concat(F.lit("\t"), "job_type"),
    )
    return v.feed().select("k", N.clean_skills(raw).alias("skills"))


@query
def norm_codes(v: Views) -> DataFrame:
    return v.feed().select(
        "k",
        N.country_code(F.substring("currency", 1, 2)).alias("from_currency"),
        N.country_code(F.element_at(F.split("location", ", "), -1)).alias("country_code"),
        N.currency(F.concat(F.lit(" "), F.lower("currency"))).alias("currency"),
        N.currency(F.col("job_type")).alias("no_currency"),
        N.period(F.concat(F.initcap("interval"), F.lit(" "))).alias("period"),
        N.period(F.col("job_type")).alias("no_period"),
        N.strip_or_null(F.concat(F.lit(" "), F.coalesce("location", F.lit(" ")))).alias("city"),
    )


@query
def norm_work_mode(v: Views) -> DataFrame:
    raw = (
        F.when(F.col("title").contains("remote"), " Remote")
        .when(F.col("title").contains("hybrid"), "HYBRID ")
        .when(F.col("title").contains("on site"), F.element_at(
            F.array(*(F.lit(a) for a in ("onsite", "On Site", "on_site", "in-office", "In Office",
                                         "office", "WFH"))),
            (F.length("title") % 7 + 1).cast("int"),
        ))
        .otherwise(F.col("job_type"))
    )
    return v.feed().select("k", N.work_mode(raw).alias("work_mode"))


@query
def empty_subobjects(v: Views) -> DataFrame:
    raw = (
        F.when(F.col("site") == "linkedin", F.concat(F.lit(" "), F.upper(F.lit("n/a"))))
        .when(F.col("currency") == "USD", "Unknown")
        .when(F.col("currency") == "EUR", "  ")
        .otherwise(F.col("location"))
    )
    return v.feed().select("k", N.is_empty_sentinel(raw).alias("is_empty"))


@query
def run_durations(v: Views) -> DataFrame:
    return RUN.with_durations(v.runs()).select("run_id", "duration_seconds", "duration")


@query
def relevance_docs(v: Views) -> DataFrame:
    """Scorer texts with the whole description."""
    whole = X.relevance_doc(F.col("title"), F.col("description"))
    return v.feed().select("k", sha(whole).alias("doc_sha"), F.length(whole).alias("doc_chars"))


@query
def extraction_inputs(v: Views) -> DataFrame:
    text = X.extraction_input(F.col("title"), F.col("description"), F.col("search_keyword"))
    return v.feed().select("k", sha(text).alias("input_sha"))


@query
def ensemble_verdicts(v: Views) -> DataFrame:
    """The veto chain over verdicts, overlaps and amounts standing in for the scores."""
    rows = RULES.judge_titles(v.staging(texts=False))
    return rows.select(
        "id",
        N.ensemble_verdict(
            F.col("rule_verdict"), F.col("title_overlap"), F.col("min_amount") - 30000,
            F.col("max_amount") / 100000, F.col("is_remote"),
        ).alias("verdict"),
    )


@query
def clean_profiles(v: Views) -> DataFrame:
    rows = profiles(v)
    blank = rows.withColumn("name", F.lit(" ")).withColumn("sites", F.array(F.lit("none")))
    unnamed = rows.withColumn("profile_id", F.lit(None).cast("string"))
    no_words = rows.withColumn("keywords", F.array(F.lit(" ")))
    every = rows.unionByName(blank).unionByName(unnamed).unionByName(no_words)
    return P.clean_profiles(every)


@query
def parse_lines(v: Views) -> DataFrame:
    lines = X.parse_lines(F.col("text"))
    return v.given("documents").select(
        "doc_id", F.size(lines).alias("lines"),
        sha(F.array_join(lines, "\n")).alias("lines_sha"),
    )


# === relevance ===================================================================
def _scored(v: Views) -> DataFrame:
    return REL.semantic_score(v.given("embeddings"), v.query_vectors(), ("label", "query_label"))


@query
def semantic_score(v: Views) -> DataFrame:
    return _scored(v).select("vec_id", "label", "semantic_score")


@query
def semantic_filter(v: Views) -> DataFrame:
    return REL.passes_semantic(_scored(v)).select("vec_id", "label")


@query
def semantic_topk(v: Views) -> DataFrame:
    top = REL.semantic_topk(_scored(v), "label", "vec_id", 10)
    return top.select("label", "vec_id", "position")


def _docs(v: Views) -> DataFrame:
    doc = X.relevance_doc(F.col("title"), F.col("description"))
    return v.feed().select("k", "search_keyword", doc.alias("doc"))


@query
def pair_score_bm25(v: Views) -> DataFrame:
    return REL.pair_score_bm25(_docs(v), "k", "search_keyword", "doc")


@query
def fewshot_train_summary(v: Views) -> DataFrame:
    """Label counts per profile and whether the fit gave the profile a model."""
    model = REL.FewShot.train(v.labels())
    counts = REL.training_counts(v.labels())
    if model is None:
        return counts.withColumn("trained", F.lit(False))
    known = model.profiles.select("profile_id", F.lit(True).alias("trained"))
    return counts.join(known, "profile_id", "left").withColumn(
        "trained", F.coalesce("trained", F.lit(False))
    )


@query
def fewshot_scores(v: Views) -> DataFrame:
    model = REL.FewShot.train(v.labels())
    found = REL.fewshot_scores(model, v.staging(texts=False), "id")
    return found.select("id", F.round("fewshot_score", 6).alias("fewshot_score"))


@query
def fewshot_stored_scores(v: Views) -> DataFrame:
    """Classifiers published by one writer, read and applied by another."""
    folder = shared_folder(v.spark, "classifiers")
    teacher = Tables(v.spark, folder)
    teacher.publish({"profile_title_labels": v.labels()})
    FULL.train_classifiers(teacher)
    model = REL.FewShot.load(Tables(v.spark, folder))
    found = REL.fewshot_scores(model, v.staging(texts=False), "id")
    return found.select("id", F.round("fewshot_score", 6).alias("fewshot_score"))


# --- extraction ------------------------------------------------------------------
def _texts(v: Views) -> DataFrame:
    text = E.posting_text(
        F.col("title"), F.col("salary_source"), F.col("location"), F.col("description")
    )
    return v.feed().select("k", text.alias("text"))


@query
def extract_skills(v: Views) -> DataFrame:
    return E.extract_skills(_texts(v), "k", "text", v.vocabulary())


@query
def extract_salary(v: Views) -> DataFrame:
    return E.extract_salary(_texts(v), "text").drop("text")


@query
def extract_fields(v: Views) -> DataFrame:
    """The default record of every posting, read from its whole text and its place."""
    text = E.posting_text(F.col("title"), F.col("salary_source"), F.col("location"), F.col("description"))
    rows = v.feed().select("k", text.alias("text"), "location")
    found = E.extract_fields(rows, "k", "text", "location", v.vocabulary())
    lists = ("tech_skills", "soft_skills", "domain_skills")
    return found.select(*(F.array_join(c, "|").alias(c) if c in lists else c for c in found.columns))


@query
def extract_work_mode(v: Views) -> DataFrame:
    return _texts(v).select("k", E.extract_work_mode(F.col("text")).alias("work_mode"))


@query
def suggest_keywords(v: Views) -> DataFrame:
    return C.suggest_keywords(in_run(v)).select(
        "run_id", "search_keyword", "position", "term", "accepted", "rejected", "score"
    )


def _read_records(v: Views) -> Callable[[DataFrame], DataFrame]:
    """Extraction that reads the stored records of the survivors."""

    def extract(rows: DataFrame) -> DataFrame:
        mine = v.records().join(rows.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        read = REC.normalize_records(mine)
        return read.select(
            F.col("job_id").alias("id"), *CAS.ENRICHED_COLUMNS, "is_relevant",
            "relevance_confidence", "relevance_reason",
        )

    return extract


def _cascade(v: Views, **scorers) -> CAS.CascadeResult:
    """Postings of the early runs are enriched already; the others go through the cascade."""
    early = v.staging().filter("run_id <= 'run-1994'").select(F.col("id").alias("job_id"))
    todo = CAS.pending_rows(
        v.staging(), v.enriched_ids().join(early, "job_id", "left_semi"), v.judged()
    )
    return CAS.relevance_cascade(todo, _read_records(v), now(), **scorers)


@query
def relevance_cascade(v: Views) -> DataFrame:
    return _cascade(v).verdicts().select(
        "job_id", "rule_verdict", "llm_is_relevant", "llm_confidence", "ensemble_verdict",
        "biencoder_score", "crossencoder_score",
    )


@query
def relevance_cascade_learned(v: Views) -> DataFrame:
    """The cascade with title classifiers trained on the labels, which may veto."""
    model = REL.FewShot.train(v.labels())
    result = _cascade(v, fewshot=lambda rows: REL.fewshot_scores(model, rows, "id"))
    return result.verdicts().select(
        "job_id", "ensemble_verdict", F.round("setfit_score", 6).alias("setfit_score")
    )


# === transform and whole runs ====================================================
@query
def dim_location(v: Views) -> DataFrame:
    return S.star_frame(v.gated(skills=False), "dim_location")


@query
def dim_salary(v: Views) -> DataFrame:
    return S.star_frame(v.gated(skills=False), "dim_salary")


@query
def dim_skill(v: Views) -> DataFrame:
    return S.star_frame(v.gated(), "dim_skill")


@query
def job_skill_bridge(v: Views) -> DataFrame:
    return S.star_frame(v.gated(), "job_skill_bridge")


@query
def fact_job_offers(v: Views) -> DataFrame:
    return S.star_frame(v.gated(skills=False), "fact_job_offers")


def _written_inputs(v: Views, where: Column, tables: Tables) -> None:
    """Append staging, enriched and judged rows of some runs to the written tables."""
    staged = v.staging().filter(where)
    ids = staged.select(F.col("id").alias("job_id"))
    tables.append("staging_job_offers", staged)
    tables.append("int_enriched_job_info", v.enriched().join(ids, "job_id", "left_semi"))
    tables.append("judged_job_offers", v.judged().join(ids, "job_id", "left_semi"))


@query
def run_transform(v: Views) -> DataFrame:
    """Transform the early runs, then all of them: the second pass only adds."""
    tables = Tables(v.spark, shared_folder(v.spark, "transform"))
    early = F.coalesce(F.col("run_id") <= "run-1997", F.lit(False))
    for where in (early, ~early):
        _written_inputs(v, where, tables)
        TF.run_transform(v.spark, tables, only_new=True)
    return tables.read("fact_job_offers").select(
        "job_id", "profile_id", "search_keyword", "location_key", "salary_key", "work_mode"
    )


@query
def normalize_records(v: Views) -> DataFrame:
    return REC.normalize_records(v.records()).drop(
        "raw_response", "title", "search_keyword", "profile_id", "scraped_at"
    )


@query
def invalid_records(v: Views) -> DataFrame:
    return REC.invalid_records(v.records()).select("job_id", "raw_response")


@query
def land_and_judge(v: Views) -> DataFrame:
    _, verdicts = L.land_and_judge(v.staging(texts=False), _seen_before(v), v.labels(), now())
    return verdicts


def _pass(v: Views):
    return corrective_pass(v.judged(), v.staging(texts=False))


@query
def corrective_report(v: Views) -> DataFrame:
    return _pass(v).report


@query
def corrective_requests(v: Views) -> DataFrame:
    return _pass(v).requests


@query
def corrective_outcome(v: Views) -> DataFrame:
    return C.corrective_outcome(_pass(v).report, in_run(v), ["run_id"])


@query
def corrective_requests_proposed(v: Views) -> DataFrame:
    """Requests from a plugged-in model; its stand-in names the accepted titles that were not rejected too."""

    def name_titles(keyword: str, accepted: list[str], rejected: list[str]) -> list[str]:
        bad = {t.lower() for t in rejected}
        return [t.lower() for t in accepted if t.lower() not in bad]

    return corrective_pass(v.judged(), v.staging(texts=False), propose=lambda: name_titles).requests


@query
def full_run(v: Views) -> DataFrame:
    """Land everything, enrich from the stored records, transform; counts per table."""
    tables, staged = Tables(v.spark, shared_folder(v.spark, "full-run")), v.staging()
    tables.publish({"profile_title_labels": v.labels()})
    summary = FULL.full_run(v.spark, tables, "run-all", staged, _read_records(v))
    run = tables.read("pipeline_runs").select(
        F.explode(
            F.array(
                F.struct(F.lit("scraped").alias("table_name"), F.col("scraped_count").alias("n")),
                F.struct(F.lit("enriched").alias("table_name"), F.col("enriched_count").alias("n")),
            )
        ).alias("r")
    ).select("r.*")
    return summary.select("table_name", F.col("added").alias("n")).unionByName(run)


#: The site that the whole run with a corrective leg does not ask at first.
HELD_BACK = "indeed"


@query
def full_run_corrected(v: Views) -> DataFrame:
    """A whole run whose low keywords are searched again among the postings of a site held back: all verdicts.

    A request finds the held-back postings of its location whose title names the alternative; one that several
    alternatives find keeps the first. Everything belongs to one run.
    """
    tables = Tables(v.spark, shared_folder(v.spark, "full-run-corrected"))
    staged = v.staging().withColumn("run_id", F.lit("run-all"))
    tables.publish({"profile_title_labels": v.labels()})
    held_back = staged.filter(F.col("site") == HELD_BACK)

    def fetch(requests: DataFrame) -> DataFrame:
        wanted = requests.select("alternative", "search_location").distinct()
        named = held_back.select("id", "search_location", F.explode(E.phrases(X.words(F.col("title")), 2)).alias("alternative"))
        found = named.join(wanted, ["alternative", "search_location"]).groupBy("id").agg(F.min("alternative").alias("search_keyword"))
        return held_back.drop("search_keyword").join(found, "id")

    FULL.full_run(v.spark, tables, "run-all", staged.filter(F.col("site") != HELD_BACK), _read_records(v), fetch=fetch)
    return tables.read("judged_job_offers").select(
        "job_id", "search_keyword", "rule_verdict", "llm_is_relevant", "ensemble_verdict", "biencoder_score", "crossencoder_score"
    )


@query
def migrate_profiles(v: Views) -> DataFrame:
    """One legacy key/value store per customer segment, two of them without locations."""
    rows = cleaned_profiles(v)
    config = rows.select(
        F.col("profile_id").alias("owner"),
        F.explode(
            F.array(
                F.struct(F.lit("keywords").alias("key"), F.to_json("keywords").alias("value")),
                F.struct(
                    F.lit("locations").alias("key"),
                    F.when(F.col("name") > "C", F.to_json("locations")).otherwise("[]").alias(
                        "value"
                    ),
                ),
            )
        ).alias("kv"),
    ).select("owner", "kv.*")
    return P.migrate_legacy(config, ["owner"])


# === streams =====================================================================
def _event_stream(v: Views) -> DataFrame:
    return ST.table_stream(v.spark, f"{v.folder}/events.parquet", v.given("events").schema)


def _order_stream(v: Views) -> DataFrame:
    """Posting ids straight from the order stream: url copies come as neighbouring orders."""
    orders = ST.table_stream(v.spark, f"{v.folder}/orders.parquet", v.given("orders").schema)
    url = F.concat(
        F.lit("https://jobs.example.org/"), F.floor(F.col("o_orderkey") / 10).cast("string")
    )
    return orders.select(
        K.posting_id(F.col("o_orderstatus"), url).alias("id"), url.alias("job_url"),
        F.col("o_orderdate").alias("scraped_at"), F.col("o_orderkey").alias("k"),
    )


@query
def stream_land_dedup(v: Views) -> DataFrame:
    return ST.land_stream(
        _order_stream(v), shared_folder(v.spark, "landed"), shared_folder(v.spark, "progress"),
        "id", [F.col("scraped_at"), F.col("k")],
    )


@query
def stream_upsert_verdicts(v: Views) -> DataFrame:
    """Newest verdict per user from the event stream."""
    verdicts = _event_stream(v).select(
        F.col("user_id").cast("string").alias("job_id"),
        F.when(F.col("event_type") == "purchase", "accept")
        .when(F.col("event_type") == "error", "reject").otherwise("review").alias("verdict"),
        F.col("ts").alias("judged_at"), "event_id",
    )
    return ST.upsert_stream(
        verdicts, shared_folder(v.spark, "verdicts"), shared_folder(v.spark, "progress"),
        ["job_id"], [F.col("judged_at").desc(), F.col("event_id").desc()],
    )


@query
def stream_daily_counts(v: Views) -> DataFrame:
    return ST.windowed_counts(
        _event_stream(v), shared_folder(v.spark, "counts"), shared_folder(v.spark, "progress"),
        "ts", ["event_type"],
    )


@query
def fresh_rows(v: Views) -> DataFrame:
    return L.fresh_rows(v.given("events"), "ts").select("event_id", "ts", "event_type")


# === checks ======================================================================
@query
def check_unique(v: Views) -> DataFrame:
    """Key check of every star table, and of the raw feed, which does have copies."""
    out = Q.duplicate_keys(
        drop_blank_url(v.feed()), ["site", "job_url"], "feed"
    )
    for table, df in zip(S.STAR, v.star(*S.STAR), strict=True):
        out = out.unionByName(Q.duplicate_keys(df, PRIMARY_KEYS[table], table))
    return out


@query
def check_fk(v: Views) -> DataFrame:
    s = dict(zip(S.STAR, v.star(*S.STAR), strict=True))
    fact, bridge = s["fact_job_offers"], s["job_skill_bridge"]
    checks = [
        (fact, s["dim_location"], "location_key", "location_key", "fact.location"),
        (fact, s["dim_salary"], "salary_key", "salary_key", "fact.salary"),
        (bridge, fact, "job_id", "job_id", "bridge.job"),
        (bridge, s["dim_skill"], "skill_key", "skill_key", "bridge.skill"),
        (v.staging(texts=False), fact, "id", "job_id", "staging.fact"),
    ]
    out = None
    for check in checks:
        row = Q.orphans(*check)
        out = row if out is None else out.unionByName(row)
    return out


@query
def check_domain(v: Views) -> DataFrame:
    judged = v.judged().join(
        v.enriched().select("job_id", "work_mode", "country_code"), "job_id", "left"
    )
    titles = TRI.match_labels(judged, v.labels(), "left")
    return Q.domain_violations(
        titles,
        {
            "bad_rule_verdict": F.col("rule_verdict").isin(*VERDICTS),
            "bad_ensemble": F.col("ensemble_verdict").isin("accept", "reject"),
            "bad_label": F.col("user_label").isNull() | F.col("user_label").isin(*LABELS),
            "bad_work_mode": F.col("work_mode").isNull() | F.col("work_mode").isin(*WORK_MODES),
            "no_country": F.col("country_code").isNotNull(),
            "no_profile": F.col("profile_id").isNotNull(),
        },
    )


