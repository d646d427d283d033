"""Table schemas and by-name alignment of any frame to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEED = (
    "site string, job_url string, job_url_direct string, title string, company string, "
    "company_url string, location string, date_posted date, job_type string, "
    "min_amount double, max_amount double, currency string, interval string, "
    "is_remote boolean, description string, company_industry string, salary_source string"
)

TABLES = {
    "staging_job_offers": (
        "id string, scraped_at timestamp_ntz, run_id string, profile_id string, site string, "
        "search_keyword string, search_location string, job_url string, job_url_direct string, "
        "title string, company string, location_raw string, date_posted date, job_type string, "
        "salary_raw string, min_amount double, max_amount double, currency string, "
        "interval string, is_remote boolean, description string, company_url string, "
        "company_industry string, raw_payload string"
    ),
    "int_enriched_job_info": (
        "job_id string, enriched_at timestamp_ntz, llm_provider string, llm_model string, "
        "tech_skills array<string>, soft_skills array<string>, domain_skills array<string>, "
        "city string, country string, country_code string, work_mode string, "
        "salary_min double, salary_max double, salary_currency string, salary_period string, "
        "raw_response string"
    ),
    "judged_job_offers": (
        "job_id string, profile_id string, search_keyword string, job_title string, "
        "rule_verdict string, rule_reason string, llm_is_relevant boolean, "
        "llm_confidence double, llm_reason string, ensemble_verdict string, "
        "judged_at timestamp_ntz, biencoder_score double, crossencoder_score double, "
        "setfit_score double"
    ),
    "dim_location": "location_key string, city string, country string, country_code string",
    "dim_salary": (
        "salary_key string, min_amount double, max_amount double, currency string, period string"
    ),
    "dim_skill": "skill_key string, name string, skill_type string",
    "fact_job_offers": (
        "job_id string, run_id string, profile_id string, scraped_at timestamp_ntz, "
        "enriched_at timestamp_ntz, site string, search_keyword string, company string, "
        "title string, job_url string, date_posted date, work_mode string, "
        "location_key string, salary_key string"
    ),
    "job_skill_bridge": "job_id string, skill_key string",
    "mart_jobs_by_country": (
        "profile_id string, country_code string, country string, search_keyword string, "
        "job_count bigint, refreshed_at timestamp_ntz"
    ),
    "mart_skills_by_keyword": (
        "profile_id string, search_keyword string, skill_name string, skill_type string, "
        "demand_count bigint, refreshed_at timestamp_ntz"
    ),
    "mart_salary_by_keyword": (
        "profile_id string, search_keyword string, currency string, period string, "
        "p25_min double, p50_min double, p75_min double, "
        "p25_max double, p50_max double, p75_max double, "
        "observation_count bigint, refreshed_at timestamp_ntz"
    ),
    "mart_work_mode_distribution": (
        "profile_id string, search_keyword string, work_mode string, job_count bigint, "
        "refreshed_at timestamp_ntz"
    ),
    "pipeline_runs": (
        "run_id string, profile_id string, started_at timestamp_ntz, finished_at timestamp_ntz, "
        "status string, keywords array<string>, locations array<string>, sites array<string>, "
        "scraped_count bigint, enriched_count bigint, error_message string"
    ),
    "user_search_config": "key string, value string, updated_at timestamp_ntz",
    "user_search_profiles": (
        "profile_id string, name string, description string, keywords array<string>, "
        "locations array<string>, sites array<string>, created_at timestamp_ntz, "
        "updated_at timestamp_ntz"
    ),
    "profile_title_labels": (
        "profile_id string, title_norm string, label string, note string, count_seen int, "
        "created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "fewshot_profiles": "profile_id string, n_accept bigint, n_reject bigint, bias double",
    "fewshot_weights": "profile_id string, word string, weight double",
}

PRIMARY_KEYS = {
    "staging_job_offers": ["id"],
    "int_enriched_job_info": ["job_id"],
    "judged_job_offers": ["job_id"],
    "dim_location": ["location_key"],
    "dim_salary": ["salary_key"],
    "dim_skill": ["skill_key"],
    "fact_job_offers": ["job_id"],
    "job_skill_bridge": ["job_id", "skill_key"],
    "mart_jobs_by_country": ["profile_id", "country_code", "search_keyword"],
    "mart_skills_by_keyword": ["profile_id", "search_keyword", "skill_type", "skill_name"],
    "mart_salary_by_keyword": ["profile_id", "search_keyword", "currency", "period"],
    "mart_work_mode_distribution": ["profile_id", "search_keyword", "work_mode"],
    "pipeline_runs": ["run_id"],
    "user_search_config": ["key"],
    "user_search_profiles": ["profile_id"],
    "profile_title_labels": ["profile_id", "title_norm"],
    "fewshot_profiles": ["profile_id"],
    "fewshot_weights": ["profile_id", "word"],
}

MARTS = tuple(name for name in TABLES if name.startswith("mart_"))


_TYPES = {
    "string": T.StringType(),
    "date": T.DateType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from ``name type, name type`` text, without needing a session."""
    pairs = (column.split(" ") for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FEED_SCHEMA = struct(FEED)


def schema_of(table: str) -> T.StructType:
    """Schema of an allow-listed table; any other name is an error."""
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    return struct(TABLES[table])


def align(
    df: DataFrame, schema: T.StructType, defaults: dict | None = None, lenient: bool = False
) -> DataFrame:
    """Match columns by name: absent ones become NULL (or their default), extra ones go.

    With ``lenient`` a value that cannot be read as its type becomes NULL too.
    """
    defaults = defaults or {}
    present = set(df.columns)

    def column(field: T.StructField):
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        if field.name not in present:
            return default.alias(field.name)
        source = F.col(f"`{field.name}`")
        value = source.try_cast(field.dataType) if lenient else source.cast(field.dataType)
        filled = F.coalesce(value, default) if field.name in defaults else value
        return filled.alias(field.name)

    return df.select([column(field) for field in schema])


def align_table(df: DataFrame, table: str, defaults: dict | None = None) -> DataFrame:
    return align(df, schema_of(table), defaults)
