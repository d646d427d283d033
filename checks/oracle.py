"""The same results in the SQL of the checking engine, for a value-by-value comparison.

``ORACLE[name]`` is one statement over the given tables. The posting-shaped views are
shared with the Spark side (see ``rolesift.sources.views``); everything a job
computes is written here a second time, in SQL alone.
"""

from __future__ import annotations

import re

from rolesift import constants as K
from rolesift.sources import views as V

ORACLE: dict[str, str] = {}


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


def _view(text: str) -> str:
    """A shared view text with its inputs under their own names."""
    return text.format_map(_Names())


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


WS = K.WHITESPACE_CLASS
PUNCT = K.ASCII_PUNCTUATION.replace("'", "''")


# --- scalar building blocks -----------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return f"lower({strip(f'coalesce({x}, $$$$)')})"


def key(*parts: str) -> str:
    slots = " || '|' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"substr(sha256({slots}), 1, 24)"


def amount(x: str) -> str:
    return f"cast(cast({x} as decimal(30,6)) as varchar)"


def loc_key(city: str, cc: str) -> str:
    return key(norm(city), norm(cc))


def sal_key(lo: str, hi: str, cur: str, per: str) -> str:
    return key(amount(lo), amount(hi), norm(cur), norm(per))


def words(x: str) -> str:
    """All words of a text in order."""
    return (
        f"list_filter(string_split_regex(translate(lower({x}), '{PUNCT}', ''), '{WS}+'), "
        "lambda w: w <> '')"
    )


def tokens(x: str) -> str:
    return f"list_distinct(list_filter({words(x)}, lambda w: w not in ({_quoted(K.STOPWORDS)})))"


def jaccard(a: str, b: str) -> str:
    return (
        f"case when len(list_distinct(list_concat({a}, {b}))) = 0 then 0.0 else "
        f"len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end"
    )


def ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def r6(x: str) -> str:
    return f"round(cast({x} as double), 6)"


def slug(x: str) -> str:
    dashed = f"regexp_replace({norm(x)}, '[^a-z0-9]+', '-', 'g')"
    return f"nullif(regexp_replace({dashed}, '^-+|-+$', '', 'g'), '')"


def _score(title: str, keyword: str) -> str:
    comparable = f"coalesce({title} <> '', false) and len({tokens(keyword)}) > 0"
    return f"case when {comparable} then {jaccard(tokens(title), tokens(keyword))} end"


def _verdict(score: str, blocked: str) -> str:
    return (
        f"case when {blocked} then 'reject' when {score} is null then 'review' "
        f"when {score} >= 0.5 then 'accept' when {score} >= 0.15 then 'review' else 'reject' end"
    )


def _reason(score: str, blocked: str) -> str:
    return (
        f"case when {blocked} then 'user_blocked' "
        f"else printf('title_overlap=%.2f', coalesce({score}, 0.0)) end"
    )


# --- views ------------------------------------------------------------------------
CTES = {
    "order_facts": ([], _view(V.ORDER_FACTS)),
    "places": ([], _view(V.PLACES)),
    "postings": (["order_facts", "places"], _view(V.POSTINGS)),
    "feed": (
        ["postings"],
        """select p.*, salary_interval as "interval", d.text as description,
                  case when k % 3 <> 0 then job_url || '/apply' end as job_url_direct,
                  contains(title, 'remote') as is_remote
           from postings p left join documents d on d.doc_id = k""",
    ),
    "staging": (
        ["feed"],
        f"""select {key("site", "job_url")} as id, scraped_at, run_id, profile_id, site,
                   search_keyword, search_location, job_url, job_url_direct, title, company,
                   location as location_raw, date_posted, job_type, salary_source as salary_raw,
                   min_amount, max_amount, currency, "interval", is_remote, description,
                   company_url, company_industry, k, part_name, salary_interval
            from feed
            where {strip("job_url")} <> ''
            qualify row_number() over (partition by site, job_url order by scraped_at, k) = 1""",
    ),
    "order_skills": ([], _view(V.ORDER_SKILLS)),
    "enriched": (["staging", "order_skills"], _view(V.ENRICHED)),
    "judged_base": (["staging"], _view(V.JUDGED)),
    "judged": (
        ["judged_base"],
        f"""select * exclude (s), {_verdict("s", "false")} as rule_verdict,
                   {_reason("s", "false")} as rule_reason
            from (select *, {_score("job_title", "search_keyword")} as s from judged_base) t""",
    ),
    "labels_": (["staging"], _view(V.LABELS)),
    "runs": ([], _view(V.RUNS)),
    "records": (["staging"], _view(V.RECORDS).replace("{{", "{").replace("}}", "}")),
    "profiles": (["postings"], _view(V.PROFILES)),
    "query_vectors": ([], _view(V.QUERY_VECTORS)),
    "gated": (
        ["staging", "enriched", "judged"],
        """select s.id as job_id, s.run_id, s.profile_id, s.scraped_at, s.site, s.search_keyword,
                  s.company, s.title, s.job_url, s.date_posted, e.* exclude (job_id)
           from staging s join enriched e on s.id = e.job_id
           left join judged j on s.id = j.job_id
           where j.ensemble_verdict = 'accept' or j.ensemble_verdict is null""",
    ),
    "dim_location": (
        ["gated"],
        f"""select location_key,
                   case when {norm("city")} <> '' then city end as city,
                   case when {norm("country")} <> '' then country end as country,
                   case when {norm("country_code")} <> '' then country_code end as country_code
            from (select *, {loc_key("city", "country_code")} as location_key from gated) t
            qualify row_number() over (partition by location_key
                    order by scraped_at nulls last, city nulls last, country nulls last,
                             country_code nulls last) = 1""",
    ),
    "dim_salary": (
        ["gated"],
        f"""select salary_key, salary_min as min_amount, salary_max as max_amount,
                   case when {norm("salary_currency")} <> '' then salary_currency end as currency,
                   case when {norm("salary_period")} <> '' then salary_period end as period
            from (select *, {sal_key("salary_min", "salary_max", "salary_currency", "salary_period")}
                         as salary_key from gated) t
            qualify row_number() over (partition by salary_key
                    order by scraped_at, salary_currency, salary_period) = 1""",
    ),
    "skill_rows": (
        ["gated"],
        f"""select distinct job_id, {norm("name")} as name, skill_type from (
              select job_id, unnest(tech_skills) as name, 'tech' as skill_type from gated
              union all select job_id, unnest(soft_skills), 'soft' from gated
              union all select job_id, unnest(domain_skills), 'domain' from gated) t
            where {norm("name")} <> ''""",
    ),
    "dim_skill": (
        ["skill_rows"],
        f"select distinct {key('name', 'skill_type')} as skill_key, name, skill_type from skill_rows",
    ),
    "bridge": (
        ["skill_rows"],
        f"select job_id, {key('name', 'skill_type')} as skill_key from skill_rows",
    ),
    "fact": (
        ["gated"],
        f"""select job_id, run_id, profile_id, scraped_at, enriched_at, site, search_keyword,
                   company, title, job_url, date_posted,
                   case when {norm("work_mode")} <> '' then work_mode end as work_mode,
                   {loc_key("city", "country_code")} as location_key,
                   {sal_key("salary_min", "salary_max", "salary_currency", "salary_period")}
                        as salary_key
            from gated""",
    ),
    "m_country": (
        ["fact", "dim_location"],
        """select coalesce(f.profile_id, '') as profile_id,
                  coalesce(l.country_code, '') as country_code,
                  max(l.country) as country, f.search_keyword, count(*) as job_count
           from fact f left join dim_location l using (location_key)
           group by all""",
    ),
    "m_skills": (
        ["fact", "bridge", "dim_skill"],
        """select coalesce(f.profile_id, '') as profile_id, f.search_keyword,
                  s.name as skill_name, s.skill_type, count(*) as demand_count
           from fact f join bridge b using (job_id) join dim_skill s using (skill_key)
           group by all""",
    ),
    "m_salary": (
        ["fact", "dim_salary"],
        """select coalesce(f.profile_id, '') as profile_id, f.search_keyword,
                  coalesce(s.currency, '') as currency, coalesce(s.period, '') as period,
                  percentile_cont(0.25) within group (order by s.min_amount) as p25_min,
                  percentile_cont(0.50) within group (order by s.min_amount) as p50_min,
                  percentile_cont(0.75) within group (order by s.min_amount) as p75_min,
                  percentile_cont(0.25) within group (order by s.max_amount) as p25_max,
                  percentile_cont(0.50) within group (order by s.max_amount) as p50_max,
                  percentile_cont(0.75) within group (order by s.max_amount) as p75_max,
                  count(*) as observation_count
           from fact f join dim_salary s using (salary_key)
           where s.min_amount is not null or s.max_amount is not null
           group by 1, 2, 3, 4""",
    ),
    "m_mode": (
        ["fact"],
        """select coalesce(profile_id, '') as profile_id, search_keyword,
                  coalesce(work_mode, '') as work_mode, count(*) as job_count
           from fact group by all""",
    ),
    "in_run": (
        ["judged", "staging"],
        "select j.*, s.run_id from judged j join staging s on s.id = j.job_id",
    ),
    "clean_profile": (
        ["profiles"],
        """select profile_id, name, keywords,
                  coalesce(locations, cast([] as varchar[])) as locations,
                  ['linkedin', 'indeed'] as sites from profiles""",
    ),
    "matrix": (
        ["clean_profile"],
        """select profile_id, keyword, location, unnest(sites) as site from (
             select profile_id, keyword,
                    unnest(case when len(locations) = 0 then [null] else locations end) as location,
                    sites
             from (select profile_id, unnest(keywords) as keyword, locations, sites
                   from clean_profile) a) b""",
    ),
    "cand": (
        ["judged", "staging", "labels_"],
        """select lower(trim(j.job_title)) as title_norm, j.job_title as display_title,
                  min(s.company) as company_sample, count(*) as "count",
                  min(j.rule_verdict) as rule_verdict,
                  min(j.ensemble_verdict) as ensemble_verdict, min(l.label) as user_label
           from judged j join staging s on s.id = j.job_id
           left join labels_ l on l.profile_id = j.profile_id
                and l.title_norm = lower(trim(j.job_title))
           where j.profile_id = 'machinery'
           group by lower(trim(j.job_title)), j.job_title""",
    ),
    "cand_all": (
        ["cand"],
        'select * from cand order by "count" desc, title_norm, display_title limit 200',
    ),
    "cand_open": (
        ["cand"],
        """select * from cand where user_label is null or user_label = 'unsure'
           order by "count" desc, title_norm, display_title limit 200""",
    ),
    "label_edits": (
        ["judged"],
        """select distinct profile_id, lower(trim(job_title)) as title_norm,
                  case when contains(lower(trim(job_title)), 'remote') then 'maybe'
                       else 'accept' end as label
           from judged
           where profile_id is not null and starts_with(lower(trim(job_title)), 'red')""",
    ),
    "rates": (
        ["in_run"],
        """select run_id, search_keyword, count(*) as total,
                  cast(sum(case when ensemble_verdict = 'accept' then 1 else 0 end) as bigint)
                      as accepted
           from in_run where search_keyword is not null group by all""",
    ),
}


def sql(name: str, body: str, *needs: str) -> None:
    """Register a statement with the views it needs, inputs first."""
    order: list[str] = []

    def visit(view: str) -> None:
        for parent in CTES[view][0]:
            visit(parent)
        if view not in order:
            order.append(view)

    for view in needs:
        visit(view)
    head = ",\n".join(f"{view} as ({CTES[view][1]})" for view in order)
    ORACLE[name] = (f"with {head}\n" if order else "") + body


# --- sources and sinks ----------------------------------------------------------
sql(
    "src_postings",
    """select site, job_url, title, company, location,
              cast(date_posted as varchar) as date_posted, job_type,
              round(min_amount, 6) as min_amount, round(max_amount, 6) as max_amount, currency,
              "interval", is_remote, salary_source,
              case when site <> 'glassdoor' then sha256(description) end as description_sha
       from feed""",
    "feed",
)
sql(
    "stage_postings",
    f"""select id, {ts("scraped_at")} as scraped_at, run_id, profile_id, site, search_keyword,
               search_location, job_url, job_url_direct, title, company, location_raw,
               cast(date_posted as varchar) as date_posted, job_type, salary_raw,
               min_amount, max_amount, currency, "interval", is_remote, company_url,
               company_industry, sha256(description) as description_sha
        from staging""",
    "staging",
)
sql(
    "raw_payload_json",
    """select k, site, job_url, title, cast(date_posted as varchar) as date_posted, min_amount,
              salary_source, cast(is_remote as varchar) as is_remote,
              title is null as title_null_kept, false as has_description
       from feed""",
    "feed",
)
sql(
    "schema_align",
    f"""select job_id, {ts("enriched_at")} as enriched_at, 'unknown' as llm_provider, llm_model,
               {joined("tech_skills")} as tech_skills, {joined("soft_skills")} as soft_skills,
               cast(null as varchar) as domain_skills, city, country, country_code, work_mode,
               salary_min, salary_max, salary_currency, salary_period
        from enriched""",
    "enriched",
)
sql(
    "upsert_ignore_dim",
    """select a.location_key, a.city,
              case when exists (select 1 from gated g where run_id <= 'run-1997'
                   and """
    + loc_key("g.city", "g.country_code")
    + """ = a.location_key) then 'kept' else a.country end as country, a.country_code
       from dim_location a""",
    "dim_location",
    "gated",
)
sql(
    "upsert_ignore_fact",
    """select job_id, run_id, case when run_id <= 'run-1997' then 'kept' else title end as title,
              location_key, salary_key from fact""",
    "fact",
)
sql(
    "upsert_update_verdicts",
    f"""select coalesce(j.job_id, n.id) as job_id,
               case when j.job_id is null then 'new title' else j.job_title end as job_title,
               coalesce(j.rule_verdict, 'accept') as rule_verdict,
               case when n.id is not null then n.search_keyword = 'hot plate' end
                    as llm_is_relevant,
               case when n.id is not null then 0.75::double end as llm_confidence,
               case when n.id is null then j.ensemble_verdict
                    when n.search_keyword = 'hot plate' then 'accept' else 'reject' end
                    as ensemble_verdict,
               case when n.id is null then {ts("j.judged_at")} else '2030-01-01 00:00:00' end
                    as judged_at
        from judged j
        full join (select * from staging where job_type in ('fulltime', 'contract')) n
             on j.job_id = n.id""",
    "judged",
)
sql(
    "upsert_label_counts",
    f"""select coalesce(l.profile_id, e.profile_id) as profile_id,
               coalesce(l.title_norm, e.title_norm) as title_norm,
               coalesce(e.label, l.label) as label,
               case when e.label is not null then 'edited' end as note,
               cast(case when e.label is null then l.count_seen
                    when l.label is null then 7 else l.count_seen + 1 end as bigint) as count_seen,
               case when l.created_at is null then '2030-01-01 00:00:00'
                    else {ts("l.created_at")} end as created_at,
               case when e.label is not null then '2030-01-01 00:00:00'
                    else {ts("l.updated_at")} end as updated_at
        from labels_ l
        full join (select * from label_edits where label in ('accept', 'reject', 'unsure')) e
             on l.profile_id = e.profile_id and l.title_norm = e.title_norm""",
    "labels_",
    "label_edits",
)
sql(
    "delete_labels",
    """select profile_id, title_norm, label, cast(count_seen as bigint) as count_seen
       from labels_ l where not exists (select 1 from label_edits e
            where e.profile_id = l.profile_id and e.title_norm = l.title_norm)""",
    "labels_",
    "label_edits",
)
sql(
    "replace_profiles",
    f"""select profile_id, name, {joined("keywords")} as keywords,
               case when name < 'C' then 'Spain' else {joined("locations")} end as locations
        from clean_profile""",
    "clean_profile",
)
sql("mart_scan_profile", "select * from m_country where profile_id = 'building'", "m_country")
sql(
    "run_registry",
    f"""select run_id, profile_id, {ts("started_at")} as started_at,
               {ts("finished_at")} as finished_at,
               case when finished_at is null then 'running' else status end as status,
               case when finished_at is null then 0 else coalesce(scraped_count, 0) end
                    as scraped_count,
               cast(case when finished_at is null then 0 else enriched_count end as bigint)
                    as enriched_count,
               case when finished_at is not null then error_message end as error_message
        from runs""",
    "runs",
)

# --- projections, filters --------------------------------------------------------
_PENDING = """select s.id, s.title, s.search_keyword, s.profile_id, j.rule_verdict
    from staging s left join enriched e on e.job_id = s.id left join judged j on j.job_id = s.id
    where e.job_id is null and (j.rule_verdict is null or j.rule_verdict <> 'reject')"""
sql("pending_rows", _PENDING, "staging", "enriched", "judged")
sql(
    "pending_rows_limited",
    _PENDING + " and s.run_id = 'run-1998' order by s.scraped_at, s.id limit 100",
    "staging", "enriched", "judged",
)
sql(
    "verdict_gated",
    f"""select job_id, run_id, profile_id, search_keyword, title,
               {joined("tech_skills")} as tech_skills, city, country_code, work_mode, salary_min,
               salary_max, {ts("enriched_at")} as enriched_at
        from gated""",
    "gated",
)


def _wide(where: str, limit: int) -> str:
    return f"""select f.job_id, f.run_id, f.profile_id, f.site, f.search_keyword, f.company,
        f.title, f.job_url, cast(f.date_posted as varchar) as date_posted, f.work_mode, l.city,
        l.country, l.country_code, s.min_amount as salary_min, s.max_amount as salary_max,
        s.currency as salary_currency, s.period as salary_period,
        {joined("e.tech_skills")} as tech_skills, {joined("e.soft_skills")} as soft_skills,
        {joined("e.domain_skills")} as domain_skills, {ts("f.scraped_at")} as scraped_at,
        {ts("f.enriched_at")} as enriched_at
      from fact f left join dim_location l on l.location_key = f.location_key
      left join dim_salary s on s.salary_key = f.salary_key
      left join enriched e on e.job_id = f.job_id
      where {where}
      order by f.date_posted desc nulls last, f.scraped_at desc, f.job_id limit {limit}"""


_WIDE = ("fact", "dim_location", "dim_salary", "enriched")
sql("fact_with_dims", _wide("true", 500), *_WIDE)
sql("fact_with_dims_by_keyword", _wide("f.search_keyword = 'hot plate'", 50), *_WIDE)
sql("fact_with_dims_by_profile", _wide("f.profile_id = 'building'", 5000), *_WIDE)
sql(
    "filter_multi_isin",
    """select job_id, search_keyword, country, work_mode
       from fact left join dim_location using (location_key)
       where search_keyword in ('hot plate', 'blue ring') and work_mode in ('remote', 'hybrid')""",
    "fact", "dim_location",
)
sql("filter_mart_keywords", "select * from m_mode where search_keyword = 'hot plate'", "m_mode")
sql(
    "run_history_filter",
    f"""select run_id, profile_id, status, {ts("started_at")} as started_at from runs
        where status in ('success', 'failed') and profile_id = 'p2'
          and cast(started_at as date) between date '2024-01-05' and date '2024-01-20'""",
    "runs",
)
sql(
    "drop_blank_url",
    f"select k, site, job_url from feed where {strip('job_url')} <> ''",
    "feed",
)
_SECONDS = "date_diff('microsecond', started_at, finished_at) / 1e6"
_TENTHS = f"cast(floor({_SECONDS} * 10 + 0.5) as bigint)"
_WHOLE = f"cast(floor({_SECONDS}) as bigint)"
_DURATION = f"""case when finished_at is null then '-'
    when {_SECONDS} < 60 then ({_TENTHS} // 10) || '.' || ({_TENTHS} % 10) || 's'
    else ({_WHOLE} // 60) || 'm ' || ({_WHOLE} % 60) || 's' end"""
sql(
    "run_history_view",
    f"""select substr(run_id, 1, 8) as run_id,
               case when profile_id is null then '-' when profile_id < 'p4'
                    then 'Profile ' || profile_id else profile_id end as profile,
               {ts("started_at")} as started_at, {_DURATION} as duration, status,
               case when keywords is null or trim(keywords) = '' then ''
                    when starts_with(keywords, '[')
                    then array_to_string(json_extract_string(keywords, '$[*]'), ', ')
                    else keywords end as keywords,
               scraped_count as scraped, enriched_count as enriched, error_message as error
        from runs""",
    "runs",
)
sql(
    "salary_bands_long",
    """select * from (
         select profile_id, search_keyword || ' (' || currency || '/' || period || ')' as label,
                'min' as band, p25_min as p25, p50_min as p50, p75_min as p75 from m_salary
         union all
         select profile_id, search_keyword || ' (' || currency || '/' || period || ')',
                'max', p25_max, p50_max, p75_max from m_salary) t
       where p25 is not null and p75 is not null""",
    "m_salary",
)
sql(
    "triage_editor_view",
    """select display_title, company_sample, "count", rule_verdict, ensemble_verdict,
              coalesce(user_label, '') as label from cand_all""",
    "cand_all",
)
sql(
    "bulk_label_review",
    """select display_title, company_sample, "count", rule_verdict, ensemble_verdict,
              case when rule_verdict = 'review' then 'accept' else coalesce(user_label, '') end
                   as label from cand_open""",
    "cand_open",
)
sql(
    "changed_labels",
    """select lower(trim(display_title)) as title_norm, display_title, 'reject' as label
       from cand_all where rule_verdict = 'review' and coalesce(user_label, '') <> 'reject'""",
    "cand_all",
)

# --- joins -------------------------------------------------------------------------
sql(
    "anti_unenriched",
    """select s.id, s.run_id, s.title from staging s left join enriched e on e.job_id = s.id
       where e.job_id is null""",
    "staging", "enriched",
)
_SEEN = "select id from staging where run_id <= 'run-1997'"
sql("semi_existing_ids", f"select id from staging where id in ({_SEEN})", "staging")
sql(
    "anti_new_ids",
    f"select id, site, job_url from staging where id not in ({_SEEN})",
    "staging",
)
sql(
    "label_match_join",
    """select j.job_id, j.profile_id, l.title_norm, j.ensemble_verdict, l.label as user_label
       from judged j join labels_ l on j.profile_id = l.profile_id
            and lower(trim(j.job_title)) = l.title_norm""",
    "judged", "labels_",
)
_CHANGED = """coalesce(l.label in ('accept', 'reject') and j.ensemble_verdict <> l.label, false)"""
sql(
    "apply_labels",
    f"""select j.job_id,
               case when {_CHANGED} then l.label else j.ensemble_verdict end as ensemble_verdict,
               case when {_CHANGED} then '2030-01-01 00:00:00' else {ts("j.judged_at")} end
                    as judged_at,
               {_CHANGED} as changed
        from judged j left join labels_ l on j.profile_id = l.profile_id
             and lower(trim(j.job_title)) = l.title_norm""",
    "judged", "labels_",
)
sql(
    "label_write_back",
    f"""select j.job_id,
               case when {_CHANGED} then l.label else j.ensemble_verdict end as ensemble_verdict,
               case when {_CHANGED} then '2030-01-01 00:00:00' else {ts("j.judged_at")} end as judged_at
        from judged j left join labels_ l on j.profile_id = l.profile_id
             and lower(trim(j.job_title)) = l.title_norm""",
    "judged", "labels_",
)
sql(
    "label_match_count",
    """select j.profile_id, count(*) as matched_rows,
              cast(sum(case when l.label <> 'unsure' then 1 else 0 end) as bigint) as decided_rows
       from judged j join labels_ l on j.profile_id = l.profile_id
            and lower(trim(j.job_title)) = l.title_norm
       group by j.profile_id""",
    "judged", "labels_",
)
sql(
    "count_accepted_for_keywords",
    """select run_id, count(*) as accepted from in_run
       where ensemble_verdict = 'accept' and search_keyword in ('hot plate', 'small gear')
       group by run_id""",
    "in_run",
)
sql("request_matrix", "select * from matrix", "matrix")
_BLOCKED = f"""exists (select 1 from labels_ l where l.label = 'reject'
    and l.profile_id = s.profile_id and l.title_norm = {norm("s.title")}
    and {norm("s.title")} <> '')"""
sql(
    "blocked_titles",
    f"select id, profile_id, title, {_BLOCKED} as blocked from staging s",
    "staging", "labels_",
)
sql(
    "country_totals",
    """select country_code, country, cast(sum(job_count) as bigint) as job_count
       from m_country group by all""",
    "m_country",
)
sql(
    "country_iso3",
    """select i.iso3, country, cast(sum(job_count) as bigint) as job_count
       from m_country join (values ('DE', 'DEU'), ('US', 'USA'), ('HK', 'HKG'), ('AE', 'ARE'))
            i(iso2, iso3) on country_code = i.iso2
       group by all""",
    "m_country",
)

# --- aggregations --------------------------------------------------------------------
sql("mart_jobs_by_country", "select * from m_country", "m_country")
sql("mart_skills_by_keyword", "select * from m_skills", "m_skills")
sql("mart_salary_by_keyword", "select * from m_salary", "m_salary")
sql("mart_work_mode_distribution", "select * from m_mode", "m_mode")
sql(
    "acceptance_rates",
    f"select *, {r6('accepted::double / total')} as acceptance_rate from rates",
    "rates",
)
sql(
    "acceptance_rates_profile",
    f"""select run_id, search_keyword, count(*) as total,
               count(*) filter (ensemble_verdict = 'accept') as accepted,
               {r6("count(*) filter (ensemble_verdict = 'accept') / count(*)::double")}
                    as acceptance_rate
        from in_run where profile_id = 'building' group by all""",
    "in_run",
)
sql("triage_candidates", "select * from cand_open", "cand_open")
sql("triage_candidates_all", "select * from cand_all", "cand_all")
sql(
    "triage_metrics",
    """select profile_id, count(distinct lower(trim(job_title))) as total_titles,
              count(distinct case when ensemble_verdict = 'accept' then lower(trim(job_title)) end)
                   as accepted,
              count(distinct case when ensemble_verdict = 'reject' then lower(trim(job_title)) end)
                   as rejected
       from judged where profile_id is not null group by profile_id""",
    "judged",
)
sql(
    "triage_pending",
    """select j.profile_id, count(distinct lower(trim(j.job_title))) as pending
       from judged j left join labels_ l on l.profile_id = j.profile_id
            and l.title_norm = lower(trim(j.job_title))
       where j.ensemble_verdict = 'review' and l.label is null and j.profile_id is not null
       group by j.profile_id""",
    "judged", "labels_",
)
sql(
    "count_jobs",
    """select 'all' as scope, count(*) as jobs from fact
       union all select 'building', count(*) from fact where profile_id = 'building'""",
    "fact",
)
sql(
    "run_summary",
    f"""select count(*) as total_runs,
               {r6("count(*) filter (status = 'success') * 100.0 / count(*)")} as success_pct,
               {r6(f"avg({_SECONDS})")} as avg_duration,
               cast(sum(coalesce(scraped_count, 0)) as bigint) as total_scraped
        from runs""",
    "runs",
)
sql(
    "label_summary",
    """select profile_id, count(*) filter (label = 'accept') as accept,
              count(*) filter (label = 'reject') as reject,
              count(*) filter (label = 'unsure') as unsure, count(*) as total
       from labels_ group by profile_id""",
    "labels_",
)
sql(
    "trainable_profiles",
    """select profile_id, count(*) filter (label = 'accept') as n_accept,
              count(*) filter (label = 'reject') as n_reject
       from labels_ where title_norm <> '' group by profile_id
       having n_accept >= 4 and n_reject >= 4""",
    "labels_",
)
sql(
    "load_counts_by_site",
    """select m.profile_id, m.keyword, m.location, m.site, count(s.id) as rows_loaded
       from matrix m left join staging s on s.profile_id = m.profile_id
            and s.search_keyword = m.keyword
            and s.search_location is not distinct from m.location and s.site = m.site
       group by all""",
    "matrix", "staging",
)
sql(
    "load_counts_with_errors",
    """select m.profile_id, m.keyword, m.location, m.site,
              count(s.id) filter (m.site <> 'indeed') as rows_loaded,
              case when m.site = 'indeed' then 'PATH_NOT_FOUND' end as error
       from matrix m left join staging s on s.profile_id = m.profile_id
            and s.search_keyword = m.keyword
            and s.search_location is not distinct from m.location and s.site = m.site
       group by all""",
    "matrix", "staging",
)
sql(
    "transform_summary",
    """select 'dim_location' as table_name, count(*) as candidates from dim_location
       union all select 'dim_salary', count(*) from dim_salary
       union all select 'dim_skill', count(*) from dim_skill
       union all select 'fact_job_offers', count(*) from fact
       union all select 'job_skill_bridge', count(*) from bridge""",
    "dim_location", "dim_salary", "dim_skill", "fact", "bridge",
)
sql("distinct_locations", "select distinct run_id, search_location from staging", "staging")
sql(
    "filter_options",
    """select distinct 'keyword' as kind, search_keyword as "value" from fact
       union all select distinct 'country', country from dim_location where country is not null""",
    "fact", "dim_location",
)
sql(
    "planned_workload",
    """select profile_id, cast(len(keywords) * greatest(len(locations), 1) as bigint) as requests,
              cast(len(keywords) * greatest(len(locations), 1) * 2 as bigint) as site_calls
       from clean_profile""",
    "clean_profile",
)

# --- windows, order --------------------------------------------------------------------
sql("dedup_first", f"select id, k, {ts('scraped_at')} as scraped_at from staging", "staging")
sql(
    "top_skills_per_keyword",
    """select * from (
         select *, row_number() over (partition by profile_id, search_keyword, skill_type
                order by demand_count desc, skill_name) as position from m_skills) t
       where position <= case skill_type when 'tech' then 20 when 'soft' then 10 else 15 end""",
    "m_skills",
)
sql(
    "sample_titles",
    """select run_id, search_keyword, ensemble_verdict, position, job_title from (
         select *, row_number() over (partition by run_id, search_keyword, ensemble_verdict
                order by judged_at desc, job_id) as position
         from in_run where job_title is not null) t
       where position <= 5""",
    "in_run",
)
_RUN = f"""run_id, {ts("started_at")} as started_at, {ts("finished_at")} as finished_at, status,
    profile_id"""
sql(
    "latest_run",
    f"""(select {_RUN}, 'all' as scope from runs r order by r.started_at desc, run_id desc limit 1)
        union all
        (select {_RUN}, 'p3' from runs r where profile_id = 'p3'
         order by r.started_at desc, run_id desc limit 1)""",
    "runs",
)
sql(
    "latest_run_per_profile",
    f"""select {_RUN} from runs r qualify row_number() over (partition by profile_id
        order by r.started_at desc, run_id desc) = 1""",
    "runs",
)
sql(
    "list_labels",
    f"""select profile_id, title_norm, label, note, cast(count_seen as bigint) as count_seen,
               {ts("updated_at")} as updated_at from labels_""",
    "labels_",
)
sql(
    "recent_runs",
    f"""select run_id, profile_id, {ts("started_at")} as started_at, status, scraped_count
        from runs r order by r.started_at desc, run_id desc limit 100""",
    "runs",
)
sql(
    "list_profiles",
    f"""select profile_id, name, {joined("keywords")} || '|  ' as keywords,
               {ts("updated_at")} as updated_at from profiles""",
    "profiles",
)

# --- scalar functions ------------------------------------------------------------------
sql(
    "stable_key",
    f"""select k, {key("site", "title", "currency")} as text_key,
               {sal_key("min_amount", "max_amount", "currency", '"interval"')} as salary_key,
               {loc_key("location", "currency")} as location_key
        from feed""",
    "feed",
)
sql(
    "norm_text",
    f"""select doc_id, sha256({norm("text")}) as norm_sha,
               cast(length({norm("text")}) as bigint) as norm_chars from documents""",
)
_SORTED = f"list_sort({tokens('title')})"
sql("tokenize_titles", f"select k, {joined(_SORTED)} as tokens from feed", "feed")
_T, _Q = tokens("coalesce(title, '')"), tokens("search_keyword")
sql("title_jaccard", f"select k, {r6(jaccard(_T, _Q))} as score from feed", "feed")
sql(
    "rule_verdicts",
    f"""select id, {r6("score")} as title_overlap, {_verdict("score", "blocked")} as rule_verdict,
               {_reason("score", "blocked")} as rule_reason
        from (select id, {_score("title", "search_keyword")} as score, {_BLOCKED} as blocked
              from staging s) t""",
    "staging", "labels_",
)
sql(
    "quote_keywords",
    """select k, '"' || search_keyword || '"' as phrase, job_type as word from feed""",
    "feed",
)
sql(
    "location_country",
    """select k, case split_part(location, ', ', 2) when 'USA' then 'usa'
              when 'Hong Kong' then 'hongkong' when 'Germany' then 'germany'
              when 'United Arab Emirates' then 'unitedarabemirates' end as country
       from feed""",
    "feed",
)
sql("slugify", f"select k, {slug('title')} as slug from feed", "feed")
sql(
    "unique_slugs",
    f"""select p_partkey, p_name,
               case when h = min(h) over (partition by s) then s
                    when h = min(h) over (partition by s, substr(h, 1, 4))
                    then s || '-' || substr(h, 1, 4) else s || '-' || h end as slug
        from (select p_partkey, p_name, {slug("p_name")} as s, {key("p_partkey")} as h
              from part) t""",
)
sql(
    "parse_json_lists",
    """select k, case when job_type = 'contract' or currency = 'JPY' or currency is null
                           or part_name is null then '' else part_name || '| SQL ' end as skills
       from (select * replace (coalesce(job_type, '') as job_type) from feed) t""",
    "feed",
)
sql(
    "coerce_lists",
    """select run_id, case when keywords is null or trim(keywords) = '' then ''
              when starts_with(keywords, '[')
              then array_to_string(json_extract_string(keywords, '$[*]'), '|')
              else keywords end as keywords
       from runs""",
    "runs",
)
sql(
    "clean_skills",
    f"""select k, array_to_string(list_filter([part_name, 'sql', lower(currency), job_type],
               lambda x: x is not null), '|') as skills from feed""",
    "feed",
)
sql(
    "norm_codes",
    """select k, substr(currency, 1, 2) as from_currency,
              cast(null as varchar) as country_code, currency,
              cast(null as varchar) as no_currency, "interval" as period,
              cast(null as varchar) as no_period, location as city
       from feed""",
    "feed",
)
sql(
    "norm_work_mode",
    """select k, case when contains(title, 'remote') then 'remote'
              when contains(title, 'hybrid') then 'hybrid'
              when contains(title, 'on site') and length(title) % 7 <> 6 then 'on-site' end
              as work_mode
       from feed""",
    "feed",
)
sql(
    "empty_subobjects",
    """select k, site = 'linkedin' or coalesce(currency, '') in ('USD', 'EUR')
              or location is null as is_empty
       from feed""",
    "feed",
)
sql(
    "run_durations",
    f"""select run_id, {r6(_SECONDS)} as duration_seconds, {_DURATION} as duration from runs""",
    "runs",
)


def _doc(body: str) -> str:
    return (
        f"case when {body} = '' then coalesce(title, '') "
        f"else coalesce(title, '') || '. ' || {body} end"
    )


_WHOLE_DOC = _doc(strip("coalesce(description, '')"))
sql(
    "relevance_docs",
    f"""select k, sha256({_WHOLE_DOC}) as doc_sha,
               cast(length({_WHOLE_DOC}) as bigint) as doc_chars from feed""",
    "feed",
)
sql(
    "extraction_inputs",
    f"""select k, sha256('Search intent: ' || search_keyword || chr(10) || chr(10)
               || 'Job title: ' || coalesce(nullif({strip("title")}, ''), '(untitled)')
               || chr(10) || chr(10) || 'Job description:' || chr(10)
               || coalesce(nullif({strip("description")}, ''), '(no description)')) as input_sha
        from feed""",
    "feed",
)
sql(
    "ensemble_verdicts",
    f"""select id, case when v = 'reject' or coalesce(score, 1.0) < 0.35
                    or coalesce(min_amount - 30000, 0) < 0
                    or coalesce(max_amount / 100000, 1.0) < 0.5 then 'reject'
                    when is_remote then 'accept' else 'reject' end as verdict
        from (select *, {_verdict("score", "false")} as v
              from (select *, {_score("title", "search_keyword")} as score from staging) a) b""",
    "staging",
)
_NO_LIST = "''"
sql(
    "clean_profiles",
    f"""select profile_id, name, cast(null as varchar) as description,
               {joined("keywords")} as keywords, {joined("locations")} as locations,
               'linkedin|indeed' as sites, true as valid from clean_profile
        union all select profile_id, '', null, {joined("keywords")}, {joined("locations")},
               'linkedin|indeed', false from clean_profile
        union all select profile_id, name, null, {joined("keywords")}, {joined("locations")},
               'linkedin|indeed', true from clean_profile
        union all select profile_id, name, null, {_NO_LIST}, {joined("locations")},
               'linkedin|indeed', false from clean_profile""",
    "clean_profile",
)
_LINES = f"""list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
    lambda x: {strip("x")}), lambda x: x <> '')"""
sql(
    "parse_lines",
    f"""select doc_id, cast(len({_LINES}) as bigint) as lines,
               sha256(array_to_string({_LINES}, chr(10))) as lines_sha from documents""",
)

# --- relevance ---------------------------------------------------------------------------
CTES["scored_vectors"] = (
    ["query_vectors"],
    """select vec_id, label, greatest(0.0, least(1.0, list_cosine_similarity(
              embedding::double[], query_embedding::double[]))) as score
       from embeddings join query_vectors on label = query_label""",
)
sql(
    "semantic_score",
    f"""select vec_id, cast(label as bigint) as label, {r6("score")} as semantic_score
        from scored_vectors""",
    "scored_vectors",
)
sql(
    "semantic_filter",
    "select vec_id, cast(label as bigint) as label from scored_vectors where score >= 0.35",
    "scored_vectors",
)
sql(
    "semantic_topk",
    """select cast(label as bigint) as label, vec_id, position from (
         select label, vec_id, row_number() over (partition by label
                order by round(score, 9) desc, vec_id) as position from scored_vectors) t
       where position <= 10""",
    "scored_vectors",
)


def _bm25(source: str, key_: str, prefix: str) -> None:
    """Register the views of BM25 over (key, keyword, doc) rows of ``source``."""
    CTES[f"{prefix}_words"] = (
        [source],
        f"select {key_} as id, search_keyword as q, {words('doc')} as w from {source}",
    )
    CTES[f"{prefix}_stats"] = (
        [f"{prefix}_words"],
        f"select count(*) as n, avg(len(w)) as length from {prefix}_words",
    )
    CTES[f"{prefix}_terms"] = (
        [f"{prefix}_words"],
        f"""select q, unnest({tokens("q")}) as term
            from (select distinct q from {prefix}_words) t""",
    )
    CTES[f"{prefix}_df"] = (
        [f"{prefix}_words", f"{prefix}_terms"],
        f"""select term, count(*) as df
            from (select id, unnest(list_distinct(w)) as term from {prefix}_words) t
            where term in (select term from {prefix}_terms) group by term""",
    )
    CTES[f"{prefix}_bm25"] = (
        [f"{prefix}_words", f"{prefix}_stats", f"{prefix}_terms", f"{prefix}_df"],
        f"""select d.id, coalesce(sum(
                   ln(1 + (s.n - coalesce(f.df, 0) + 0.5) / (coalesce(f.df, 0) + 0.5))
                   * (tf(d.w, t.term) * 2.2 / (tf(d.w, t.term)
                      + 1.2 * (0.25 + 0.75 * len(d.w) / s.length)) - 0.5)
                   order by t.term), 0.0) as score
            from {prefix}_words d cross join {prefix}_stats s
            left join {prefix}_terms t on t.q = d.q left join {prefix}_df f on f.term = t.term
            group by d.id""".replace(
            "tf(d.w, t.term)", "len(list_filter(d.w, lambda x: x = t.term))"
        ),
    )


CTES["docs"] = (["feed"], f"select k, search_keyword, {_WHOLE_DOC} as doc from feed")
_bm25("docs", "k", "d")
sql(
    "pair_score_bm25",
    f"select id as k, {r6('score')} as pair_score from d_bm25",
    "d_bm25",
)

# --- extraction ----------------------------------------------------------------------------
CTES["texts"] = (
    ["feed"],
    "select k, concat_ws(chr(10), title, salary_source, location, description) as text from feed",
)
CTES["vocabulary"] = (
    [],
    f"""select distinct lower(p_name) as name, 'domain' as skill_type from part
        union select distinct 'senior ' || lower(p_name), 'domain' from part
        union select distinct split_part(lower(p_name), ' ', -1), 'tech' from part
        union select distinct w, 'soft' from (select unnest({tokens("text")}) as w from benchmark) t
              where length(w) >= 8""",
)
# a phrase of any length is in a text when its words follow each other there
CTES["skills"] = (
    ["texts", "vocabulary"],
    f"""select distinct g.k, v.name, v.skill_type
        from (select k, array_to_string(w[i:i + n - 1], ' ') as name
              from (select k, w, unnest(range(1, len(w) + 1)) as i
                    from (select k, {words("text")} as w from texts) a) b,
                   (select distinct len(string_split(name, ' ')) as n from vocabulary) c) g
        join vocabulary v on v.name = g.name""",
)
sql("extract_skills", "select * from skills", "skills")
# pay is read from the parts the feed makes its text of, not by a pattern
CTES["pay"] = (
    ["feed"],
    """select k, try_cast(t[-5] as double) as salary_min, try_cast(t[-3] as double) as salary_max,
               case when len(t) = 6 then t[1] end as salary_currency,
               case t[-1] when 'hour' then 'hourly' when 'month' then 'monthly' when 'year' then 'yearly' end
                    as salary_period
        from (select k, string_split(salary_source, ' ') as t from feed) f""",
)
sql("extract_salary", "select * from pay", "pay")
sql(
    "extract_fields",
    """select p.*, coalesce(s.tech, '') as tech_skills, coalesce(s.soft, '') as soft_skills,
               coalesce(s.domain, '') as domain_skills, split_part(location, ', ', 1) as city,
               nullif(split_part(location, ', ', 2), '') as country,
               case split_part(location, ', ', 2) when 'USA' then 'US' when 'Hong Kong' then 'HK'
                    when 'Germany' then 'DE' when 'United Arab Emirates' then 'AE' end as country_code,
               case when title like '%hybrid%' then 'hybrid' when title like '%remote%' then 'remote'
                    when title like '%on site%' then 'on-site' end as work_mode
        from pay p join feed using (k)
        left join (select k, string_agg(name, '|' order by name) filter (skill_type = 'tech') as tech,
                          string_agg(name, '|' order by name) filter (skill_type = 'soft') as soft,
                          string_agg(name, '|' order by name) filter (skill_type = 'domain') as domain
                   from skills group by k) s using (k)""",
    "pay", "feed", "skills",
)
sql(
    "extract_work_mode",
    r"""select k, case when regexp_matches(text, '(?i)\bhybrid\b') then 'hybrid'
               when regexp_matches(text, '(?i)\b(?:remote|work from home)\b') then 'remote'
               when regexp_matches(text, '(?i)\b(?:on[- ]?site|in[- ]office)\b') then 'on-site' end
               as work_mode
        from texts""",
    "texts",
)
CTES["title_terms"] = (
    ["in_run"],
    f"""select distinct job_id, run_id, search_keyword, ensemble_verdict,
               unnest(list_concat(w, list_transform(range(1, len(w)),
                      lambda i: w[i] || ' ' || w[i + 1]))) as term
        from (select job_id, run_id, search_keyword, ensemble_verdict,
                     list_filter({words("job_title")},
                        lambda x: x not in ({_quoted(K.STOPWORDS)})) as w
              from in_run where job_title is not null
                   and ensemble_verdict in ('accept', 'reject')) t""",
)
CTES["suggested"] = (
    ["title_terms", "in_run"],
    f"""select * from (
          select *, row_number() over (partition by run_id, search_keyword
                 order by score desc, accepted desc, term) as position
          from (select run_id, search_keyword, term, accepted, rejected,
                       round(ln((accepted + 0.5) / (a - accepted + 0.5))
                             - ln((rejected + 0.5) / (r - rejected + 0.5)), 6) as score
                from (select run_id, search_keyword, term,
                             count(*) filter (ensemble_verdict = 'accept') as accepted,
                             count(*) filter (ensemble_verdict = 'reject') as rejected
                      from title_terms group by all) c
                join (select run_id, search_keyword,
                             count(*) filter (ensemble_verdict = 'accept') as a,
                             count(*) filter (ensemble_verdict = 'reject') as r
                      from in_run where job_title is not null group by all) n
                     using (run_id, search_keyword)) s
          where score > 0 and exists (select 1 from unnest(string_split(term, ' ')) u(p)
                where p not in (select unnest({tokens("search_keyword")})))) t
        where position <= 3""",
)
sql(
    "suggest_keywords",
    """select run_id, search_keyword, position, term, accepted, rejected, score
       from suggested""",
    "suggested",
)

# --- records -----------------------------------------------------------------------------
_J = "raw_response"


def _kind(path: str) -> str:
    return f"coalesce(json_type(j, '{path}'), 'ABSENT')"


def _text(path: str) -> str:
    return f"case when {_kind(path)} = 'VARCHAR' then json_extract_string(j, '{path}') end"


def _list_ok(path: str) -> str:
    return f"""({_kind(path)} in ('ABSENT', 'NULL') or ({_kind(path)} = 'ARRAY'
        and len(list_filter(json_extract(j, '{path}[*]'),
                lambda x: json_type(x) not in ('VARCHAR', 'NULL'))) = 0))"""


def _object_ok(path: str) -> str:
    sentinels = _quoted(K.EMPTY_SENTINELS)
    return f"""({_kind(path)} in ('ABSENT', 'NULL', 'OBJECT') or ({_kind(path)} = 'VARCHAR'
        and {norm(_text(path))} in ({sentinels})))"""


def _skills(path: str) -> str:
    names = f"list_filter(json_extract_string(j, '{path}[*]'), lambda x: x is not null)"
    clean = f"list_filter(list_transform({names}, lambda x: {norm('x')}), lambda x: x <> '')"
    return f"""case when {_kind(path)} = 'ARRAY' then array_to_string(
        list_filter({clean}, lambda x, i: list_position({clean}, x) = i), '|') else '' end"""


def _code(path: str, n: int) -> str:
    text = f"upper({strip(_text(path))})"
    return f"case when regexp_full_match({text}, '[A-Z]{{{n}}}') then {text} end"


_MODE = norm(_text("$.work_mode"))
_ALIASES = _quoted(K.WORK_MODE_ALIASES)
CTES["parsed"] = (
    ["records"],
    f"""select job_id, raw_response, search_keyword,
          {_skills("$.tech_skills")} as tech_skills, {_skills("$.soft_skills")} as soft_skills,
          {_skills("$.domain_skills")} as domain_skills,
          nullif({strip(_text("$.location.city"))}, '') as city,
          nullif({strip(_text("$.location.country"))}, '') as country,
          {_code("$.location.country_code", 2)} as country_code,
          case when {_MODE} in ({_ALIASES}) then 'on-site'
               when {_MODE} in ('remote', 'hybrid', 'on-site') then {_MODE} end as work_mode,
          try_cast(json_extract_string(j, '$.salary.min_amount') as double) as salary_min,
          try_cast(json_extract_string(j, '$.salary.max_amount') as double) as salary_max,
          {_code("$.salary.currency", 3)} as salary_currency,
          case when {norm(_text("$.salary.period"))} in ('yearly', 'monthly', 'hourly')
               then {norm(_text("$.salary.period"))} end as salary_period,
          case when {_kind("$.is_relevant")} = 'ABSENT' then true
               else json_extract_string(j, '$.is_relevant') = 'true' end as is_relevant,
          case when {_kind("$.relevance_confidence")} = 'ABSENT' then 1.0::double
               else json_extract_string(j, '$.relevance_confidence')::double end
               as relevance_confidence,
          {_text("$.relevance_reason")} as relevance_reason,
          coalesce(json_type(j) = 'OBJECT' and {_list_ok("$.tech_skills")}
             and {_list_ok("$.soft_skills")} and {_list_ok("$.domain_skills")}
             and {_object_ok("$.location")} and {_object_ok("$.salary")}
             and coalesce(json_extract_string(j, '$.relevance_confidence')::double, 1.0)
                 between 0 and 1, false) as valid
        from (select *, case when json_valid({_J}) then {_J}::json end as j from records) t""",
)
sql(
    "normalize_records",
    "select * exclude (valid, raw_response, search_keyword) from parsed where valid",
    "parsed",
)
sql("invalid_records", "select job_id, raw_response from parsed where not valid", "parsed")

# --- cascade -------------------------------------------------------------------------------
CTES["todo"] = (
    ["staging", "enriched", "judged"],
    f"""select s.*, j.rule_verdict,
               case when len({_T}) * len({_Q}) = 0 then 0.0
                    else len(list_intersect({_T}, {_Q}))
                         / sqrt((len({_T}) * len({_Q}))::double) end as sem
        from staging s left join (select job_id, rule_verdict from judged) j on j.job_id = s.id
        where (j.rule_verdict is null or j.rule_verdict <> 'reject')
              and not (s.run_id <= 'run-1994' and s.id in (select job_id from enriched))""",
)
CTES["survivors"] = (
    ["todo"],
    f"select id, search_keyword, {_WHOLE_DOC} as doc from todo where sem >= 0.35",
)
_bm25("survivors", "id", "s")
CTES["verdicts"] = (
    ["todo", "s_bm25", "parsed"],
    """select t.id as job_id, coalesce(t.rule_verdict, 'accept') as rule_verdict,
              p.is_relevant as llm_is_relevant, p.relevance_confidence as llm_confidence,
              case when t.sem < 0.35 or b.score < 0 then 'reject'
                   when p.is_relevant then 'accept' else 'reject' end as ensemble_verdict,
              round(t.sem, 6) as biencoder_score,
              round(coalesce(b.score, 0.0), 6) as crossencoder_score
       from todo t left join s_bm25 b on b.id = t.id
       left join (select * from parsed where valid) p on p.job_id = t.id and t.sem >= 0.35
       where t.sem < 0.35 or p.job_id is not null""",
)
sql("relevance_cascade", "select * from verdicts", "verdicts")
CTES["taught"] = (
    ["labels_"],
    """select profile_id, a, r, a >= 4 and r >= 4 as trained, ln((a + 1) / (r + 1)) as bias
       from (select profile_id, count(*) filter (label = 'accept') as a, count(*) filter (label = 'reject') as r
             from labels_ where coalesce(title_norm, '') <> '' group by profile_id) t""",
)
CTES["told"] = (
    ["taught", "labels_"],
    f"""select w.profile_id, word, ln((w.a + 0.5) / (t.a + 1)) - ln((w.r + 0.5) / (t.r + 1)) as weight
        from (select profile_id, word, count(*) filter (label = 'accept') as a,
                     count(*) filter (label = 'reject') as r
              from (select profile_id, label, unnest({tokens("title_norm")}) as word from labels_
                    where label in ('accept', 'reject') and coalesce(title_norm, '') <> '') u
              group by all) w join taught t on t.profile_id = w.profile_id and t.trained""",
)
CTES["learned"] = (
    ["taught", "told", "staging"],
    f"""select s.id, case when t.profile_id is null then 1.0
                          else 1 / (1 + exp(-(t.bias + coalesce(g.told, 0.0)))) end as score
        from staging s left join taught t on t.profile_id = s.profile_id and t.trained
        left join (select id, sum(weight) as told
                   from (select id, profile_id, unnest({tokens("coalesce(title, '')")}) as word from staging) u
                   join told using (profile_id, word) group by id) g on g.id = s.id""",
)
sql(
    "fewshot_train_summary",
    "select profile_id, a as n_accept, r as n_reject, trained from taught",
    "taught",
)
sql("fewshot_scores", "select id, round(score, 6) as fewshot_score from learned", "learned")
sql("fewshot_stored_scores", "select id, round(score, 6) as fewshot_score from learned", "learned")
sql(
    "relevance_cascade_learned",
    """select v.job_id, case when l.score < 0.5 then 'reject' else v.ensemble_verdict end as ensemble_verdict,
              round(case when v.biencoder_score < 0.35 then 1.0 else l.score end, 6) as setfit_score
       from verdicts v join learned l on l.id = v.job_id""",
    "verdicts", "learned",
)
sql(
    "enrichment_summary",
    """select (select count(*) from todo) as attempted,
              (select count(*) from verdicts) as succeeded,
              (select count(*) from todo) - (select count(*) from verdicts) as failed""",
    "todo", "verdicts",
)

# --- transform and whole runs ----------------------------------------------------------------
sql("dim_location", "select * from dim_location", "dim_location")
sql("dim_salary", "select * from dim_salary", "dim_salary")
sql("dim_skill", "select * from dim_skill", "dim_skill")
sql("job_skill_bridge", "select * from bridge", "bridge")
sql(
    "fact_job_offers",
    f"""select * replace ({ts("scraped_at")} as scraped_at, {ts("enriched_at")} as enriched_at,
               cast(date_posted as varchar) as date_posted) from fact""",
    "fact",
)
sql(
    "run_transform",
    """select job_id, profile_id, search_keyword, location_key, salary_key, work_mode from fact""",
    "fact",
)
sql(
    "land_and_judge",
    f"""select id as job_id, profile_id, search_keyword, title as job_title,
               {_verdict("score", "blocked")} as rule_verdict,
               {_reason("score", "blocked")} as rule_reason,
               {_verdict("score", "blocked")} as ensemble_verdict,
               '2030-01-01 00:00:00' as judged_at
        from (select *, {_score("title", "search_keyword")} as score, {_BLOCKED} as blocked
              from staging s where run_id > 'run-1997') t""",
    "staging", "labels_",
)
CTES["report"] = (
    ["rates", "suggested"],
    f"""select r.run_id, r.search_keyword, r.total, r.accepted,
               {r6("r.accepted::double / r.total")} as acceptance_rate,
               r.accepted::double / r.total < 0.30 as triggered,
               case when r.accepted::double / r.total < 0.30
                    then list(s.term order by s.position) filter (s.term is not null) end as terms
        from rates r left join suggested s
             on s.run_id = r.run_id and s.search_keyword = r.search_keyword
        group by r.run_id, r.search_keyword, r.total, r.accepted""",
)
sql(
    "corrective_report",
    """select * exclude (terms), coalesce(array_to_string(terms, '|'), '') as alternatives
       from report""",
    "report",
)
sql(
    "corrective_requests",
    """select r.run_id, r.search_keyword, r.alternative, l.search_location
       from (select run_id, search_keyword, unnest(terms) as alternative from report
             where triggered) r
       left join (select distinct run_id, search_location from staging) l using (run_id)""",
    "report", "staging",
)
CTES["samples"] = (
    ["in_run"],
    """select run_id, search_keyword, ensemble_verdict, position, lower(job_title) as title from (
         select *, row_number() over (partition by run_id, search_keyword, ensemble_verdict
                order by judged_at desc, job_id) as position
         from in_run where job_title is not null) t
       where position <= 5""",
)
sql(
    "corrective_requests_proposed",
    """select run_id, search_keyword, title as alternative, l.search_location
       from (select *, row_number() over (partition by run_id, search_keyword order by first_at) as place
             from (select run_id, search_keyword, title, min(position) as first_at
                   from samples s join (select run_id, search_keyword from report where triggered) r
                        using (run_id, search_keyword)
                   where ensemble_verdict = 'accept' and trim(title) <> '' and title <> lower(search_keyword)
                     and not exists (select 1 from samples b where b.run_id = s.run_id
                         and b.search_keyword = s.search_keyword and b.ensemble_verdict = 'reject' and b.title = s.title)
                   group by all) t) p
       left join (select distinct run_id, search_location from staging) l using (run_id)
       where place <= 3""",
    "report", "samples", "staging",
)
sql(
    "corrective_outcome",
    """select r.run_id, r.search_keyword, count(i.job_id) as new_rows_landed,
              count(i.job_id) filter (i.ensemble_verdict = 'accept') as new_rows_accepted
       from report r left join in_run i
            on i.run_id = r.run_id and list_contains(r.terms, i.search_keyword)
       where r.triggered group by r.run_id, r.search_keyword""",
    "report", "in_run",
)
sql(
    "migrate_profiles",
    f"""select profile_id as owner, 'default' as profile_id, 'Default' as name,
               {joined("keywords")} as keywords,
               case when name > 'C' and len(locations) > 0 then {joined("locations")}
                    else 'London, UK' end as locations,
               'linkedin|indeed' as sites
        from clean_profile""",
    "clean_profile",
)

# --- a whole run: rule verdicts with the blocklist, then cascade, gate and star -------------------
CTES["fresh_judged"] = (
    ["staging", "labels_"],
    f"""select *, {_verdict("score", "blocked")} as rule_verdict,
               case when len({_T}) * len({_Q}) = 0 then 0.0
                    else len(list_intersect({_T}, {_Q}))
                         / sqrt((len({_T}) * len({_Q}))::double) end as sem
        from (select *, {_score("title", "search_keyword")} as score, {_BLOCKED} as blocked
              from staging s) t""",
)
CTES["run_survivors"] = (
    ["fresh_judged"],
    f"""select id, search_keyword, {_WHOLE_DOC} as doc from fresh_judged
        where rule_verdict <> 'reject' and sem >= 0.35""",
)
_bm25("run_survivors", "id", "r")
CTES["run_enriched"] = (
    ["fresh_judged", "r_bm25", "parsed"],
    """select f.id, case when b.score >= 0 and p.is_relevant then 'accept' else 'reject' end
              as ensemble_verdict, p.*
       from r_bm25 b join fresh_judged f on f.id = b.id
       join (select * from parsed where valid) p on p.job_id = b.id""",
)
CTES["run_fact"] = (
    ["run_enriched"],
    "select * from run_enriched where ensemble_verdict = 'accept'",
)


def _run_skills(kind: str) -> str:
    return (
        f"select job_id, unnest(string_split({kind}_skills, '|')) as name, '{kind}' as t "
        f"from run_fact where {kind}_skills <> ''"
    )


CTES["run_skills"] = (
    ["run_fact"],
    " union all ".join(_run_skills(kind) for kind in K.SKILL_TYPES),
)
sql(
    "full_run",
    f"""select 'scraped' as table_name, count(*) as n from staging
        union all select 'enriched', (select count(*) from run_enriched)
             + (select count(*) from fresh_judged where rule_verdict <> 'reject' and sem < 0.35)
        union all select 'fact_job_offers', count(*) from run_fact
        union all select 'dim_location',
             count(distinct {loc_key("city", "country_code")}) from run_fact
        union all select 'dim_salary', count(distinct
             {sal_key("salary_min", "salary_max", "salary_currency", "salary_period")}) from run_fact
        union all select 'dim_skill', count(distinct name || '|' || t) from run_skills
        union all select 'job_skill_bridge',
             count(distinct job_id || '|' || name || '|' || t) from run_skills""",
    "staging", "run_enriched", "run_fact", "run_skills",
)

# --- a run whose low keywords are searched again among the postings of one site -------------------
CTES["c1_staging"] = (["staging"], "select * replace ('run-all' as run_id) from staging where site <> 'indeed'")


def _judged_pass(step: str, pending: str) -> None:
    """Views of one enrichment pass over ``pending``: survivors, scores, and new verdicts by id."""
    CTES[f"{step}_survivors"] = (
        [pending], f"select id, search_keyword, {_WHOLE_DOC} as doc from {pending} where rule_verdict <> 'reject' and sem >= 0.35",
    )
    _bm25(f"{step}_survivors", "id", step)
    CTES[f"{step}_enriched"] = (
        [f"{step}_bm25", "parsed"],
        f"""select b.id, b.score, p.is_relevant from {step}_bm25 b join (select * from parsed where valid) p on p.job_id = b.id""",
    )
    CTES[f"{step}_verdicts"] = (
        [pending, f"{step}_enriched"],
        f"""select f.id as job_id, f.search_keyword, f.title as job_title, f.rule_verdict, e.is_relevant as llm_is_relevant,
                  case when f.rule_verdict = 'reject' then 'reject' when f.sem < 0.35 then 'reject'
                       when e.id is null then f.rule_verdict when e.score >= 0 and e.is_relevant then 'accept' else 'reject' end
                       as ensemble_verdict,
                  case when f.rule_verdict = 'reject' then null when f.sem < 0.35 or e.id is not null then f.sem end as biencoder_score,
                  case when f.rule_verdict = 'reject' then null when f.sem < 0.35 then 0.0 else e.score end as crossencoder_score
           from {pending} f left join {step}_enriched e on e.id = f.id""",
    )


def _renamed(view: str, **names: str) -> str:
    body = CTES[view][1]
    for old, new in names.items():
        body = re.sub(rf"\b{old}\b", new, body)
    return body


CTES["c1_judged"] = (["c1_staging", "labels_"], _renamed("fresh_judged", staging="c1_staging"))
_judged_pass("c1", "c1_judged")
CTES["c1_in_run"] = (["c1_verdicts"], "select *, 'run-all' as run_id from c1_verdicts")
CTES["c1_title_terms"] = (["c1_in_run"], _renamed("title_terms", in_run="c1_in_run"))
CTES["c1_suggested"] = (["c1_title_terms", "c1_in_run"], _renamed("suggested", title_terms="c1_title_terms", in_run="c1_in_run"))
CTES["c1_low"] = (
    ["c1_in_run"],
    """select search_keyword from c1_in_run where search_keyword is not null
       group by search_keyword having count(*) filter (ensemble_verdict = 'accept')::double / count(*) < 0.30""",
)
# a title names an alternative when its words follow each other there
CTES["c2_fetched"] = (
    ["staging", "c1_staging", "c1_suggested", "c1_low"],
    f"""select h.* exclude (search_keyword) replace ('run-all' as run_id), f.search_keyword
        from staging h join (
          select h.id, min(s.term) as search_keyword
          from (select id, search_location, ' ' || array_to_string({words("title")}, ' ') || ' ' as named
                from staging where site = 'indeed') h
          join (select distinct term from c1_suggested where search_keyword in (select search_keyword from c1_low)) s
               on contains(h.named, ' ' || s.term || ' ')
          where h.search_location in (select search_location from c1_staging)
          group by h.id) f on f.id = h.id
        where h.id not in (select id from c1_staging)""",
)
CTES["c2_judged"] = (["c2_fetched", "labels_"], _renamed("fresh_judged", staging="c2_fetched"))
# postings of the first pass without a record, or rejected by their semantic score, are scored again
CTES["c2_pending"] = (
    ["c1_judged", "c2_judged", "c1_enriched"],
    "select * from c1_judged where id not in (select id from c1_enriched) union all by name select * from c2_judged",
)
_judged_pass("c2", "c2_pending")
sql(
    "full_run_corrected",
    f"""select job_id, search_keyword, rule_verdict, llm_is_relevant, ensemble_verdict, {r6("biencoder_score")} as biencoder_score,
               {r6("crossencoder_score")} as crossencoder_score
        from (select * from c2_verdicts
              union all by name select * from c1_verdicts where job_id in (select id from c1_enriched)) t""",
    "c2_verdicts", "c1_verdicts",
)

# --- streams ----------------------------------------------------------------------------------
sql(
    "stream_land_dedup",
    f"""select id, job_url, {ts("scraped_at")} as scraped_at, k from (
          select {key("o_orderstatus", "u")} as id, u as job_url, o_orderdate as scraped_at,
                 o_orderkey as k
          from (select *, 'https://jobs.example.org/' || (o_orderkey // 10) as u from orders) t)
        qualify row_number() over (partition by id order by scraped_at, k) = 1""",
)
sql(
    "stream_upsert_verdicts",
    f"""select cast(user_id as varchar) as job_id,
               case event_type when 'purchase' then 'accept' when 'error' then 'reject'
                    else 'review' end as verdict,
               {ts("ts")} as judged_at, event_id
        from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
)
sql(
    "stream_daily_counts",
    f"""select {ts("date_trunc('day', ts)")} as window_start, event_type, count(*) as n
        from events group by all""",
)
sql(
    "fresh_rows",
    f"""select event_id, {ts("ts")} as ts, event_type from events e
        where e.ts >= (select max(ts) from events) - interval 72 hour""",
)

# --- checks -------------------------------------------------------------------------------------
def _duplicates(table: str, keys: str, source: str) -> str:
    return f"""select '{table}' as table_name, count(*) as duplicate_keys,
        cast(coalesce(sum(n - 1), 0) as bigint) as extra_rows
      from (select count(*) as n from {source} group by {keys} having count(*) > 1) t"""


sql(
    "check_unique",
    " union all ".join(
        [
            _duplicates("feed", "site, job_url", f"(select * from feed where {strip('job_url')} <> '')"),
            _duplicates("dim_location", "location_key", "dim_location"),
            _duplicates("dim_salary", "salary_key", "dim_salary"),
            _duplicates("dim_skill", "skill_key", "dim_skill"),
            _duplicates("fact_job_offers", "job_id", "fact"),
            _duplicates("job_skill_bridge", "job_id, skill_key", "bridge"),
        ]
    ),
    "feed", "dim_location", "dim_salary", "dim_skill", "fact", "bridge",
)


def _orphans(name: str, child: str, child_key: str, parent: str, parent_key: str) -> str:
    return f"""select '{name}' as reference, count(distinct {child_key}) as orphan_keys,
        count(*) as orphan_rows from {child} c
      where {child_key} is not null
        and {child_key} not in (select {parent_key} from {parent})"""


sql(
    "check_fk",
    " union all ".join(
        [
            _orphans("fact.location", "fact", "location_key", "dim_location", "location_key"),
            _orphans("fact.salary", "fact", "salary_key", "dim_salary", "salary_key"),
            _orphans("bridge.job", "bridge", "job_id", "fact", "job_id"),
            _orphans("bridge.skill", "bridge", "skill_key", "dim_skill", "skill_key"),
            _orphans("staging.fact", "staging", "id", "fact", "job_id"),
        ]
    ),
    "staging", "fact", "dim_location", "dim_salary", "dim_skill", "bridge",
)
sql(
    "check_domain",
    """select count(*) filter (rule_verdict not in ('accept', 'review', 'reject'))
                  as bad_rule_verdict,
              count(*) filter (ensemble_verdict not in ('accept', 'reject')) as bad_ensemble,
              count(*) filter (l.label not in ('accept', 'reject', 'unsure')) as bad_label,
              count(*) filter (e.work_mode not in ('remote', 'hybrid', 'on-site'))
                  as bad_work_mode,
              count(*) filter (e.country_code is null) as no_country,
              count(*) filter (j.profile_id is null) as no_profile
       from judged j left join enriched e on e.job_id = j.job_id
       left join labels_ l on l.profile_id = j.profile_id
            and l.title_norm = lower(trim(j.job_title))""",
    "judged", "enriched", "labels_",
)
