"""Fixed values shared by the jobs.

These must equal the values the results are compared with; change them only
together with the data they describe.
"""

from __future__ import annotations

# --- title rule ---------------------------------------------------------------
STOPWORDS = ("a", "an", "the", "of", "at", "in", "for", "and", "or", "with", "to", "is", "are")
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RULE_ACCEPT_AT = 0.5
RULE_REVIEW_AT = 0.15

# Every character Python's ``str.strip`` / ``str.split`` treats as white space: as text, and
# as a pattern.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# --- verdicts and labels ------------------------------------------------------
VERDICTS = ("accept", "review", "reject")
LABELS = ("accept", "reject", "unsure")

# --- boards -------------------------------------------------------------------
ALL_SITES = ("linkedin", "indeed", "glassdoor", "google", "zip_recruiter")
DEFAULT_SITES = ("linkedin", "indeed")

# --- skills, work modes, salary periods ---------------------------------------
SKILL_TYPES = ("tech", "soft", "domain")
WORK_MODES = ("remote", "hybrid", "on-site")
WORK_MODE_ALIASES = {
    "onsite": "on-site",
    "on site": "on-site",
    "on_site": "on-site",
    "in-office": "on-site",
    "in office": "on-site",
    "office": "on-site",
}
SALARY_PERIODS = ("yearly", "monthly", "hourly")
EMPTY_SENTINELS = ("", "null", "none", "unknown", "n/a")

# --- relevance cascade --------------------------------------------------------
SEMANTIC_THRESHOLD = 0.35
PAIR_THRESHOLD = 0.0
FEWSHOT_THRESHOLD = 0.5
FEWSHOT_MIN_PER_CLASS = 4
MODEL_INPUT_CHARS = 500

# --- corrective pass ----------------------------------------------------------
CORRECTIVE_RATE = 0.30
CORRECTIVE_MAX_ALTERNATIVES = 3
CORRECTIVE_SAMPLE_TITLES = 5

# --- readers ------------------------------------------------------------------
FACT_LIMIT_DEFAULT = 500
FACT_LIMIT_MAX = 5000
TRIAGE_LIMIT = 200
TOP_SKILLS = {"tech": 20, "soft": 10, "domain": 15}

# --- freshness ----------------------------------------------------------------
FRESH_HOURS = 72

# --- default profile ----------------------------------------------------------
DEFAULT_PROFILE_ID = "default"
DEFAULT_PROFILE_NAME = "Default"

# --- countries a board can be asked for ---------------------------------------
# The name of a country is its own alias with blanks removed ("hong kong" ->
# "hongkong"); the aliases that break the rule are listed below the names.
BOARD_COUNTRIES = (
    "argentina", "australia", "austria", "bahrain", "bangladesh", "belgium", "bulgaria",
    "brazil", "canada", "chile", "china", "colombia", "costa rica", "croatia", "cyprus",
    "czech republic", "denmark", "ecuador", "egypt", "estonia", "finland", "france",
    "germany", "greece", "hong kong", "hungary", "india", "indonesia", "ireland", "israel",
    "italy", "japan", "kuwait", "latvia", "lithuania", "luxembourg", "malaysia", "malta",
    "mexico", "morocco", "netherlands", "new zealand", "nigeria", "norway", "oman",
    "pakistan", "panama", "peru", "philippines", "poland", "portugal", "qatar", "romania",
    "saudi arabia", "singapore", "slovakia", "slovenia", "south africa", "south korea",
    "spain", "sweden", "switzerland", "taiwan", "thailand", "turkey", "ukraine",
    "united arab emirates", "uk", "usa", "uruguay", "venezuela", "vietnam", "worldwide",
)
BOARD_COUNTRY_ALIASES = {
    "united kingdom": "uk",
    "us": "usa",
    "united states": "usa",
    "czechia": "czechrepublic",
    "türkiye": "turkey",
}
