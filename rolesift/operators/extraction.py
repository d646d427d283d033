"""Default field extraction from posting text, and the hook for a plugged-in extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions.text import words

# How pay and place of work are written in postings.
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CHF", "INR", "CAD", "AUD")
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}
PERIOD_WORDS = {
    "hour": "hourly", "hr": "hourly", "h": "hourly", "hourly": "hourly",
    "month": "monthly", "mo": "monthly", "monthly": "monthly",
    "year": "yearly", "yr": "yearly", "annum": "yearly", "yearly": "yearly", "annually": "yearly", "p.a": "yearly", "pa": "yearly",
}
# Pay of other periods keeps its amounts; records know no word for the period.
OTHER_PERIOD_WORDS = ("day", "daily", "week", "wk", "weekly")
_BLANK = r"[ \u00a0\u2009\u202f]"
# An amount: groups parted by commas (of two digits too), points, or blanks and apostrophes; else plain digits.
_COMMAS = r"\d{1,3}(?:,\d{2,3})*,\d{3}(?:\.\d{1,2})?"
_POINTS = r"\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?"
_BLANKS = r"\d{1,3}(?:[ \u00a0\u2009\u202f'’]\d{3})+(?:[.,]\d{1,2})?"
_PLAIN = r"\d{1,9}(?:[.,]\d{1,2})?"
_AMOUNT = rf"(?:{_COMMAS}|{_POINTS}|{_BLANKS}|{_PLAIN})(?!\d)"
_MARK = rf"(?:(?:{'|'.join(CURRENCY_CODES)})(?![a-z])|[{''.join(CURRENCY_SIGNS)}])"
_SIDE = rf"{_AMOUNT}(?:{_BLANK}?k)?(?![a-z0-9])"
# the shortest forms need the word or stroke before them, "k" and "h" stand alone
_UNIT = "hour|hr|h|day|week|wk|month|mo|year|yr|annum"
_PERIOD = rf"\s?(?:(?:per|an?|/)\s?(?:{_UNIT})\b|(?:hourly|daily|weekly|monthly|yearly|annually)\b|p\.?a\b)"
# A range, or a single amount that has a currency or two digits; never from inside a number or word.
SALARY_PATTERN = (
    rf"(?i)(?<![\w.,])(?:{_MARK}\s?|(?<!\d{_BLANK}))(?:"
    rf"{_SIDE}(?:\s?{_MARK})?\s?(?:-|–|—|to)\s?(?:{_MARK}\s?)?{_SIDE}(?:\s?{_MARK})?"
    rf"|(?:(?<={_MARK})|(?<={_MARK}\s)|(?=\d[\d,.'’k]|\d{_BLANK}(?:\d{{3}}|k)|{_SIDE}\s?{_MARK})){_SIDE}(?:\s?{_MARK})?"
    rf"){_PERIOD}"
)
COUNTRY_SHORT_NAMES = {
    "usa": "US", "us": "US", "uk": "GB", "uae": "AE", "hong kong": "HK", "czech republic": "CZ", "turkey": "TR",
}
WORK_MODE_PATTERNS = {
    "hybrid": r"(?i)\bhybrid\b",
    "remote": r"(?i)\b(?:remote|work from home)\b",
    "on-site": r"(?i)\b(?:on[- ]?site|in[- ]office)\b",
}


def posting_text(*parts: Column) -> Column:
    """The whole text of a posting, one part per line."""
    return F.concat_ws("\n", *parts)


def extract_work_mode(text: Column) -> Column:
    """The most specific mode the text names: hybrid, then remote, then on-site."""
    mode = F.lit(None).cast("string")
    for name, pattern in reversed(WORK_MODE_PATTERNS.items()):
        mode = F.when(text.rlike(pattern), name).otherwise(mode)
    return mode


def _number(amount: Column) -> Column:
    """The value of one written amount, whatever parts its groups."""
    bare = F.regexp_replace(amount, r"[ \u00a0\u2009\u202f'’]", "")
    return (
        F.when(amount.rlike(f"^{_COMMAS}$"), F.regexp_replace(bare, ",", ""))
        .when(amount.rlike(f"^{_POINTS}$"), F.replace(F.regexp_replace(bare, r"\.", ""), F.lit(","), F.lit(".")))
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
        .try_cast("double")
    )


def extract_salary(postings: DataFrame, text: str) -> DataFrame:
    """Add amounts, currency and period of the first pay the text states.

    Amounts may be grouped by commas (also in the Indian way), points, blanks or apostrophes and end in ``k``; a currency
    stands on either side; the period is named or an adverb. A single amount is both ends of its
    range; ``50-70k`` means thousands on both sides. Pay by the day or week has no period word in a
    record: its amounts stay, the period is null. The long text is searched once; the parts are
    read from the short match.
    """
    found = postings.withColumn("_pay", F.nullif(F.regexp_extract(text, SALARY_PATTERN, 0), F.lit("")))
    sides = found.withColumn("_sides", F.regexp_extract_all("_pay", F.lit(rf"(?i)({_AMOUNT}(?:{_BLANK}?k)?)(?![a-z0-9])"), F.lit(1)))

    def side(index: int) -> tuple[Column, Column]:
        written = F.try_element_at("_sides", F.lit(index))
        thousands = F.lower(written).endswith("k")
        return _number(F.regexp_replace(written, rf"(?i){_BLANK}?k$", "")), thousands

    (low, low_k), (high, high_k) = side(1), side(2)
    low_k = low_k | (F.coalesce(high_k, F.lit(False)) & (low < 1000) & (low <= high))
    times = lambda amount, thousands: amount * F.when(thousands, 1000.0).otherwise(1.0)
    mark = F.upper(F.nullif(F.regexp_extract("_pay", rf"(?i)({_MARK})", 1), F.lit("")))
    unit = F.lower(F.regexp_extract("_pay", r"(?i)(p\.a|[a-z]+)$", 1))
    signs = F.create_map(*(F.lit(v) for v in chain.from_iterable(CURRENCY_SIGNS.items())))
    periods = F.create_map(*(F.lit(v) for v in chain.from_iterable(PERIOD_WORDS.items())))
    return sides.select(
        *postings.columns,
        times(low, low_k).alias("salary_min"),
        F.coalesce(times(high, high_k), times(low, low_k)).alias("salary_max"),
        F.coalesce(F.try_element_at(signs, mark), mark).alias("salary_currency"),
        F.try_element_at(periods, unit).alias("salary_period"),
    )


def country_names(spark: SparkSession) -> DataFrame:
    """(_name, _code): English country names as the Java runtime knows them, and common short ones."""
    locale = spark.sparkContext._jvm.java.util.Locale
    names = {locale("", code).getDisplayCountry(locale.ENGLISH).lower(): code for code in locale.getISOCountries()}
    return spark.createDataFrame(list((names | COUNTRY_SHORT_NAMES).items()), "_name string, _code string")


def extract_place(postings: DataFrame, place: str) -> DataFrame:
    """Add city, country and country code of a place written ``City, Country``.

    A place without a comma is a country when it is a known one, else a city. The code is
    known for the countries of the ISO table (about 250 rows, broadcast).
    """
    parts = F.filter(F.transform(F.split(F.col(place), ","), lambda p: F.trim(p)), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    codes = F.broadcast(country_names(postings.sparkSession))
    known = postings.withColumn("_parts", parts).withColumn("_last", F.lower(last)).join(
        codes, F.col("_last") == F.col("_name"), "left"
    )
    several = F.size("_parts") > 1
    return known.select(
        *postings.columns,
        F.when(several | F.col("_code").isNull(), F.get("_parts", F.lit(0))).alias("city"),
        F.when(several | F.col("_code").isNotNull(), F.try_element_at("_parts", F.lit(-1))).alias("country"),
        F.col("_code").alias("country_code"),
    )


def phrases(spelled: Column, max_words: int) -> Column:
    """Distinct runs of one to ``max_words`` neighbouring words of a word list."""
    runs = [spelled]
    for _ in range(max_words - 1):
        longer = F.zip_with(
            runs[-1],
            F.slice(spelled, len(runs) + 1, F.greatest(F.size(spelled), F.lit(1))),
            lambda head, word: F.concat(head, F.lit(" "), word),  # NULL beyond the text end
        )
        runs.append(longer)
    return F.array_distinct(F.array_compact(F.concat(*runs)))


#: Slots of the first-word index for each first word, and at most (one byte a slot, part of the plan).
INDEX_SPARSE = 16
INDEX_SLOTS = 1 << 20


def first_words(vocabulary: DataFrame) -> tuple[list[int], Callable[[Column, int], Column]]:
    """The phrase lengths of a vocabulary, and a test whether a word may begin a phrase of a length.

    The test looks up one byte of a table that travels with the plan: a slot is set for each (first word, length)
    that occurs. Its size follows the vocabulary up to a bound; beyond that it lets more words
    through, never fewer. The driver sees set slots and lengths, no phrases.
    """
    spelled = F.split("name", " ")
    heads = vocabulary.filter("name is not null").select(F.element_at(spelled, 1).alias("head"), F.size(spelled).alias("n")).distinct()
    known = heads.groupBy("n").agg(F.count(F.lit(1)).alias("heads")).collect()
    wanted = INDEX_SPARSE * sum(r["heads"] for r in known)
    slots = min(INDEX_SLOTS, 1 << max(10, wanted.bit_length()))

    def slot(word: Column, n: Column) -> Column:
        return F.pmod(F.xxhash64(word, n), F.lit(slots)).cast("int")

    table = bytearray(slots)
    for row in heads.select(slot(F.col("head"), F.col("n")).alias("slot")).distinct().collect():
        table[row["slot"]] = 1
    held, set_slot = F.lit(table), F.lit(bytearray(b"\x01"))

    def may_begin(word: Column, n: int) -> Column:
        return F.substring(held, slot(word, F.lit(n)) + 1, F.lit(1)) == set_slot

    return sorted(r["n"] for r in known), may_begin


def extract_skills(
    postings: DataFrame, key: str, text: str, vocabulary: DataFrame, max_words: int | None = None
) -> DataFrame:
    """(key, name, skill_type) for every vocabulary phrase a text contains.

    Runs of words are built only where a word begins a phrase of that length (``first_words``), so what leaves a row
    follows its hits, not the length of the longest phrase; ``max_words`` leaves longer phrases
    out. Runs are made distinct within their row before they are joined. Spark broadcasts the
    vocabulary while it is below its size threshold; beyond it the join is an exchange
    on the phrase, with skewed phrases split at run time.
    """
    lengths, may_begin = first_words(vocabulary)
    spelled = postings.select(key, words(F.col(text)).alias("_w"))

    def runs(n: int) -> Column:
        if n == 1:
            return F.filter("_w", lambda w: may_begin(w, 1))
        whole = lambda w, i: may_begin(w, n) & (i + n <= F.size("_w"))
        return F.transform("_w", lambda w, i: F.when(whole(w, i), F.array_join(F.slice("_w", i + 1, n), " ")))

    tried = [runs(n) for n in lengths if max_words is None or n <= max_words]
    if not tried:
        tried = [F.array().cast("array<string>")]
    found = spelled.select(key, F.explode(F.array_distinct(F.array_compact(F.concat(*tried)))).alias("name"))
    return found.join(vocabulary.select("name", "skill_type").distinct(), "name").select(
        key, "name", "skill_type"
    )


def skill_lists(found: DataFrame, key: str) -> DataFrame:
    """Sorted skill lists per posting, from the rows of ``extract_skills``."""

    def listed(kind: str) -> Column:
        names = F.collect_set(F.when(F.col("skill_type") == kind, F.col("name")))
        return F.array_sort(names).alias(f"{kind}_skills")

    return found.groupBy(key).agg(listed("tech"), listed("soft"), listed("domain"))


def extract_fields(
    postings: DataFrame, key: str, text: str, place: str, vocabulary: DataFrame
) -> DataFrame:
    """The default record of a posting: skills, place, work mode and pay, read by rules.

    One row per key with ``key`` and the enriched columns. Only the skill phrases leave their row.
    """
    slim = postings.select(key, F.col(text).alias("_text"), F.col(place).alias("_place"))
    moded = slim.withColumn("work_mode", extract_work_mode(F.col("_text")))
    rows = extract_place(extract_salary(moded, "_text").drop("_text"), "_place").drop("_place")
    lists = skill_lists(extract_skills(slim, key, "_text", vocabulary), key)
    names = ("tech_skills", "soft_skills", "domain_skills")
    none = F.array().cast("array<string>")
    joined = rows.join(lists, key, "left")
    return joined.select(
        key, *(F.coalesce(n, none).alias(n) for n in names), "city", "country", "country_code",
        "work_mode", "salary_min", "salary_max", "salary_currency", "salary_period",
    )


Extractor = Callable[[pd.DataFrame], list[tuple[str | None, str | None]]]


def run_extractor(postings: DataFrame, key: str, make: Callable[[], Extractor]) -> DataFrame:
    """Run a plugged-in extractor: (key, raw_response, error), one row per posting.

    ``make`` builds the extractor once per Python worker. It is given a batch with
    title, description and search_keyword and returns a JSON text or an error for
    every row. When a batch fails, its rows are tried one by one, so only the rows
    at fault report an error.
    """

    def one_by_one(extract: Extractor, batch: pd.DataFrame) -> list[tuple[str | None, str | None]]:
        out = []
        for i in range(len(batch)):
            try:
                out.extend(extract(batch.iloc[i : i + 1]))
            except Exception as problem:  # the row is counted, the job goes on
                out.append((None, f"{type(problem).__name__}: {problem}"))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make()
        for batch in batches:
            try:
                results = extract(batch)
            except Exception:
                results = one_by_one(extract, batch)
            frame = pd.DataFrame(results, columns=["raw_response", "error"])
            frame.insert(0, key, batch[key].to_numpy())
            yield frame

    columns = postings.select(key, "title", "description", "search_keyword")
    return columns.mapInPandas(run, f"{key} string, raw_response string, error string")
