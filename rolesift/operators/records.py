"""Raw extraction records (JSON text) checked and brought to the enriched form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import normalize as N
from rolesift.functions.keys import norm

_LISTS = ("tech_skills", "soft_skills", "domain_skills")
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT", "BOOLEAN")
# Texts and numbers a lenient boolean field accepts.
_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")


# Every part of a record that is read, by its path.
_PATHS = (
    *(f"$.{name}" for name in _LISTS),
    "$.location", "$.location.city", "$.location.country", "$.location.country_code",
    "$.salary", "$.salary.min_amount", "$.salary.max_amount", "$.salary.currency",
    "$.salary.period", "$.work_mode", "$.is_relevant", "$.relevance_confidence",
    "$.relevance_reason",
)


def _name(prefix: str, path: str) -> str:
    return prefix + path[2:].replace(".", "_")


def _type(part: Column) -> Column:
    """JSON type of a part; ABSENT where the record has no such field."""
    return F.coalesce(F.schema_of_variant(part), F.lit("ABSENT"))


def _with_parts(raw: DataFrame, column: str) -> DataFrame:
    """Parse the text once, take each part once, name each part's type once."""
    parsed = raw.withColumn("_v", F.try_parse_json(column))
    parts = parsed.withColumns(
        {_name("_p_", path): F.try_variant_get("_v", path, "variant") for path in _PATHS}
    )
    return parts.withColumns(
        {_name("_k_", path): _type(F.col(_name("_p_", path))) for path in _PATHS}
    )


def _kind(path: str) -> Column:
    return F.col(_name("_k_", path))


def _read(path: str, kind: str) -> Column:
    return F.try_variant_get(_name("_p_", path), "$", kind)


def _text(path: str) -> Column:
    """The text at a path, NULL for any other JSON type."""
    return F.when(_kind(path) == "STRING", _read(path, "string"))


def _number(path: str) -> Column:
    return _read(path, "double")


def _is_number(path: str) -> Column:
    kind = _kind(path)
    numeric = F.lit(False)
    for name in _NUMBERS:
        numeric = numeric | kind.startswith(name)
    return numeric | ((kind == "STRING") & _number(path).isNotNull())


def _list_ok(path: str) -> Column:
    kind = _kind(path)
    items = _read(path, "array<variant>")
    stray = F.exists(items, lambda x: ~_type(x).isin("STRING", "VOID", "ABSENT"))
    is_list = kind.startswith("ARRAY") & ~F.coalesce(stray, F.lit(False))
    return kind.isin("ABSENT", "VOID") | is_list


def _object_ok(path: str) -> Column:
    kind = _kind(path)
    sentinel = (kind == "STRING") & N.is_empty_sentinel(_text(path))
    return kind.isin("ABSENT", "VOID") | kind.startswith("OBJECT") | sentinel


def _optional_text_ok(path: str) -> Column:
    return _kind(path).isin("ABSENT", "VOID", "STRING")


def _optional_number_ok(path: str) -> Column:
    return _kind(path).isin("ABSENT", "VOID") | _is_number(path)


def _skills(path: str) -> Column:
    return N.clean_skills(_read(path, "array<string>"))


def _relevant_text() -> Column:
    return norm(_read("$.is_relevant", "string"))


def parse_records(raw: DataFrame, column: str = "raw_response") -> DataFrame:
    """Add the normalised fields and ``valid`` to rows that carry a JSON record.

    Malformed values of known fields become NULL; a wrong type, an unknown
    sub-object text or a confidence outside [0, 1] makes the record invalid.
    """
    parsed = _with_parts(raw, column)
    confidence = F.when(
        _kind("$.relevance_confidence") == "ABSENT", F.lit(1.0)
    ).otherwise(_number("$.relevance_confidence"))
    confidence_ok = F.when(
        _kind("$.relevance_confidence") == "ABSENT", F.lit(True)
    ).otherwise(_is_number("$.relevance_confidence") & confidence.between(0.0, 1.0))
    relevant = F.when(_kind("$.is_relevant") == "ABSENT", F.lit(True)).otherwise(
        F.when(_relevant_text().isin(*_TRUE), True).when(_relevant_text().isin(*_FALSE), False)
    )
    valid = _type(F.col("_v")).startswith("OBJECT")
    for name in _LISTS:
        valid = valid & _list_ok(f"$.{name}")
    for name in ("location", "salary"):
        valid = valid & _object_ok(f"$.{name}")
    for path in ("$.location.city", "$.location.country", "$.relevance_reason"):
        valid = valid & _optional_text_ok(path)
    for path in ("$.salary.min_amount", "$.salary.max_amount"):
        valid = valid & _optional_number_ok(path)
    valid = valid & relevant.isNotNull() & F.coalesce(confidence_ok, F.lit(False))
    return parsed.select(
        *raw.columns,
        *[_skills(f"$.{name}").alias(name) for name in _LISTS],
        N.strip_or_null(_text("$.location.city")).alias("city"),
        N.strip_or_null(_text("$.location.country")).alias("country"),
        N.country_code(_text("$.location.country_code")).alias("country_code"),
        N.work_mode(_text("$.work_mode")).alias("work_mode"),
        _number("$.salary.min_amount").alias("salary_min"),
        _number("$.salary.max_amount").alias("salary_max"),
        N.currency(_text("$.salary.currency")).alias("salary_currency"),
        N.period(_text("$.salary.period")).alias("salary_period"),
        relevant.alias("is_relevant"),
        confidence.alias("relevance_confidence"),
        _text("$.relevance_reason").alias("relevance_reason"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


def normalize_records(raw: DataFrame, column: str = "raw_response") -> DataFrame:
    return parse_records(raw, column).filter("valid").drop("valid")


def invalid_records(raw: DataFrame, column: str = "raw_response") -> DataFrame:
    return parse_records(raw, column).filter("not valid").select(*raw.columns)
