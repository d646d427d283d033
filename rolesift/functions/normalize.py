"""Normal forms of extracted values; anything malformed becomes NULL."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.constants import (
    ALL_SITES,
    DEFAULT_SITES,
    EMPTY_SENTINELS,
    FEWSHOT_THRESHOLD,
    PAIR_THRESHOLD,
    SALARY_PERIODS,
    SEMANTIC_THRESHOLD,
    WORK_MODE_ALIASES,
    WORK_MODES,
)
from rolesift.functions.keys import norm, strip


def strip_or_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def _letters(x: Column, n: int) -> Column:
    code = F.upper(strip(x))
    return F.when(code.rlike(f"^\\p{{L}}{{{n}}}$"), code)


def country_code(x: Column) -> Column:
    return _letters(x, 2)


def currency(x: Column) -> Column:
    return _letters(x, 3)


def period(x: Column) -> Column:
    return F.when(norm(x).isin(*SALARY_PERIODS), norm(x))


def work_mode(x: Column) -> Column:
    aliases = F.create_map(*(F.lit(v) for v in chain.from_iterable(WORK_MODE_ALIASES.items())))
    mode = F.coalesce(F.try_element_at(aliases, norm(x)), norm(x))
    return F.when(mode.isin(*WORK_MODES), mode)


def is_empty_sentinel(x: Column) -> Column:
    """True for NULL and for the texts that stand for "no data"."""
    return x.isNull() | norm(x).isin(*EMPTY_SENTINELS)


def clean_skills(skills: Column) -> Column:
    """Lower-case distinct skills in first-seen order, blanks and NULLs dropped."""
    names = F.transform(F.filter(skills, lambda s: s.isNotNull()), norm)
    return F.coalesce(F.array_distinct(F.filter(names, lambda s: s != "")), empty_list())


def empty_list() -> Column:
    return F.array().cast("array<string>")


def parse_list(raw: Column) -> Column:
    """A JSON array of texts; anything else gives an empty list, NULL elements are dropped."""
    items = F.from_json(raw, "array<string>")
    return F.coalesce(F.filter(items, lambda s: s.isNotNull()), empty_list())


def coerce_list(raw: Column) -> Column:
    """Like ``parse_list``, but text that is no array becomes a one-element list."""
    text = strip(raw)
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", empty_list())
        .when(parsed.isNull(), F.array(text))
        .when(kind.startswith("ARRAY"), parse_list(text))
        .otherwise(F.array(F.coalesce(F.try_variant_get(parsed, "$", "string"), text)))
    )


def clean_names(names: Column) -> Column:
    """Stripped non-blank entries in order (keywords and locations of a profile)."""
    return F.filter(F.transform(names, strip), lambda s: s != "")


def clean_sites(sites: Column) -> Column:
    """The known boards of a list, or the default boards when none is known."""
    known = F.filter(sites, lambda s: s.isin(*ALL_SITES))
    default = F.array(*(F.lit(s) for s in DEFAULT_SITES))
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, known).otherwise(default)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ensemble_verdict(
    rule: Column, semantic: Column, pair: Column, fewshot: Column, is_relevant: Column
) -> Column:
    """Any stage can veto; a row that passes all of them follows the extractor's judgement.

    A scorer that did not run (NULL) passes the row.
    """
    vetoed = (
        (F.coalesce(rule, F.lit("")) == "reject")
        | (F.coalesce(semantic, F.lit(1.0)) < SEMANTIC_THRESHOLD)
        | (F.coalesce(pair, F.lit(0.0)) < PAIR_THRESHOLD)
        | (F.coalesce(fewshot, F.lit(1.0)) < FEWSHOT_THRESHOLD)
    )
    relevant = F.coalesce(is_relevant, F.lit(False))
    return F.when(~vetoed & relevant, "accept").otherwise("reject")
