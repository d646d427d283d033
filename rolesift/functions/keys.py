"""Deterministic keys and the normal forms they are built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.constants import WHITESPACE, WHITESPACE_CLASS

KEY_CHARS = 24
NOT_BLANK = WHITESPACE_CLASS.replace("[", "[^", 1)


def strip(x: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` removes blanks only)."""
    return F.btrim(x, F.lit(WHITESPACE))


def norm(x: Column) -> Column:
    """Stripped lower-case text, empty for NULL."""
    return F.lower(strip(F.coalesce(x.cast("string"), F.lit(""))))


def title_norm(title: Column) -> Column:
    """The lookup form labels are joined on: blanks trimmed, lower case, NULL kept."""
    return F.lower(F.trim(title))


def amount_text(x: Column) -> Column:
    """A number as key text with a fixed scale, so 1e7 and 10000000 give one key."""
    return F.coalesce(x.try_cast("decimal(30,6)").cast("string"), x.cast("string"))


def stable_key(*parts: Column) -> Column:
    """24 hex characters over the ``|``-joined parts; a NULL part keeps its empty slot."""
    slots = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *slots), 256), 1, KEY_CHARS)


def posting_id(site: Column, job_url: Column) -> Column:
    return stable_key(site, job_url)


def location_key(city: Column, country_code: Column) -> Column:
    return stable_key(norm(city), norm(country_code))


def salary_key(low: Column, high: Column, currency: Column, period: Column) -> Column:
    low, high = (F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in (low, high))
    return stable_key(amount_text(low), amount_text(high), norm(currency), norm(period))


def skill_key(name: Column, skill_type: Column) -> Column:
    return stable_key(name, skill_type)
