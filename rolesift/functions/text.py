"""Text functions: tokens, overlap, the title rule, slugs, search phrases, places."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesift.constants import (
    ASCII_PUNCTUATION,
    BOARD_COUNTRIES,
    BOARD_COUNTRY_ALIASES,
    MODEL_INPUT_CHARS,
    RULE_ACCEPT_AT,
    RULE_REVIEW_AT,
    STOPWORDS,
    WHITESPACE,
)
from rolesift.functions.keys import norm, strip


def words(text: Column) -> Column:
    """Lower-case words in text order, ASCII punctuation deleted, stopwords kept.

    One ``translate`` turns all white space into blanks and deletes punctuation, so
    the split needs no pattern.
    """
    blanks = " " * len(WHITESPACE)
    bare = F.translate(F.lower(text), WHITESPACE + ASCII_PUNCTUATION, blanks)
    return F.array_remove(F.split(bare, " "), "")


def tokenize(text: Column) -> Column:
    """Distinct words without stopwords."""
    return F.array_except(words(text), F.array(*(F.lit(w) for w in STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token sets, 0 when one is empty."""
    sizes = F.size(a) * F.size(b)
    return F.when(sizes == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.sqrt(sizes.cast("double"))
    )


def overlap_reason(score: Column) -> Column:
    return F.format_string("title_overlap=%.2f", F.bround(score, 2))


def title_score(title: Column, keyword: Column) -> Column:
    """Token overlap of title and keyword; NULL when the rule cannot compare them."""
    title_tokens, keyword_tokens = tokenize(title), tokenize(F.coalesce(keyword, F.lit("")))
    comparable = F.coalesce(title != "", F.lit(False)) & (F.size(keyword_tokens) > 0)
    return F.when(comparable, jaccard(title_tokens, keyword_tokens))


def rule_verdict(score: Column, blocked: Column) -> Column:
    """Verdict of the title rule from ``title_score`` and the blocklist flag."""
    return (
        F.when(blocked, "reject")
        .when(score.isNull(), "review")
        .when(score >= RULE_ACCEPT_AT, "accept")
        .when(score >= RULE_REVIEW_AT, "review")
        .otherwise("reject")
    )


def rule_reason(score: Column, blocked: Column) -> Column:
    return F.when(blocked, "user_blocked").otherwise(
        overlap_reason(F.coalesce(score, F.lit(0.0)))
    )


def quote_keyword(keyword: Column) -> Column:
    """A phrase of several words in double quotes."""
    bare = strip(keyword)
    return F.when(bare.contains(" "), F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(bare)


def country_from_location(location: Column) -> Column:
    """Country a board can be asked for, read from the last comma part of a place."""
    names = {name: name.replace(" ", "") for name in BOARD_COUNTRIES}
    names.update(BOARD_COUNTRY_ALIASES)
    lookup = F.create_map(*(F.lit(v) for v in chain.from_iterable(names.items())))
    tail = norm(F.element_at(F.split(location, ","), -1))
    return F.try_element_at(lookup, tail)


def slugify(name: Column) -> Column:
    """URL-safe id; NULL where nothing alphanumeric is left."""
    dashed = F.regexp_replace(norm(name), "[^a-z0-9]+", "-")
    return F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit(""))


def parse_lines(text: Column) -> Column:
    """Non-blank stripped lines of a text."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    return F.filter(F.transform(lines, strip), lambda line: line != "")


def relevance_doc(title: Column, description: Column, max_chars: int | None = None) -> Column:
    """Text a scorer compares with the keyword: title, then the description.

    The whole description is used unless a model with a bounded input asks for
    its first ``max_chars`` characters (``MODEL_INPUT_CHARS`` for the usual ones).
    """
    body = F.coalesce(description, F.lit(""))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    body, head = strip(body), F.coalesce(title, F.lit(""))
    return F.when(body == "", head).otherwise(F.concat(head, F.lit(". "), body))


def model_input(title: Column, description: Column) -> Column:
    return relevance_doc(title, description, MODEL_INPUT_CHARS)


def extraction_input(title: Column, description: Column, keyword: Column) -> Column:
    """One posting as the message an extractor reads."""

    def filled(x: Column, default: str) -> Column:
        return F.coalesce(F.nullif(strip(x), F.lit("")), F.lit(default))

    intent = F.when(
        F.coalesce(keyword, F.lit("")) != "",
        F.concat(F.lit("Search intent: "), keyword, F.lit("\n\n")),
    ).otherwise("")
    return F.concat(
        intent,
        F.lit("Job title: "),
        filled(title, "(untitled)"),
        F.lit("\n\nJob description:\n"),
        filled(description, "(no description)"),
    )
