"""Personal data: exact patterns, and the terms around them that give them away.

A term discloses a protected value (an address, a number) as far as seeing it tells of the value:
the pointwise mutual information of both over the corpus, as a share of the value's own
information content. Terms above a threshold are generalised, above a higher one removed, if
chance does not explain that both meet so often.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm import shingles as S
from rolesift.llm.common import BROADCAST_BYTES, bounded_side, slices, text_key, word_form, written
from rolesift.llm.ngram_join import near_classes

# fixed values: the kinds and their patterns
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W_]+")

#: Disclosure (0 to 1) from which a term is generalised, and from which it is removed.
GENERALISE_AT = 0.5
REMOVE_AT = 0.8
#: A pair counts when so many families of documents have it; documents made from one text are one family.
LEAST_FAMILIES = 3
#: Documents with a value are made from one text from this Jaccard similarity on: with equal lengths, half of one is in the other.
#: The test against chance needs independent witnesses, and two edited copies of one text are none, however far below 0.8 they are.
ONE_TEXT_AT = 1 / 3
#: Over all pairs together, the probability that chance alone brings one pair together so often.
BY_CHANCE = 0.01
LEAST_LETTERS = 3
ADDED = ("generalise", "remove")
#: Told terms go to every task while they are measured below this; beyond it the texts are joined to their hits.
TOLD_BYTES = 16 << 20
_TERM_BYTES = 120
_TAGS = {k: f"[{k.upper()}]" for k in KINDS} | {"generalise": "[TERM]", "remove": ""}
_SPAN = "struct<start: int, rank: int, kind: string, end: int>"


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(KINDS[kind], a, b) for a, kind, b in sorted(found)]


def _value(kind: str, raw: str) -> str:
    return f"{kind}:{raw.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', raw)}"


def _own_terms(lowered: str) -> list[str]:
    """Mostly the word itself; lowering may have put a mark into it."""
    return [lowered] if lowered.isalnum() else S.words_of(lowered).split()


def _outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[list[str], int, int]]:
    """The words of a text that lie outside all spans: their terms (mostly one) and place."""
    ordered, k, covered = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while k < len(ordered) and ordered[k][0] < end:
            covered = max(covered, ordered[k][1])
            k += 1
        if covered <= start:
            yield _own_terms(m.group().lower()), start, end


def _terms(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    return sorted({t for terms, _, _ in _outside(text, spans) for t in terms if len(t) >= LEAST_LETTERS})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_BASE = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        texts = batch.column(2).to_pylist()
        spans = [base_spans(t) for t in texts]
        counts = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in KINDS]
        base = [[{"start": a, "rank": KINDS.index(k), "kind": k, "end": b} for k, a, b in s] for s in spans]
        digest = [hashlib.sha256(joined(s).encode()).hexdigest() for s in spans]
        values = [sorted({_value(k, t[a:b]) for k, a, b in s}) for s, t in zip(spans, texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), *counts, pa.array(digest), pa.array(base, pa.list_(_BASE)),
                pa.array([_terms(t, s) if s else [] for t, s in zip(texts, spans, strict=True)], pa.list_(pa.string())),
                pa.array(values, pa.list_(pa.string())), pa.array([t if s else None for t, s in zip(texts, spans, strict=True)], pa.string()),
            ],
            ["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "terms", "values", "text"],
        )


_FOUND = (
    "doc_id long, text_key string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    f"base array<{_SPAN}>, terms array<string>, values array<string>, text string"
)


def _search(docs: DataFrame) -> DataFrame:
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    return written(texts.mapInArrow(_find, _FOUND).withColumn("node", F.monotonically_increasing_id()), "pii-found")


def _spelled(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(word_form(text), " "), ""))


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise_at: float, remove_at: float) -> DataFrame:
    """value, term, action, disclosure of the pairs above the threshold.

    All frequencies count families: documents with a value that ``near_classes`` links at ``ONE_TEXT_AT`` (verified links)
    are one family, every other document is its own. p(v) of a value, p(t) of a term, p(v, t) of both in one family, wherever they
    stand. disclosure = log2(p(v, t) / (p(v) p(t))) / -log2 p(v): 1 when the term is only seen with the value.

    A pair has to be seen in ``LEAST_FAMILIES`` families, and in more of the value's families than chance gives: the
    Chernoff bound of that, times the number of pairs, has to stay below ``BY_CHANCE``.

    Both never meet oftener than the value occurs, so a term of more than ``n(v) ^ g * N ^ (1 - g)`` families cannot reach
    the disclosure g: terms are counted once and such terms never meet values. Nor can a term that stands beside judged
    values in fewer than ``LEAST_FAMILIES`` families; while the others are few, they alone are counted over the corpus.
    """
    total = found.count()
    valued = found.filter(F.size("values") > 0)
    classes = near_classes(valued.select(F.col("node").alias("doc_id"), "text"), ONE_TEXT_AT).select(F.col("doc_id").alias("node"), F.col("class_id").alias("family"))
    grouped = written(valued.select("node", "values", "terms").join(classes, "node"), "pii-families")
    families = total - grouped.count() + grouped.select("family").distinct().count()
    judged = written(
        grouped.select(F.explode("values").alias("value"), "family").distinct()
        .groupBy("value").agg(F.count(F.lit(1)).alias("n_value")).filter(F.col("n_value") >= LEAST_FAMILIES),
        "pii-judged",
    )
    most = judged.agg(F.max("n_value")).first()[0]
    if most is None:
        return judged.select("value", F.lit("").alias("term"), F.lit("").alias("action"), F.lit(0.0).alias("disclosure"))
    bound = lambda n: F.pow(n, F.lit(generalise_at)) * F.lit(float(families) ** (1 - generalise_at)) + 1e-6
    held = (
        grouped.select("node", F.explode("values").alias("value")).join(bounded_side(judged, F.length("value") + 32), "value")
        .groupBy("node").agg(F.collect_list(F.struct("value", "n_value")).alias("held"))
    )
    beside = written(grouped.join(held, "node").select("family", "terms", "held"), "pii-beside")
    # only terms that stand beside judged values in enough families can be told on; few of them: counted alone
    wanted = written(
        beside.select("family", F.explode("terms").alias("term")).distinct()
        .groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FAMILIES).select("term"),
        "pii-wanted",
    )
    few = (wanted.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    only = lambda words: words.join(F.broadcast(wanted), "term", "left_semi") if few else words
    every = (
        only(docs.select(F.explode(_spelled(F.col("text"))).alias("term")).filter(F.length("term") >= LEAST_LETTERS))
        .groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    )
    # documents of one family count once; a family of one has nothing to take off
    several = written(grouped.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("family"), "pii-several")
    again = (
        only(grouped.join(bounded_side(several, 16), "family").select(F.explode("terms").alias("term"), "family"))
        .groupBy("term", "family").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1").groupBy("term").agg(F.sum(F.col("n") - 1).alias("again"))
    )
    terms = written(
        every.join(again, "term", "left").select("term", (F.col("n") - F.coalesce("again", F.lit(0))).alias("n_term"))
        .filter((F.col("n_term") >= LEAST_FAMILIES) & (F.col("n_term") <= bound(F.lit(float(most))))),
        "pii-terms",
    )
    near = (
        beside.select("family", "held", F.explode("terms").alias("term")).join(bounded_side(terms, F.length("term") + 32), "term")
        .select("family", "term", "n_term", F.explode("held").alias("v")).select("family", "term", "n_term", "v.value", "v.n_value")
        .filter(F.col("n_term") <= bound(F.col("n_value")))
    )
    pairs = written(
        near.distinct().groupBy("value", "term", "n_value", "n_term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= LEAST_FAMILIES),
        "pii-pairs",
    )
    tried = pairs.count()
    share = lambda c: F.col(c) / F.lit(float(max(families, 1)))
    content = -F.log2(share("n_value"))
    mutual = F.log2(share("n_both") / (share("n_value") * share("n_term")))
    disclosure = F.when(content > 0, F.least(mutual / content, F.lit(1.0))).otherwise(0.0)
    seen, expected = F.col("n_both") / F.col("n_value"), share("n_term")
    rest = F.when(seen < 1, (1 - seen) * F.log((1 - seen) / (1 - expected))).otherwise(0.0)
    surprise = F.when(seen > expected, F.col("n_value") * (seen * F.log(seen / expected) + rest)).otherwise(0.0)
    told = pairs.withColumn("disclosure", disclosure).filter((F.col("disclosure") >= generalise_at) & (surprise >= math.log(max(tried, 1) / BY_CHANCE)))
    action = F.when(F.col("disclosure") >= remove_at, F.lit(ADDED[1])).otherwise(F.lit(ADDED[0]))
    return written(told.select("value", "term", action.alias("action"), "disclosure"), "pii-disclosing")


def _placed(text: str, ranks: dict[str, int]) -> list[dict]:
    """The places of told terms in a text, outside its base spans, which are looked for only then."""
    found = []
    for m in _WORD.finditer(text):
        lowered = m.group().lower()
        rank = ranks.get(lowered)
        if rank is None and not lowered.isalnum():
            rank = max((ranks[t] for t in _own_terms(lowered) if t in ranks), default=None)
        if rank is not None:
            found.append((*m.span(), rank))
    own, k, covered = [], 0, 0
    spans = sorted((a, b) for _, a, b in base_spans(text)) if found else []
    for start, end, rank in found:
        while k < len(spans) and spans[k][0] < end:
            covered = max(covered, spans[k][1])
            k += 1
        if covered <= start:
            own.append({"start": start, "rank": rank, "kind": ADDED[rank - len(KINDS)], "end": end})
    return own


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        added = [_placed(text, {h["term"]: h["rank"] for h in hits}) for text, hits in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(added, pa.list_(_BASE))], ["text_key", "added"])


def _place_all(told):
    """The same for every text of a batch, with all told terms at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = told.value
        known = pa.array(list(ranks), pa.large_string())
        for batch in slices(batches, 1):
            words = pc.split_pattern(batch.column(2), " ")
            hit = pc.is_in(words.flatten(), value_set=known).to_numpy(zero_copy_only=False)
            bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
            hits = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(hit)))[bounds]))
            part = batch.take(pa.array(hits))
            added = [_placed(text, ranks) for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(added, pa.list_(_BASE))], ["text_key", "added"])

    return run


def _added_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """text_key and the spans that the method adds to that text: every place of a term that is told on."""
    schema = f"text_key string, added array<{_SPAN}>"
    if told.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    # a term may be told on with several values; the stronger action holds
    rank = F.lit(len(KINDS)) + (F.col("action") == ADDED[1]).cast("int")
    terms = written(told.groupBy("term").agg(F.max(rank).alias("rank")), "pii-told")
    texts = docs.filter(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("text_key"), "text")
    if (terms.agg(F.sum(F.octet_length("term") + _TERM_BYTES)).first()[0] or 0) <= TOLD_BYTES:
        # few terms go to the texts, and no text moves
        held = docs.sparkSession.sparkContext.broadcast({r["term"]: r["rank"] for r in terms.collect()})
        placed = texts.withColumn("form", F.concat(F.lit(" "), word_form(F.col("text")))).mapInArrow(_place_all(held), schema)
        return written(placed.groupBy("text_key").agg(F.first("added").alias("added")), "pii-added")
    hits = written(
        docs.select(text_key(F.col("text")).alias("text_key"), F.explode(_spelled(F.col("text"))).alias("term"))
        .join(bounded_side(terms, F.length("term") + 32), "term")
        .groupBy("text_key").agg(F.collect_set(F.struct("term", "rank")).alias("hits")),
        "pii-hits",
    )
    placed = texts.join(bounded_side(hits, 64 + 32 * F.size("hits")), "text_key").select("text_key", "text", "hits").mapInArrow(_place, schema)
    return written(placed.groupBy("text_key").agg(F.first("added").alias("added")), "pii-added")


def find_spans(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(doc_id, text) to a row a document: doc_id, text_key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans follow the fixed patterns, leftmost and without overlap in each kind; the disclosing terms of the
    corpus are added wherever they occur as ``generalise`` and ``remove``. ``spans`` joins kind:start:end, by start, then kind.

    Plan: texts are read twice, and once more when a term is told on; counts of pairs and terms are shuffled, texts only
    when the terms told on are too many to send to every task. Spans found are joined back
    by the key of the text. Cases: null reads as empty and has no span; equal texts have equal spans; a null doc_id is
    kept; repeated rows each give a row. No rows give no rows.
    """
    found = _search(docs)
    added = _added_spans(docs, disclosing_terms(docs, found, generalise_at, remove_at))
    both = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))
    text = F.transform(both, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return found.join(bounded_side(added, 96 + 48 * F.size("added")), "text_key", "left").select(
        "doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", F.array_join(text, ",").alias("spans")
    )


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its tag; a span that begins inside another is covered by it."""
    out, at, covered = [], 0, 0
    for start, end, kind in sorted(spans):
        if start >= covered:
            out += [text[at:start], _TAGS[kind]]
        covered = at = max(covered, end)
    return "".join((*out, text[at:]))


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """The documents with personal data replaced by tags, disclosing terms by ``[TERM]`` or nothing.

    All columns stay; ``n_chars``, where there is one, follows the new text. Null texts stay null.
    """
    found = _search(docs)
    added = _added_spans(docs, disclosing_terms(docs, found, generalise_at, remove_at))
    names = docs.columns
    keyed = docs.select("text", F.struct(*names).alias("_row"), text_key(F.col("text")).alias("text_key"))
    spanned = keyed.join(bounded_side(added, 96 + 48 * F.size("added")), "text_key", "left").select("_row", "text", "added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            clean = []
            for text, extra in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is not None:
                    spans = [(a, b, k) for k, a, b in base_spans(text)] + [(s["start"], s["end"], s["kind"]) for s in extra or ()]
                    text = _replaced(text, spans) if spans else text
                clean.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], ["_row", "_clean"])

    out = spanned.mapInArrow(run, spanned.select("_row").schema.add("_clean", "string"))
    kinds = dict(docs.dtypes)
    own = {"text": F.col("_clean")}
    if "n_chars" in kinds:
        own["n_chars"] = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(kinds["n_chars"])).otherwise(F.col("_row.n_chars"))
    return out.select(*(own.get(c, F.col("_row")[c]).alias(c) for c in names))
