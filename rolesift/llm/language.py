"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.llm.common import slices, written
from rolesift.operators.marts import weighted_percentiles

UNKNOWN = "und"
#: Length of a profile, longest n-gram, and how many languages a label column may hold.
PROFILE = 300
LONGEST = 3
LANGUAGES = 1000
#: Texts whose best language scores less are rejected by the filter.
LEAST_SCORE = 0.05
#: Learned least scores: the quantile of the score of the true language, what share of it is asked for, and the
#: lengths in letters and blanks at which labelled texts are cut and scored; fewer cut texts than that teach nothing.
LEAST_QUANTILE = 0.001
LEAST_SHARE = 0.75
LENGTHS = tuple(1 << k for k in range(4, 13))
LEAST_TEXTS = 20

_CHAR_BITS = 21
_SPACE = np.uint64(32)


def letter_form(text: Column) -> Column:
    """Lower-case words of letters, a blank before and after each; without letters: empty."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{M}]+", " ")
    return F.when(spaced.rlike(r"\p{L}"), spaced).otherwise("")


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of one text as packed code points; blanks only at the ends of an n-gram."""
    letter = codes != _SPACE
    found, packed, inside = [codes[letter]], codes, letter
    for n in range(2, min(LONGEST, len(codes)) + 1):
        packed = (packed[:-1] << np.uint64(_CHAR_BITS)) | codes[n - 1 :]
        if n > 2:
            inside = letter[1:-1] if n == 3 else inside[:-1] & letter[n - 2 : -1]
        found.append(packed[letter[:-1] | letter[1:] if n == 2 else inside])
    return np.concatenate(found)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def ranked(text: str, length: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text in rank order; ties by n-gram."""
    grams, counts = np.unique(_grams(_code_points(text)), return_counts=True)
    if len(grams) > length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        kept = counts >= least
        grams, counts = grams[kept], counts[kept]
    return grams[np.argsort(-counts, kind="stable")][:length]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, 1 << 20):
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            # each text begins and ends with a blank, so joined texts make no new n-gram
            grams, counts = np.unique(_grams(_code_points("".join(texts[i] for i in np.flatnonzero(langs == lang)))), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())],
                ["lang", "gram", "n"],
            )


def _labelled(labelled: DataFrame) -> DataFrame | None:
    """lang and letter form of every labelled text; None without any."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if found > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels: not a language column")
    return rows.select("lang", letter_form(F.col("text")).alias("form")) if found else None


def learn_profiles(labelled: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """(text, lang) to the n-gram profile of each language, most frequent first.

    N-grams are counted over all documents; batches and tasks count first, so the shuffle moves a row for each
    language and n-gram of a task. Rows without a label or text are left out.
    The result has ``profile`` numbers a language and at most ``LANGUAGES`` languages; more raise.
    """
    every = _labelled(labelled)
    if every is None:
        return {}
    grams = every.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile)
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """Out-of-place distances of texts to learned profiles."""

    def __init__(self, profiles: dict[str, list[int]], length: int = PROFILE):
        self.langs = sorted(profiles)
        self.length = length
        own = [np.array(profiles[lang], dtype=np.int64).view(np.uint64) for lang in self.langs]
        self.grams = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for k, grams in enumerate(own):
            self.ranks[k, np.searchsorted(self.grams, grams)] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 - distance / greatest distance."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        grams = ranked(text, self.length)
        if not len(grams):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, grams)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != grams)] = len(self.grams)
        theirs = self.ranks[:, at]
        places = np.where(theirs < 0, self.length, np.abs(theirs - np.arange(len(grams))))
        distance = places.sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.length * len(grams)))


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` (0 to 1) added; same-named columns are replaced.

    A text's most frequent n-grams (1 to 3 letters, words padded with a blank) are ranked; the distance to a
    language sums how far each is from its place there, the profile length where it is missing.
    Only the text is looked at. Cases: null text, no letter, or nothing learned give ``und`` and 0.
    """
    schema = docs.drop("lang_pred", "score")
    form = schema.withColumn("_form", letter_form(F.col("text"))).select("_form", *(schema[c] for c in schema.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    out = schema.schema.add("lang_pred", "string").add("score", "double")
    return form.mapInArrow(run, out)


def learn_least(labelled: DataFrame, profiles: dict[str, list[int]]) -> dict[int, float]:
    """(text, lang) to the least score to ask of a text of so many letters and blanks at least.

    All labelled texts (best those the profiles were not learned from) are cut at each of ``LENGTHS``
    and scored; ``LEAST_SHARE`` of a low quantile of what texts score whose language is found. Equal scores are counted,
    and only those near the quantile are ordered. Lengths with too few texts are left out; at most one number a length.
    """
    every = _labelled(labelled.filter(F.col("lang").isin(sorted(profiles))))
    if every is None:
        return {}
    cut = every.withColumn("size", F.explode(F.array(*(F.lit(n) for n in LENGTHS)))).filter(F.length("form") >= F.col("size"))
    # a cut text ends with a blank, as a whole one does
    text = F.concat(F.rtrim(F.expr("substring(form, 1, size - 1)")), F.lit(" "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for _, s in found], pa.float64())], ["size", "score"])
            yield out.filter(pa.array([f[0] == lang for f, lang in zip(found, batch.column(1).to_pylist(), strict=True)], pa.bool_()))

    scores = cut.select("size", "lang", text.alias("form")).mapInArrow(run, "size int, score double")
    counted = written(scores.groupBy("size", "score").agg(F.count(F.lit(1)).alias("n")), "language-scores")
    totals = counted.groupBy("size").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    low = weighted_percentiles(counted.withColumn("of", F.lit("all")), ["size"], "of", ("all",), "score", "n", {"least": LEAST_QUANTILE})
    return {r["size"]: LEAST_SHARE * r["least_all"] for r in low.join(totals, "size").collect()}


def held_out() -> Column:
    """Documents kept from learning: crc32 of the doc_id as text leaves 2 by 4. A null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], least: float | dict[int, float] = LEAST_SCORE) -> DataFrame:
    """The documents whose language is known with at least that score. Columns stay as they are.

    ``least`` is one score, or those of ``learn_least``: a text is asked for the score of the longest length that it
    reaches, or ``LEAST_SCORE`` when it reaches none.
    """
    rows = docs.select("text", F.struct(*docs.columns).alias("_row"))
    asked = F.lit(LEAST_SCORE if isinstance(least, dict) else least)
    if isinstance(least, dict):
        size = F.length(letter_form(F.col("text")))
        for n in sorted(least):
            asked = F.when(size >= n, F.lit(least[n])).otherwise(asked)
    found = identify(rows.withColumn("_least", asked), profiles)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= F.col("_least"))).select("_row.*")
