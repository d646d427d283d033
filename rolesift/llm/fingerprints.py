"""MinHash fingerprints of documents: likeness of any two, and verified links of near copies by bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm import shingles as S
from rolesift.llm.common import SHINGLE_WORDS, SIMILAR_AT, slices, text_key, word_form, written
from rolesift.llm.ngram_join import DESCRIBED, describe, linked_rows

#: Hash functions; each value is kept to 16 bits, so a fingerprint has 512 hex digits.
HASHES = 128
RECALL = 0.998
#: Ranges of doc_id for each shuffle partition.
RANGES = 4

def signature_of(forms: pa.Array, n_words: int = SHINGLE_WORDS) -> np.ndarray:
    """128 values of 16 bits a text: the low bits of the least hashes, as the high ones of a minimum are few."""
    flat, offsets = S.shingle_hashes(forms, n_words)
    return S.signatures(flat, offsets, *S.permutations(HASHES)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values, an estimate of the Jaccard similarity of the shingle sets."""
    return (a == b).mean(axis=1)


def _hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, tail, doc_id, text) in order; the row after each one is the next document."""
    held: list[tuple] = []
    for batch in slices(batches, 3, 2 << 20):
        rows = held + list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
        own = [k for k in range(len(rows) - 1) if not rows[k][1]]
        held = rows[-1:]
        if not own:
            continue
        texts = [r[3] for r in rows]
        edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
        plain = signature_of(pa.array([S.words_of(t) for t in texts], pa.large_string()))
        changed = signature_of(pa.array([S.words_of(t) for t in edited], pa.large_string()))
        at = np.array(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(_hex(plain[at])), pa.array(_hex(changed)),
                pa.array(likeness(plain[at], changed)), pa.array(likeness(plain[at], plain[at + 1])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many of the next
    document in descending doc_id (after the last: the first).

    Plan: doc_id alone is read for the bounds of ranges and for the first document of each; every document is
    shuffled once to its range, the first ones also to the range before, and each range is walked in order.

    Cases: null text reads as empty; texts without words share one fingerprint; rows with one doc_id follow each
    other by text; null doc_ids come last; a single document is its own next one. No rows give no rows.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    marks = [k / ranges for k in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", marks, 20 * ranges).alias("bounds")).first()[0]
    bounds = F.array(*(F.lit(b).cast("long") for b in sorted(set(found or ()))))
    # ranges in descending order; null doc_ids belong to the last one
    part = F.coalesce(F.size(F.filter(bounds, lambda b: b >= F.col("doc_id"))), F.size(bounds)).cast("int")
    firsts = sorted(
        ids.withColumn("part", part).groupBy("part").agg(F.max("doc_id").alias("first_id")).collect(), key=lambda r: r["part"]
    )
    before = [(firsts[k]["first_id"], firsts[k - 1]["part"]) for k in range(len(firsts))]
    heads = F.broadcast(spark.createDataFrame(before, "first_id long, earlier int"))  # a row a range
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", part)
    places = F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")),
        F.struct(F.col("earlier").alias("part"), F.lit(True).alias("tail")),
    )
    dealt = (
        texts.join(heads, F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
        .select("doc_id", "text", F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("place"))
        .select("place.part", "place.tail", "doc_id", "text")
        .repartition("part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text")
    )
    return dealt.mapInArrow(
        _edited,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def near_links(docs: DataFrame, similarity: float = SIMILAR_AT, n_words: int = SHINGLE_WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, text) to doc_id, leader_id, jaccard, class_id, n_links: a row for each document that has a link.

    Two documents are linked when the Jaccard similarity of their full shingle sets reaches ``similarity``;
    candidates are all pairs whose fingerprints share a band (found with probability ``recall`` at the threshold, more
    above it). Equal sets collapse, the others of a bucket are compared with each other in bounded blocks as in
    ``ngram_join``, so no link of a bucket is lost and a bucket gives a row a member, never its pairs.

    ``n_links`` counts the linked documents; ``class_id`` is the least doc_id of the connected class; ``leader_id`` is the
    least doc_id among the document and those linked to it, ``jaccard`` the similarity to that one.

    Cases: texts without words and rows without doc_id have no link. Repeated rows are copies of each other, each
    gives a row. No rows give no rows.
    """
    bands, rows = S.choose_bands(similarity, recall, HASHES)
    a, b = S.permutations(HASHES)
    sign = lambda flat, offsets: S.signatures(flat, offsets, a, b).astype(np.uint16).astype(np.uint32)
    known = docs.filter(F.col("doc_id").isNotNull())
    described = written(
        known.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), word_form(F.col("text")).alias("form"))
        .mapInArrow(describe(n_words, bands, rows, sign), DESCRIBED)
        .filter("n_grams > 0").withColumn("row_id", F.monotonically_increasing_id()),
        "fingerprint-bands",
    )
    linked = linked_rows(known, described, similarity, n_words, lead=True)
    return linked.filter("n_links > 0").select("doc_id", "leader_id", "jaccard", "class_id", "n_links")
