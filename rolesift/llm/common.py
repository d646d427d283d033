"""Shared pieces: the word form of a text, document keys, Arrow batches, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.session import shared_folder, tune, written

__all__ = [
    "SHINGLE_WORDS", "SIMILAR_AT", "bounded_side", "documents", "groups", "prepare", "shared_folder",
    "slices", "text_key", "word_form", "written",
]

#: Words in a shingle, and the share of common shingles from which texts count as near copies.
SHINGLE_WORDS = 5
SIMILAR_AT = 0.8

#: A side is broadcast only when rows x bytes a row were counted and stay below this.
BROADCAST_BYTES = 32 << 20

#: Rows handed to Python at once, so that a batch of long texts stays small.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Adaptive settings for skewed keys, and small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def word_form(text: Column) -> Column:
    """Lower-case runs of letters and digits, each followed by one blank; null reads as empty."""
    spaced = F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return F.ltrim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "))


def text_key(text: Column) -> Column:
    """A 128-bit key of the raw text; null reads as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def bounded_side(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size is below the limit; else Spark shuffles both sides.

    ``row_bytes`` is the size of a row of fixed columns, or a column that tells it of each row.
    The frame should be a written one: it is measured here and read again by the join.
    """
    if isinstance(row_bytes, Column):
        size = df.agg(F.sum(row_bytes)).first()[0] or 0
    else:
        size = df.count() * row_bytes
    return F.broadcast(df) if size <= limit else df


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``limit`` bytes (one row at least)."""
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if batch.num_rows > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers outlive their tasks


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of equal leading key columns in sorted batches; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*columns, strict=True))
        start = 0
        for row, key in enumerate(rows):
            if key != last:
                if row > start:
                    held.append(batch.slice(start, row - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], row, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
