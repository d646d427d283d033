"""Two tokenizers' views of a text, aligned where tokens of both end on the same byte.

The ends of A and B are two ascending lists. The shorter one drives a galloping search into the longer: from a guessed place
steps double until the end is bracketed, then the bracket is halved; all ends of a batch go in step. Matched
places cut both lists into groups, and the differences of their ranks are the tokens on either side.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import bounded_side, slices, written
from rolesift.llm.frequent import FREQUENT_KEYS, least_level, level
from rolesift.llm.tokens import vocabulary_path

A_FILE = "byte_bpe_50k.tiktoken"
B_FILE = "piece_bpe_32k.model"
#: Links of a group made one by one at most; larger groups count their distinct ids first.
GROUP_LINKS = 1 << 12
#: Bytes of text aligned at once.
SLICE_BYTES = 2 << 20


class Ranked:
    """Byte-level pairs with the vocabulary given as ranks, as the published file has them."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.bytes = table

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._encoding.encode_to_numpy(f" {t}", disallowed_special=()) for t in texts]


class Pieces:
    """Sentence pieces; the model itself puts a blank before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._model.get_piece_size()
        self.bytes = [
            bytes([int(self._model.id_to_piece(i)[3:5], 16)]) if self._model.is_byte(i) else self._model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(size)
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in self._model.encode(texts, num_threads=1)]


class Side:
    """One tokenizer with the tables a batch is measured by."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer
        self.size = len(tokenizer.bytes)
        self.bytes = pa.array(tokenizer.bytes, pa.large_binary())
        self.lengths = np.array([len(b) for b in tokenizer.bytes], dtype=np.int64)

    def encode(self, texts: list[str], raw: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each text, None where their bytes are not a blank and the text."""
        found = self._tokenizer.encode(texts)
        joined = self.bytes.take(pa.array(np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int64)))
        data, ends = joined.buffers()[2], np.frombuffer(joined.buffers()[1], dtype=np.int64)
        out, at = [], 0
        view = memoryview(data).cast("B") if data else memoryview(b"")  # buffers show signed bytes
        for ids, text in zip(found, raw, strict=True):
            same = view[ends[at] : ends[at + len(ids)]] == text
            out.append(ids.astype(np.int64) if same else None)
            at += len(ids)
        return out


def sides(a: str | None, b: str | None) -> tuple[Side, Side]:
    """Both tokenizers, loaded once a Python worker."""
    held = sys.modules.setdefault("_rolesift_worker", types.ModuleType("_rolesift_worker")).__dict__
    key = f"sides {a} {b}"
    if key not in held:
        held[key] = (Side(Ranked(a or vocabulary_path(A_FILE))), Side(Pieces(b or vocabulary_path(B_FILE))))
    return held[key]


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in ascending ``long`` whose value is not less.

    Searches start at ``guess``; the last value of ``long`` is not less than any of ``short``.
    """
    at = np.minimum(guess, len(long) - 1)
    low, high = at.copy(), at.copy()  # long[low] < value <= long[high], low may be -1
    less = long[at] < short
    for ahead in (True, False):
        todo, step = np.flatnonzero(less == ahead), 1
        while len(todo):
            if ahead:
                new = np.minimum(high[todo] + step, len(long) - 1)
                low[todo], high[todo] = high[todo], new
                todo = todo[long[new] < short[todo]]
            else:
                new = np.maximum(low[todo] - step, -1)
                high[todo], low[todo] = low[todo], new
                todo = todo[(new >= 0) & (long[np.maximum(new, 0)] >= short[todo])]
            step *= 2
    todo = np.flatnonzero(high - low > 1)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        right = long[middle] < short[todo]
        low[todo[right]], high[todo[~right]] = middle[right], middle[~right]
        todo = todo[high[todo] - low[todo] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the values that both have. ``docs_*`` bound the documents, whose last ends agree."""
    swap = len(b) < len(a)
    short, long = (b, a) if swap else (a, b)
    short_docs, long_docs = (docs_b, docs_a) if swap else (docs_a, docs_b)
    sizes = np.diff(short_docs)
    # documents keep to a ratio of their own, so a place is guessed from the rank inside the document
    ratio = np.diff(long_docs) / np.maximum(sizes, 1)
    rank = np.arange(len(short)) - np.repeat(short_docs[:-1], sizes)
    found = gallop(short, long, np.repeat(long_docs[:-1], sizes) + (rank * np.repeat(ratio, sizes)).astype(np.int64))
    hit = np.flatnonzero(long[found] == short)
    return (found[hit], hit) if swap else (hit, found[hit])


def _texts_of_ids(size: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.large_string())


def _linked(ids_a, ids_b, n_a, n_b, docs, vocabulary_b):
    """Distinct links of every document and how often each occurs: document, pair, times."""
    starts_a, starts_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    size = n_a * n_b
    small = size <= GROUP_LINKS
    n, total = size[small], int(size[small].sum())
    inside = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    across = np.repeat(n_b[small], n)
    row = inside // np.maximum(across, 1)
    pair = ids_a[np.repeat(starts_a[small], n) + row] * vocabulary_b + ids_b[np.repeat(starts_b[small], n) + inside - row * across]
    doc, times = np.repeat(docs[small], n), np.ones(total, dtype=np.int64)
    more = [(doc, pair, times)]
    for g in np.flatnonzero(~small).tolist():
        a, of_a = np.unique(ids_a[starts_a[g] : starts_a[g] + n_a[g]], return_counts=True)
        b, of_b = np.unique(ids_b[starts_b[g] : starts_b[g] + n_b[g]], return_counts=True)
        more.append((np.full(len(a) * len(b), docs[g]), (a[:, None] * vocabulary_b + b).ravel(), (of_a[:, None] * of_b).ravel()))
    return more


def _distinct(doc: np.ndarray, pair: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = doc * most + pair
    order = np.argsort(key, kind="stable") if times.max(initial=1) > 1 else None
    key = key[order] if order is not None else np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    if order is None:
        n = np.diff(np.append(first, len(key)))
    else:
        n = np.add.reduceat(times[order], first)
    return key[first] // most, key[first] % most, n


def _aligner(a: str | None, b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(a, b)
        names = _texts_of_ids(max(side_a.size, side_b.size))
        span = len(names) // 3
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1, SLICE_BYTES):
            texts = batch.column(1).fill_null("").to_pylist()
            raw = [b" " + t.encode() for t in texts]
            full = [k for k, t in enumerate(texts) if t]
            own_a = side_a.encode([texts[k] for k in full], [raw[k] for k in full])
            own_b = side_b.encode([texts[k] for k in full], [raw[k] for k in full])
            kept = [k for k in range(len(full)) if own_a[k] is not None and own_b[k] is not None]
            count = len(texts)
            zeros = np.zeros(count, dtype=np.int64)
            total_a, total_b, n_groups, n_links, digests = zeros.copy(), zeros.copy(), zeros.copy(), zeros.copy(), [""] * count
            bounds, pairs, times = np.zeros(count + 1, dtype=np.int32), zeros[:0], zeros[:0]
            if kept:
                docs = np.array([full[k] for k in kept])
                sizes_a, sizes_b = (np.array([len(own[k]) for k in kept]) for own in (own_a, own_b))
                ids_a, ids_b = (np.concatenate([own[k] for k in kept]) for own in (own_a, own_b))
                docs_a, docs_b = (np.concatenate(([0], np.cumsum(s))) for s in (sizes_a, sizes_b))
                at_a, at_b = common_ends(np.cumsum(side_a.lengths[ids_a]), np.cumsum(side_b.lengths[ids_b]), docs_a, docs_b)
                n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
                ends = np.searchsorted(at_a, docs_a[1:] - 1) + 1  # groups up to the end of each document
                groups = np.diff(ends, prepend=0)
                of_group = np.repeat(docs, groups)
                total_a[docs], total_b[docs], n_groups[docs] = sizes_a, sizes_b, groups
                n_links[docs] = np.add.reduceat(n_a * n_b, ends - groups)
                # A's ids of a group, then B's; a bar after the last of A, a semicolon after the last of B
                group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
                order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
                mark_a, mark_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
                mark_a[at_a], mark_b[at_b] = span, 2 * span
                order[np.arange(len(ids_a)) + (at_b + 1 - n_b)[group_a]] = ids_a + mark_a
                order[np.arange(len(ids_b)) + (at_a + 1)[group_b]] = ids_b + mark_b
                told = names.take(pa.array(order))
                offsets, data = np.frombuffer(told.buffers()[1], dtype=np.int64), memoryview(told.buffers()[2])
                edges = offsets[docs_a + docs_b]
                for k, doc in enumerate(docs.tolist()):
                    digests[doc] = hashlib.sha256(data[edges[k] : edges[k + 1] - 1]).hexdigest()
                links = _linked(ids_a, ids_b, n_a, n_b, of_group, side_b.size)
                doc, pairs, times = _distinct(*(np.concatenate(c) for c in zip(*links, strict=True)), side_a.size * side_b.size)
                bounds = np.searchsorted(doc, np.arange(count + 1)).astype(np.int32)
            offsets = pa.array(bounds, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(count)), batch.column(0), *(pa.array(c) for c in (total_a, total_b, n_groups, n_links)), pa.array(digests),
                    pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            row += count

    return run


def align(docs: DataFrame, a: str | None = None, b: str | None = None, frequent: int = FREQUENT_KEYS) -> DataFrame:
    """(doc_id, text) to a row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` names the file of a byte-level tokenizer as ranks (given a blank and the text), ``b`` a sentence-piece model (adds
    the blank itself). Strings of special tokens inside texts are plain text to both.

    1. One pass aligns the texts and writes each document's distinct links with how often each occurs, in numbers only.
    2. Documents are counted for each linked pair of ids, and the highest count for each id of A (a row an id).
    3. The counts go back to the links: pairs above a level, at most ``frequent`` of them, by broadcast, rarer
       ones, of which none has many rows, by a shuffle; sums of each document meet once more.

    Cases: null, empty and texts whose ids do not give back a blank and the text have zeros and an empty digest. A null doc_id is
    kept, repeated rows each count as a document. No rows give no rows. Other columns are not looked at.
    """
    found = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _aligner(a, b),
            "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>",
        ),
        "aligned",
    )
    vocabulary_b = sides(a, b)[1].size
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "aligned-counts")
    of_a = F.floor(F.col("pair") / F.lit(vocabulary_b)).cast("long")
    # a row an id of A: the vocabulary bounds it
    most = written(counts.groupBy(of_a.alias("id_a")).agg(F.max("n").alias("most")), "aligned-best")
    told = counts.withColumn("id_a", of_a).join(bounded_side(most, 16), "id_a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    least = least_level(counts, "n", frequent)
    common, rare = (told.filter(level(F.col("n")) >= least), told.filter(level(F.col("n")) < least))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = (F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    met = links.join(F.broadcast(common), "pair", "left")
    parts = met.filter("n is not null").groupBy("row").agg(*sums)
    if not rare.isEmpty():
        parts = parts.unionByName(met.filter("n is null").select("row", "pair", "times").join(rare, "pair").groupBy("row").agg(*sums))
        parts = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(parts, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256"
    )
