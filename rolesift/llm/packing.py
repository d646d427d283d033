"""Packing of token pieces into sequences by non-negative least squares over length patterns."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.llm.common import slices, written
from rolesift.llm.tokens import encoder

LENGTH = 2048
END_ID = 0
#: Lengths are fitted in steps of so many tokens; patterns hold so many documents at most.
STEP = 8
PATTERN_DOCUMENTS = 3
#: Weight of short lengths in the fit: what is left over should be short, it packs well.
SHORT_WEIGHT = 0.1


def patterns(capacity: int, most: int = PATTERN_DOCUMENTS) -> list[tuple[int, ...]]:
    """All non-increasing runs of at most ``most`` sizes that fill the capacity exactly."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) + 1 == most:
            if left <= top:
                found.append((*head, left))
        else:
            for size in range(min(left, top), 0, -1):
                extend((*head, size), left - size, size)

    extend((), capacity, capacity)
    return found


def nnls(matrix: np.ndarray, target: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|: the active set method on the normal equations."""
    aim = matrix.T @ target
    enough = tolerance * max(1.0, float(np.abs(aim).max()))
    x = np.zeros(matrix.shape[1])
    free = np.zeros(len(x), dtype=bool)
    for _ in range(3 * len(target)):
        slope = matrix.T @ (target - matrix[:, free] @ x[free])
        slope[free] = -np.inf
        enter = int(slope.argmax())
        if slope[enter] <= enough:
            break
        free[enter] = True
        while True:
            own = np.flatnonzero(free)
            part = matrix[:, own]
            solved = np.linalg.solve(part.T @ part + 1e-10 * np.eye(len(own)), aim[own])
            if (solved > 0).all():
                x[:] = 0
                x[own] = solved
                break
            low = solved <= 0
            ratio = x[own][low] / np.maximum(x[own][low] - solved[low], 1e-300)
            step = float(ratio.min())
            x[own] += step * (solved - x[own])
            drop = own[(x[own] <= 1e-12) & low]
            if not len(drop):
                drop = own[low][[int(ratio.argmin())]]
            x[drop] = 0
            free[drop] = False
            if not free.any():
                break
    return x


class Plan:
    """Where the pieces of every length go, from the histogram of lengths alone.

    Lengths share a class when they are equal after rounding up to the step. The pieces of a class are
    numbered from the longest down; each slot takes a run of these numbers, ``per`` to a sequence.
    """

    def __init__(self, histogram: dict[int, int], length: int = LENGTH, step: int = STEP, most: int = PATTERN_DOCUMENTS):
        self.length, self.step = length, step
        self.first: dict[int, int] = {}
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        counts: dict[int, int] = {}
        for size in sorted(histogram, reverse=True):
            kind = -(-size // step)
            self.first[size] = counts.get(kind, 0)
            counts[kind] = self.first[size] + histogram[size]
        used = self._fit(counts, most) if counts else {}
        left = {}
        for size, n in histogram.items():
            end = self.first[size] + n
            begin = max(self.first[size], used.get(-(-size // step), 0))
            if begin < end:
                left[size] = (begin, end)
        self._best_fit(left)
        self.slots.sort()

    def _add(self, kind: int, begin: int, sequence: int, place: int, per: int) -> None:
        self.slots.append((kind, begin, sequence, place, per))

    def _fit(self, counts: dict[int, int], most: int) -> dict[int, int]:
        capacity = self.length // self.step
        if capacity * self.step != self.length:
            raise ValueError("the step must divide the length")
        wanted = np.array([counts.get(k, 0) for k in range(1, capacity + 1)], dtype=float)
        # a pattern of a size that does not occur could never be used
        able = [p for p in patterns(capacity, most) if all(counts.get(k) for k in p)]
        if not able:
            return {}
        matrix = np.zeros((capacity, len(able)))
        for k, pattern in enumerate(able):
            np.add.at(matrix[:, k], np.array(pattern) - 1, 1)
        weight = np.where(np.arange(1, capacity + 1) > capacity // 16, 1.0, SHORT_WEIGHT)
        repeats = nnls(matrix * weight[:, None], wanted * weight)
        used: dict[int, int] = {}
        for k in np.argsort(-repeats, kind="stable"):
            sizes = {s: able[k].count(s) for s in able[k]}
            n = min(round(float(repeats[k])), *((counts[s] - used.get(s, 0)) // m for s, m in sizes.items()))
            if n <= 0:
                continue
            for place, (size, m) in enumerate(sizes.items()):
                self._add(size, used.get(size, 0), self.sequences, place, m)
                used[size] = used.get(size, 0) + n * m
            self.sequences += n
        return used

    def _best_fit(self, left: dict[int, tuple[int, int]]) -> None:
        """Longest first into the tightest open sequences; equal sequences are handled together."""
        open_spaces: list[int] = []
        groups: dict[int, list[tuple[int, int, int]]] = {}  # space: (first sequence, how many, next place)

        def put(space: int, first: int, n: int, place: int) -> None:
            if n and space:
                if space not in groups:
                    bisect.insort(open_spaces, space)
                groups.setdefault(space, []).append((first, n, place))

        for size in sorted(left, reverse=True):
            begin, end = left[size]
            kind = -(-size // self.step)
            while begin < end:
                at = bisect.bisect_left(open_spaces, size)
                if at == len(open_spaces):
                    per = self.length // size
                    n = -(-(end - begin) // per)
                    put(self.length, self.sequences, n, 0)
                    self.sequences += n
                    continue
                space = open_spaces[at]
                first, n, place = groups[space].pop()
                if not groups[space]:
                    del groups[space], open_spaces[at]
                per = min(space // size, end - begin)
                full = min(n, (end - begin) // per)
                self._add(kind, begin, first, place, per)
                begin += full * per
                put(space - per * size, first, full, place + 1)
                put(space, first + full, n - full, place)

    def lookup(self) -> tuple[np.ndarray, ...]:
        kind, begin, sequence, place, per = (np.array(c, dtype=np.int64) for c in zip(*self.slots, strict=True))
        return (kind << 40) | begin, begin, sequence, place, per


def _pieces(length: int, end_id: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, dtype=np.int64)
        for batch in slices(batches, 1):
            flat, offsets = encoder(vocabulary).encode(batch.column(1))
            flat = np.insert(flat.astype("<u4"), offsets[1:], end_id)
            bounds = offsets + np.arange(len(offsets))
            docs = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc, a, b in zip(docs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for piece, start in enumerate(range(0, b - a, length)):
                    n = min(length, b - a - start)
                    rows.append((doc, piece, start, n, zlib.crc32(flat[a + start : a + start + n].tobytes()), int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array([chunk] * len(rows), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "own_number", "chunk"],
            )

    return run


def _placed(plan: Plan):
    keys, begins, sequences, places, pers = plan.lookup()
    first = np.zeros(plan.length + 1, dtype=np.int64)
    for size, n in plan.first.items():
        first[size] = n
    step = plan.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            number = first[size] + batch.column("number").to_numpy()
            slot = np.searchsorted(keys, ((-(-size // step)) << 40) | number, side="right") - 1
            inside = number - begins[slot]
            sequence = sequences[slot] + inside // pers[slot]
            order = (places[slot] << 20) | (inside % pers[slot])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(order)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "order"],
            )

    return run


def pack(
    docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, step: int = STEP, vocabulary: str | None = None,
) -> DataFrame:
    """(doc_id, text) to one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only those longer than ``length`` are cut, into pieces of that
    length and a shorter last one.

    1. Documents are encoded once; pieces are written without their ids.
    2. The histogram of lengths (``length`` rows at most, whatever the corpus) goes to the driver. Patterns of
       up to three lengths, in steps of 8 tokens, that fill a sequence are enumerated; non-negative
       least squares fits how often each is used; counts are rounded and never overdrawn. What is left is
       packed best fit decreasing, equal lengths together.
    3. Pieces are numbered within their length by prefix sums over the chunks they were made in, so
       no length, however frequent, is gathered; the number gives the slot. Offsets are running sums inside
       one sequence.

    Cases: null and empty texts are one piece of the end id. Repeated rows are packed each. A null doc_id is kept.
    No rows give no rows. Other columns are not looked at.
    """
    pieces = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _pieces(length, end_id, vocabulary),
            "doc_id long, piece int, start long, length long, ids_crc32 long, own_number long, chunk int",
        ),
        "packing-pieces",
    )
    counts = written(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, length, step)
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["chunk", "length"]).withColumn("number", F.col("base") + F.col("own_number"))
    if not histogram:
        placed = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("order"))
    else:
        placed = numbered.mapInArrow(
            _placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, order long"
        )
    earlier = W.partitionBy("sequence_id").orderBy("order").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
