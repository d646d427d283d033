"""Word shingles and MinHash signatures of whole batches of texts, in numpy.

Texts arrive in their word form (``common.word_form``): words end with one blank, so word
borders are the positions of blanks in the UTF-8 buffer and no text is walked in Python.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa

from rolesift.llm.common import SHINGLE_WORDS

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE_BASE, _WORD_BASE = 0x100000001B3, 0x9E3779B97F4A7C15
_WORD_BYTES = 64
_CHUNK_WORDS = 1 << 17
SHIFT = np.uint64(32)
_NO_WORD = re.compile(r"[\W_]+")


def words_of(text: str) -> str:
    """The word form of ``common.word_form`` for a text made inside a task."""
    return _NO_WORD.sub(" ", f"{text.lower()} ").lstrip()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, i, 1 << 64) for i in range(n)], dtype=np.uint64)


_BYTE_POWERS = _powers(_BYTE_BASE, _WORD_BYTES)


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash a word; long words are hashed in pieces of 64 bytes, each mixed with its place."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), _CHUNK_WORDS):
        s, e = starts[at : at + _CHUNK_WORDS], ends[at : at + _CHUNK_WORDS]
        lengths = e - s
        low, high = int(s[0]), int(e[-1]) + 1
        inside = np.arange(low, high) - np.repeat(s, np.diff(np.append(s, high)))
        values = (buffer[low:high].astype(np.uint64) + np.uint64(1)) * _BYTE_POWERS[inside & (_WORD_BYTES - 1)]
        values[e - low] = 0  # the blank after each word
        if int(lengths.max()) > _WORD_BYTES:
            pieces = inside // _WORD_BYTES
            values = np.where(pieces > 0, mix(values + pieces.astype(np.uint64)), values)
            values[e - low] = 0
        out[at : at + _CHUNK_WORDS] = mix(np.add.reduceat(values, s - low) + lengths.astype(np.uint64))
    return out


def shingle_hashes(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of a batch in text order, and the offsets of the texts in them.

    A text with fewer words than a shingle has one shingle of all its words; one without words has none.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    _, ends_at, data = texts.buffers()
    bounds = np.frombuffer(ends_at, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    first = int(bounds[0])
    if int(bounds[-1]) == first:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    buffer = np.frombuffer(data, dtype=np.uint8)[first : int(bounds[-1])]
    ends = np.flatnonzero(buffer == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = _word_hashes(buffer, starts, ends)
    word_at = np.searchsorted(ends, bounds - first)  # words before each text
    counts = np.diff(word_at)
    grams = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(grams)))

    total = len(hashed)
    base = np.uint64(_WORD_BASE)
    rolled = np.zeros(max(total - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * base + hashed[k : k + len(rolled)]
    place = np.arange(int(offsets[-1])) + np.repeat(word_at[:-1] - offsets[:-1], grams)
    out = np.zeros(int(offsets[-1]), dtype=np.uint64)
    long_ones = np.repeat(counts >= words, grams)
    out[long_ones] = rolled[place[long_ones]]
    for doc in np.flatnonzero((counts > 0) & (counts < words)):
        value = 0
        for h in hashed[word_at[doc] : word_at[doc + 1]]:
            value = (value * _WORD_BASE + int(h)) & 0xFFFFFFFFFFFFFFFF
        out[offsets[doc]] = np.uint64(value) + np.uint64(counts[doc])
    return mix(out), offsets


def sets_of(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    return [np.unique(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of n universal hash functions ``(a x + b) >> 32`` with odd a."""
    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every hash function over each text's shingles, one row a text.

    Texts without shingles get the greatest value everywhere.
    """
    out = np.full((len(offsets) - 1, len(a)), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        at = offsets[full]
        for k in range(len(a)):
            out[full, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> SHIFT).astype(np.uint32), at)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of a signature."""
    parts = signature[:, : bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    out = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(_WORD_BASE) + parts[:, :, k] + np.uint64(1))
    return out.view(np.int64)


def choose_bands(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Bands and rows: the most selective rows whose bands reach the recall within the hash budget.

    A pair of that similarity meets in one band at least with probability
    ``1 - (1 - similarity ** rows) ** bands >= recall``.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        miss = math.log1p(-(similarity**rows))
        bands = max(1, math.ceil(math.log(1 - recall) / miss)) if miss < 0 else most_hashes + 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band setting reaches this recall within the hash budget")
    return best


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right.

    Only elements that occur twice can be shared, so the matrices hold those columns alone and are
    multiplied in strips.
    """
    values = np.concatenate([*left, *right]) if left or right else np.empty(0, np.uint64)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(values):
        return out
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    kept = seen > 1
    renumbered = np.cumsum(kept) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    use = kept[column]
    row, column = row[use], renumbered[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    strip = 4096
    for at in range(0, int(kept.sum()), strip):
        a, b = np.searchsorted(column, (at, at + strip))
        block = np.zeros((len(left) + len(right), strip), dtype=np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return out
