"""A gated recurrent language model in numpy, and the log-likelihood of every whole document under it.

The output is factored: frequent words stand in classes of equal size, a softmax chooses the class, a second one the word in it.
Every other word belongs to one of a few kinds (by its letters), which are classes too; inside a kind a word has its add-one share
of the kind's training tokens, unknown words one share together. So the model gives each possible text one
probability, and its counts come from the whole corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import slices, written
from rolesift.llm.frequent import FREQUENT_KEYS, least_level, level

#: Stands for the end of a document; no word is empty.
END = ""
CLASSES, CLASS_WORDS, KINDS, HIDDEN = 32, 32, 8, 32
#: Every learning document takes part in the gradient, in one of so many rounds.
ROUNDS = 4
#: Tokens a learner takes in a round, about; documents are dealt to as many learners as that needs.
LEARNER_TOKENS = 1 << 20
#: Streams side by side, steps a window and step size of the gradient; longer documents start anew after LEARN_RUN tokens.
LEARN_STREAMS, LEARN_WINDOW, LEARN_RUN, RATE = 256, 16, 1024, 0.01
SCORE_STREAMS, SCORE_WINDOW = 256, 64
#: Tokens held by a task at once while it learns or scores (one document at least).
HELD_TOKENS = 1 << 21
_CHUNK = 4096


def held_out() -> Column:
    """Documents whose crc32 of doc_id leaves 2 modulo 7 are not learned from; a null id reads as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, and the bounds of the texts in them. A-Z are lowered, ASCII white space parts; null reads as empty."""
    # a copy of its own: lowering a slice of a larger array reads past the slice
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    return words.filter(pa.array(full)), before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def kinds_of(words: pa.Array) -> np.ndarray:
    """The kind of each word: beyond ASCII, with a digit, with a mark at the end."""
    size = pc.binary_length(words)
    beyond = pc.greater(size, pc.utf8_length(words).cast(size.type))
    tests = (beyond, *(pc.match_substring_regex(words, t) for t in (r"[0-9]", r"[^\pL\pN]$")))
    return sum((1 << k) * test.to_numpy(zero_copy_only=False).astype(np.int64) for k, test in enumerate(tests))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0):
        words, bounds = words_of(batch.column(0))
        coded = words.dictionary_encode()
        seen = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
        found = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])
        yield pa.RecordBatch.from_arrays([found, pa.array(np.append(seen, len(bounds) - 1))], ["word", "n"])


class Shape:
    """Which symbol stands where: the vocabulary by falling count, then the kinds."""

    def __init__(self, vocabulary: list[tuple[str, int]], kind_tokens: list[int], kind_words: list[int], class_words: int = CLASS_WORDS, hidden: int = HIDDEN):
        self.words = [w for w, _ in vocabulary]
        self.counts = np.array([n for _, n in vocabulary], dtype=np.float64)
        self.kind_tokens, self.kind_words = np.array(kind_tokens, dtype=np.float64), np.array(kind_words, dtype=np.float64)
        self.size, self.class_words, self.hidden = len(vocabulary), class_words, hidden
        self.classes = -(-self.size // class_words)
        self.end = self.words.index(END)
        h, symbols = hidden, self.size + KINDS
        self.parts = {
            "inputs": (symbols, 3 * h), "state": (h, 3 * h), "class": (h, self.classes + KINDS), "class_bias": (self.classes + KINDS,),
            "word": (self.classes, h, class_words), "word_bias": (self.classes, class_words),
        }
        self.total = sum(int(np.prod(s)) for s in self.parts.values())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def begin(self, seed: int = 5) -> np.ndarray:
        """Small random weights; the biases make the first model the unigram one."""
        draw = np.random.Generator(np.random.PCG64(seed))
        flat = (draw.standard_normal(self.total) * 0.1).astype(np.float32)
        p = self.views(flat)
        p["class"][:] = p["word"][:] = 0
        padded = np.zeros(self.classes * self.class_words)
        padded[: self.size] = self.counts
        blocks = padded.reshape(self.classes, self.class_words)
        p["class_bias"][:] = np.log(np.concatenate((blocks.sum(1), self.kind_tokens)) + 1)
        p["word_bias"][:] = np.log(blocks + 0.5)
        return flat

    def empty_words(self) -> np.ndarray:
        return (np.arange(self.classes * self.class_words) >= self.size).reshape(self.classes, self.class_words)


#: Logits may spread so far below their bound before the greatest of each row is taken away instead.
_SPREAD = 60.0


def _bound(weights: np.ndarray, bias: np.ndarray) -> tuple[float, bool]:
    """No logit of a state (between -1 and 1) is above the first; whether exponents below it stay in range."""
    reach = np.abs(weights).sum(axis=0)
    top = float((bias + reach).max())
    return top, top - float((bias - reach).max()) < _SPREAD


def _bounds(weights: np.ndarray, bias: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_bound`` of each class; ``empty`` is far below zero where a class has no word."""
    reach, bias = np.abs(weights).sum(axis=1), bias + empty
    top = (bias + reach).max(axis=1)
    return top, top - (bias - reach).max(axis=1) < _SPREAD


def _exponents(logits: np.ndarray, safe: bool, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits into exponents in place; log of the chosen one's share, and the sums of the rows."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    picked = logits[rows, chosen]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return picked - np.log(total), total


class Model:
    """Gated recurrent units between the input table and the factored output."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.p = shape, flat, shape.views(flat)
        self._empty = np.where(shape.empty_words(), -1e9, 0).astype(np.float32)

    def states(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """The states after each step. x: symbols before, keep: 0 where a document begins; (steps, streams).

        ``trace`` takes what the gradient needs of each step: state before, both gates, new state, pushed state.
        """
        size, streams = self.shape.hidden, x.shape[1]
        # a logistic gate is a hyperbolic tangent of half its argument
        half = np.ones(3 * size, np.float32)
        half[: 2 * size] = 0.5
        inputs, state = self.p["inputs"] * half, self.p["state"] * half
        out = np.empty((len(x), streams, size), dtype=np.float32)
        before, gates, news, pushes = trace or (None, np.empty((1, 2, streams, size), np.float32), np.empty((1, streams, size), np.float32), None)
        pushed = np.empty((streams, 3 * size), np.float32)
        kept = keep.min(axis=1) > 0
        for t in range(len(x)):
            if not kept[t]:
                h = h * keep[t][:, None]
            at = t if trace else 0
            own = inputs.take(x[t], axis=0)
            np.matmul(h, state, out=pushed)
            gate, new = gates[at], news[at]
            np.add(own[:, :size], pushed[:, :size], out=gate[0])
            np.add(own[:, size : 2 * size], pushed[:, size : 2 * size], out=gate[1])
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            np.multiply(gate[1], pushed[:, 2 * size :], out=new)
            new += own[:, 2 * size :]
            np.tanh(new, out=new)
            if trace:
                before[t], pushes[t] = h, pushed[:, 2 * size :]
            h = np.subtract(h, new, out=out[t])
            h *= gate[0]
            h += new
        return out

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of the chosen class and word of each row; the gradient of the states when asked for."""
        p, shape = self.p, self.shape
        known = y < shape.size
        chosen = np.where(known, y // shape.class_words, shape.classes + y - shape.size)
        rows = np.arange(len(y))
        top, safe = _bound(p["class"], p["class_bias"])
        logits = h @ p["class"]
        logits += p["class_bias"] - np.float32(top)
        share, total = _exponents(logits, safe, rows, chosen)
        logs = share.astype(np.float64)
        back = None
        if grads is not None:
            logits *= (weight / total)[:, None]
            logits[rows, chosen] -= weight
            back = logits @ p["class"].T
            grads["class"] += h.T @ logits
            grads["class_bias"] += logits.sum(axis=0)
        order = np.argsort(chosen.astype(np.uint16), kind="stable")
        ends = np.searchsorted(chosen[order], np.arange(shape.classes + 1))
        sorted_h, place = h[order[: ends[-1]]], y[order[: ends[-1]]] % shape.class_words
        found = np.empty(int(ends[-1]), np.float32)
        sorted_back = np.empty_like(sorted_h) if grads is not None else None
        top, safe = _bounds(p["word"], p["word_bias"], self._empty)
        bias = p["word_bias"] + self._empty - top[:, None]
        for c in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(int(ends[c]), int(ends[c + 1]))
            part = sorted_h[own]
            inside = part @ p["word"][c]
            inside += bias[c]
            found[own], total = _exponents(inside, safe[c], rows[: len(part)], place[own])
            if grads is not None:
                inside *= (weight / total)[:, None]
                inside[rows[: len(part)], place[own]] -= weight
                np.matmul(inside, p["word"][c].T, out=sorted_back[own])
                grads["word"][c] += part.T @ inside
                grads["word_bias"][c] += inside.sum(axis=0)
        logs[order[: ends[-1]]] += found
        if grads is not None:
            back[order[: ends[-1]]] += sorted_back
        return logs, back

    def learn_window(self, x, y, keep, inside, h, grads: dict, weight: float) -> np.ndarray:
        """Adds the gradient of one window, truncated at its start; the state after it."""
        size, p = self.shape.hidden, self.p
        steps, streams = x.shape
        trace = before, gates, new, pushed = tuple(np.empty((steps, *own, streams, size), np.float32) for own in ((), (2,), (), ()))
        out = self.states(x, keep, h, trace)
        if inside.all():
            back = self.output(out.reshape(-1, size), y.ravel(), grads, weight)[1].reshape(out.shape)
        else:
            back = np.zeros_like(out)
            back[inside] = self.output(out[inside], y[inside], grads, weight)[1]
        # one row a token: what goes to the pushed new state, to both gates and to the new state; pushes are the first three, inputs the last
        given = np.empty((steps, streams, 4 * size), np.float32)
        later = np.zeros((streams, size), np.float32)
        turned = np.ascontiguousarray(np.roll(p["state"], size, axis=1).T)
        rest, slope = np.empty((streams, size), np.float32), np.empty((streams, size), np.float32)
        for t in range(steps - 1, -1, -1):
            (z, r), own, d = gates[t], given[t], back[t]
            d += later
            to_push, to_z, to_r, to_new = (own[:, k * size : (k + 1) * size] for k in range(4))
            np.subtract(1, z, out=rest)
            np.multiply(new[t], new[t], out=slope)
            np.subtract(1, slope, out=slope)
            slope *= rest
            np.multiply(d, slope, out=to_new)
            np.subtract(before[t], new[t], out=slope)
            slope *= z
            slope *= rest
            np.multiply(d, slope, out=to_z)
            np.multiply(pushed[t], r, out=slope)
            np.subtract(1, r, out=rest)
            slope *= rest
            np.multiply(to_new, slope, out=to_r)
            np.multiply(to_new, r, out=to_push)
            np.matmul(own[:, : 3 * size], turned, out=later)
            d *= z
            later += d
            if keep[t].min() == 0:
                later *= keep[t][:, None]
        tokens = given.reshape(-1, 4 * size)
        grads["state"] += np.roll(before.reshape(-1, size).T @ tokens[:, : 3 * size], -size, axis=1)
        symbols = x.ravel()
        # symbols are few: a short key sorts in one pass over its bytes
        order = np.argsort(symbols.astype(np.uint16) if self.shape.size + KINDS < 1 << 16 else symbols, kind="stable")
        first = np.flatnonzero(np.diff(symbols[order], prepend=-1))
        grads["inputs"][symbols[order][first]] += np.add.reduceat(tokens[:, size:].take(order, axis=0), first)
        return out[-1]


class Streams:
    """Documents laid behind each other in streams of about equal length, the longest stream first."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, most: int):
        sizes = np.diff(bounds)
        heap = [(0, k) for k in range(max(1, min(most, len(sizes))))]
        dealt: list[list[int]] = [[] for _ in heap]
        for doc in np.argsort(-sizes, kind="stable").tolist():
            load, k = heapq.heappop(heap)
            dealt[k].append(doc)
            heapq.heappush(heap, (load + int(sizes[doc]), k))
        dealt.sort(key=lambda docs: -int(sizes[docs].sum()))
        order = np.array([d for docs in dealt for d in docs], dtype=np.int64)
        self.loads = np.array([int(sizes[docs].sum()) for docs in dealt])
        self.starts = np.cumsum(self.loads) - self.loads
        own = sizes[order]
        ends = np.cumsum(own)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(bounds[order] - (ends - own), own)
        self.y, self.doc = symbols[source], np.repeat(order, own)
        self.first = np.zeros(len(source), dtype=bool)
        self.first[(ends - own)[own > 0]] = True

    def windows(self, steps: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
        """x, y, keep, inside, place of each window, (steps, streams); streams that are done fall away."""
        for at in range(0, int(self.loads.max(initial=0)), steps):
            active = int((self.loads > at).sum())
            step = np.arange(at, at + steps)[:, None]
            inside = step < self.loads[:active]
            place = np.where(inside, self.starts[:active] + step, self.starts[:active])
            begins = self.first[place]
            x = np.where(begins, end, self.y[place - 1])
            yield x, self.y[place], np.where(begins, 0, 1).astype(np.float32), inside, place


def _symbols(shape: Shape, value_set: pa.Array, words: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Symbols of a batch with ends, their bounds, the distinct words and the code of each word."""
    coded = words.dictionary_encode()
    known = pc.index_in(coded.dictionary, value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    symbol = np.where(known >= 0, known, shape.size + kinds_of(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return np.insert(symbol[codes], bounds[1:], shape.end), bounds + np.arange(len(bounds)), coded.dictionary, codes


def _learner(shape: Shape, flat: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shape, flat.copy())
        mean, square, change = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
        gradient = np.zeros_like(flat)
        grads = shape.views(gradient)
        value_set = pa.array(shape.words, pa.large_string())
        steps = seen = 0

        def learn(symbols: np.ndarray, bounds: np.ndarray) -> None:
            nonlocal steps, seen, gradient, mean, square, change
            cuts = np.unique(np.concatenate([bounds, *(np.arange(a, b, LEARN_RUN) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > LEARN_RUN)]))
            streams = Streams(symbols, cuts, LEARN_STREAMS)
            h = np.zeros((len(streams.loads), shape.hidden), np.float32)
            for x, y, keep, inside, _ in streams.windows(LEARN_WINDOW, shape.end):
                gradient[:] = 0
                h = model.learn_window(x, y, keep, inside, h[: x.shape[1]], grads, 1.0 / (LEARN_STREAMS * LEARN_WINDOW))
                steps += 1
                np.multiply(gradient, gradient, out=change)
                change -= square
                change *= 0.01
                square += change
                gradient -= mean
                gradient *= 0.1
                mean += gradient
                np.multiply(square, 1 / (1 - 0.99**steps), out=change)
                np.sqrt(change, out=change)
                change += 1e-5
                np.divide(mean, change, out=change)
                change *= rate / (1 - 0.9**steps)
                model.flat -= change
            seen += len(symbols)

        for symbols, bounds, _ in _held(batches, 0, shape, value_set, None):
            learn(symbols, bounds)
        if seen:
            for chunk, at in enumerate(range(0, len(flat), _CHUNK)):
                # single precision as the weights are: each learner shuffles them whole
                part = model.flat[at : at + _CHUNK].astype("<f4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([float(seen)]), pa.array([part], pa.binary())], ["chunk", "seen", "part"])

    return run


def _held(batches: Iterator[pa.RecordBatch], column: int, shape: Shape, value_set: pa.Array, each) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Symbols of about HELD_TOKENS tokens at once, with what ``each`` makes of their batches."""
    symbols, sizes, made, held = [], [], [], 0
    for batch in slices(batches, column):
        words, bounds = words_of(batch.column(column))
        own, ends, distinct, codes = _symbols(shape, value_set, words, bounds)
        if each is not None:
            made.append(each(batch, own, ends, bounds, distinct, codes))
        symbols.append(own)
        sizes.append(np.diff(ends))
        held += len(own)
        if held >= HELD_TOKENS:
            yield np.concatenate(symbols), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), made
            symbols, sizes, made, held = [], [], [], 0
    if symbols:
        yield np.concatenate(symbols), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), made


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to one row a chunk; a sum runs along them."""
    chunk, seen, total = None, 0.0, None
    out = []
    for batch in batches:
        for k, n, part in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if k != chunk:
                if chunk is not None:
                    out.append((chunk, (total / seen).astype("<f4").tobytes()))
                chunk, seen, total = k, 0.0, 0.0
            seen, total = seen + n, total + np.frombuffer(part, dtype="<f4").astype(np.float64) * n
    if chunk is not None:
        out.append((chunk, (total / seen).astype("<f4").tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], ["chunk", "part"])


def train(docs: DataFrame, shape: Shape, train_tokens: int) -> np.ndarray:
    """The model's weights, learned from (doc_id, text) in rounds.

    Each document is dealt to one round by its digest, and there to one of the learners of about ``LEARNER_TOKENS`` tokens. Each learner starts from the same weights and runs truncated backpropagation over
    its documents; the weights are averaged by tokens, as chunks in a shuffle. The driver holds one set of weights.
    """
    flat = shape.begin()
    digest = F.xxhash64("doc_id", "text")
    of_round = F.pmod(digest, F.lit(ROUNDS))
    learners = max(1, -(-train_tokens // (ROUNDS * LEARNER_TOKENS)))
    for k in range(ROUNDS):
        parts = (
            docs.filter(of_round == k).select("text", digest.alias("digest")).repartition(learners, "digest").select("text")
            .mapInArrow(_learner(shape, flat, RATE / (1 + k)), "chunk int, seen double, part binary")
        )
        rows = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_averaged, "chunk int, part binary").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r["part"], dtype="<f4") for r in sorted(rows, key=lambda r: r["chunk"])]).copy()
    return flat


def _scorer(shape: Shape, flat: np.ndarray, looked_up):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shape, flat)
        value_set = pa.array(shape.words, pa.large_string())
        with pa.ipc.open_stream(looked_up.value) as reader:
            table = reader.read_all().combine_chunks()
        frequent, counts = table.column(0).combine_chunks().cast(pa.large_string()), table.column(1).to_numpy()
        end_count = shape.counts[shape.end]
        shares = np.log10(shape.kind_tokens + shape.kind_words + 1)
        row = TaskContext.get().partitionId() << 33

        def each(batch, own, ends, bounds, distinct, codes):
            """What is known of a batch's documents before the model runs: count terms and rare words."""
            n_docs = batch.num_rows
            doc = np.repeat(np.arange(n_docs), np.diff(bounds))
            at = pc.index_in(distinct, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)
            n = np.where(at >= 0, counts[np.maximum(at, 0)] if len(counts) else 0, 0)
            rare = (at < 0)[codes]
            logs, plain = np.log10(n + 1.0)[codes], own[np.delete(np.arange(len(own)), ends[1:] - 1)]
            tail = plain >= shape.size
            sums = lambda rows, values: np.bincount(doc[rows], weights=values[rows], minlength=n_docs)
            every = np.ones(len(doc), dtype=bool)
            known = np.bincount(doc[~rare], minlength=n_docs) + (end_count > 0)
            base = sums(every, logs) + np.log10(end_count + 1)
            tails = sums(tail, logs) - sums(tail, np.append(shares, 0.0)[np.where(tail, plain - shape.size, KINDS)])
            cold = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=n_docs)))), pa.int32()), distinct.take(pa.array(codes[rare])).cast(pa.string())
            )
            return batch.column(0), batch.column(1), np.diff(ends), known, base, tails, cold

        for symbols, bounds, made in _held(batches, 2, shape, value_set, each):
            streams = Streams(symbols, bounds, SCORE_STREAMS)
            score = np.zeros(len(bounds) - 1)
            h = np.zeros((len(streams.loads), shape.hidden), np.float32)
            for x, y, keep, inside, place in streams.windows(SCORE_WINDOW, shape.end):
                out = model.states(x, keep, h[: x.shape[1]])
                h = out[-1]
                score += np.bincount(streams.doc[place[inside]], weights=model.output(out[inside], y[inside])[0], minlength=len(score))
            score /= np.log(10)
            at = 0
            for doc_id, is_held, n, known, base, tails, cold in made:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(len(n))), doc_id, is_held, pa.array(n), pa.array(known.astype(np.int64)), pa.array(base),
                        pa.array(score[at : at + len(n)] + tails), cold,
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "cold"],
                )
                row, at = row + len(n), at + len(n)

    return run


def score_documents(docs: DataFrame, frequent: int = FREQUENT_KEYS, classes: int = CLASSES, class_words: int = CLASS_WORDS) -> DataFrame:
    """(doc_id, text) to a row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    1. The words of all learning documents are counted, in batches first; the top ``classes * class_words`` and the end
       are the vocabulary, the others count by kind.
    2. ``train`` learns the recurrent model.
    3. Every text is scored in windows, side by side with others, its state carried from window to window. Counts of
       words above a level (at most ``frequent``) go to the tasks, rarer ones are joined by a shuffle; a word below
       the level has few rows by definition.

    Cases: null and empty texts are one end. A null doc_id reads as an empty one. Repeated rows count and are scored each. Without
    a learning document both scores give each text the probability that nothing is known. No rows give no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    learned = given.filter("not held_out")
    counts = written(learned.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.filter(F.col("word") != END).orderBy(F.desc("n"), "word").limit(classes * class_words - 1).collect()
    ends = counts.filter(F.col("word") == END).collect()
    vocabulary = sorted([(r["word"], r["n"]) for r in top] + [(END, ends[0]["n"] if ends else 0)], key=lambda w: (-w[1], w[0]))
    listed = {w for w, _ in vocabulary}

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(sorted(listed))
        for batch in batches:
            rest = batch.filter(pc.invert(pc.is_in(batch.column(0), value_set=value_set)))
            kind = kinds_of(rest.column(0))
            tokens = np.bincount(kind, weights=rest.column(1).to_numpy(), minlength=KINDS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(KINDS), pa.int32()), pa.array(tokens), pa.array(np.bincount(kind, minlength=KINDS))], ["kind", "tokens", "words"]
            )

    of_kinds = {r["kind"]: r for r in counts.mapInArrow(kinds, "kind int, tokens long, words long").groupBy("kind").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()}
    kind_tokens, kind_words = ([of_kinds[k][c] if k in of_kinds else 0 for k in range(KINDS)] for c in ("tokens", "words"))
    shape = Shape(vocabulary, kind_tokens, kind_words, class_words)
    flat = train(learned, shape, total)
    least = least_level(counts, "n", frequent)
    bounded = counts.filter((level(F.col("n")) >= least) & (F.col("word") != END)).select("word", "n").toArrow()
    also = pa.table({"word": [w for w, n in vocabulary if w != END and n], "n": pa.array([n for w, n in vocabulary if w != END and n], pa.int64())}, schema=bounded.schema)
    both = pa.concat_tables([bounded, also]).group_by("word").aggregate([("n", "max")]).select(["word", "n_max"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, both.schema) as out:
        out.write_table(both)
    looked_up = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    scored = written(
        given.mapInArrow(
            _scorer(shape, flat, looked_up), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, cold array<string>"
        ),
        "lm-scored",
    )
    rare = counts.filter(level(F.col("n")) < least)
    cold = scored.select("row", F.explode("cold").alias("word")).join(rare, "word").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("cold_base"), F.count(F.lit(1)).alias("cold_known")
    )
    more = F.coalesce("cold_base", F.lit(0.0))
    nothing = F.log10(F.lit(float(total + distinct + 1)))
    return scored.join(cold, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * nothing).alias("base_score"), (F.col("score") + more).alias("score"),
    )
