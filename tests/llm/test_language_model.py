"""The recurrent language model: counts and likelihoods against a plain walk, gradients against differences."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rolesift.llm import language_model as lm
from rolesift.llm.common import prepare
from rolesift.llm.queries import QUERIES


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), lm.END]


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def kind(word):
    return (not word.isascii()) + 2 * bool(re.search("[0-9]", word)) + 4 * bool(re.search(r"[\W_]$", word))


def plain_shape(rows, classes, class_words):
    counts = Counter(t for doc, text in rows if not is_held(doc) for t in tokens(text))
    top = sorted((w for w in counts if w != lm.END), key=lambda w: (-counts[w], w))[: classes * class_words - 1]
    vocabulary = sorted([(w, counts[w]) for w in top] + [(lm.END, counts[lm.END])], key=lambda w: (-w[1], w[0]))
    rest = [w for w in counts if w != lm.END and w not in set(top)]
    kind_tokens = [sum(counts[w] for w in rest if kind(w) == k) for k in range(lm.KINDS)]
    return counts, lm.Shape(vocabulary, kind_tokens, [sum(kind(w) == k for w in rest) for k in range(lm.KINDS)], class_words)


def plain_score(words, counts, shape, flat):
    """Natural terms only: one state a document, one token after the other."""
    p = {k: v.astype(np.float64) for k, v in shape.views(flat).items()}
    place = {w: k for k, w in enumerate(shape.words)}
    h, before, total, n = np.zeros(shape.hidden), shape.end, 0.0, shape.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for w in words:
        own, pushed = p["inputs"][before], h @ p["state"]
        z, r = sigmoid(own[:n] + pushed[:n]), sigmoid(own[n : 2 * n] + pushed[n : 2 * n])
        new = np.tanh(own[2 * n :] + r * pushed[2 * n :])
        h = (1 - z) * new + z * h
        first = h @ p["class"] + p["class_bias"]
        first -= math.log(np.exp(first).sum())
        if w in place:
            c, k = divmod(place[w], shape.class_words)
            inside = (h @ p["word"][c] + p["word_bias"][c])[: shape.size - c * shape.class_words]
            total += first[c] + inside[k] - math.log(np.exp(inside).sum())
            before = place[w]
        else:
            k = kind(w)
            total += first[shape.classes + k] + math.log((counts[w] + 1) / (shape.kind_tokens[k] + shape.kind_words[k] + 1))
            before = shape.size + k
    return total / math.log(10)


def rows():
    draw = random.Random(8)
    vocabulary = ["The", "the", "cat.", "x1", "é", "ÉTÉ", "_", "a b", "o'clock", "\x1fz", *("w" * k for k in range(1, 30)), *(f"r{k}" for k in range(40))]
    out = [(k, draw.choice([" ", "\n", "\t\x0b "]).join(draw.choice(vocabulary[: 5 + k % 70]) for _ in range(draw.randint(0, 60)))) for k in range(120)]
    return [*out, (200, None), (201, ""), (202, " \n "), (None, "no id"), (203, "the " * 3000), (204, "twice"), (204, "twice"), (7, "unseen9 wörter here")]


@pytest.mark.parametrize(("frequent", "classes", "class_words"), [(1 << 18, 3, 4), (10, 2, 3), (0, 32, 32)])
def test_scores_equal_a_plain_walk(spark, monkeypatch, frequent, classes, class_words):
    prepare(spark)
    counts, shape = plain_shape(rows(), classes, class_words)
    flat = shape.begin(3)
    flat += np.random.default_rng(1).standard_normal(len(flat)).astype(np.float32) * 0.2
    monkeypatch.setattr(lm, "train", lambda *a: flat)
    monkeypatch.setattr(lm, "HELD_TOKENS", 400)
    monkeypatch.setattr(lm, "SCORE_STREAMS", 5)
    docs = spark.createDataFrame([(*r, "own", 5) for r in rows()], "doc_id long, text string, word string, n int").repartition(3)
    got = sorted((tuple(r) for r in lm.score_documents(docs, frequent, classes, class_words).collect()), key=lambda r: (r[0] or -1, r[2], r[5]))
    total = sum(counts.values())
    expected = []
    for doc, text in rows():
        words = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words)
        expected.append((doc, is_held(doc), len(words), sum(counts[w] > 0 for w in words), total, base, plain_score(words, counts, shape, flat)))
    expected.sort(key=lambda r: (r[0] or -1, r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5] for r in got], [r[5] for r in expected])
    assert np.allclose([r[6] for r in got], [r[6] for r in expected], rtol=1e-4, atol=1e-3)


def test_no_rows_and_nothing_to_learn_from(spark):
    prepare(spark)
    docs = spark.createDataFrame([(k, "a b") for k in range(40) if is_held(k)], "doc_id long, text string")
    assert lm.score_documents(docs.limit(0)).isEmpty()
    for r in lm.score_documents(docs).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_next_tokens_share_one():
    _, shape = plain_shape(rows(), 3, 4)
    model = lm.Model(shape, shape.begin(2))
    h = np.random.default_rng(2).standard_normal((1, shape.hidden)).astype(np.float32)
    every = np.arange(shape.size + lm.KINDS)
    logs, _ = model.output(np.repeat(h, len(every), axis=0), every)
    assert abs(np.exp(logs).sum() - 1) < 1e-5


def test_gradient_equals_differences():
    draw = np.random.default_rng(3)
    _, shape = plain_shape(rows(), 2, 3)
    shape.hidden = 4
    shape = lm.Shape(list(zip(shape.words, shape.counts, strict=True)), list(shape.kind_tokens), list(shape.kind_words), 3, 4)
    flat = (draw.standard_normal(shape.total) * 0.5).astype(np.float32)
    steps, streams = 5, 3
    x, y = (draw.integers(0, shape.size + lm.KINDS, (steps, streams)) for _ in range(2))
    keep = np.ones((steps, streams), np.float32)
    keep[2, 1] = 0
    inside = np.ones((steps, streams), bool)
    inside[4, 2] = False
    h = draw.standard_normal((streams, 4)).astype(np.float32)

    def loss(at):
        model = lm.Model(shape, at)
        return -model.output(model.states(x, keep, h)[inside], y[inside])[0].sum()

    gradient = np.zeros_like(flat)
    lm.Model(shape, flat).learn_window(x, y, keep, inside, h, shape.views(gradient), 1.0)
    for k in draw.choice(shape.total, 150, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-2
        down[k] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - gradient[k]) < 2e-2 * max(1, abs(gradient[k]))


def test_held_out_documents_are_likelier_than_by_counts(spark):
    found = [r for r in QUERIES["op12_language_model"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in found) > 0.97 * sum(r["base_score"] for r in found)
    assert np.mean([r["score"] > r["base_score"] for r in found]) > 0.95


def test_every_learning_document_reaches_the_gradient(spark, monkeypatch, tmp_path):
    """Each document is learned from in exactly one round, whatever its digest."""
    prepare(spark)
    folder = str(tmp_path)

    def learner(shape, flat, rate):
        def run(batches):
            import uuid

            texts = [t for batch in batches for t in batch.column(0).to_pylist()]
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.writelines(f"{t}\n" for t in texts)
            yield from ()

        return run

    monkeypatch.setattr(lm, "_learner", learner)
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    _, shape = plain_shape(rows(), 3, 4)
    lm.train(docs, shape, 600)
    learned = sorted(line for file in tmp_path.iterdir() for line in file.read_text().splitlines())
    assert learned == sorted(f"text {k}" for k in range(200))


def test_a_learner_shuffles_its_weights_as_they_are():
    import pyarrow as pa

    rows = [(n, f"red widget {n % 3} hot plate") for n in range(40)]
    _, shape = plain_shape(rows, 4, 4)
    batch = pa.RecordBatch.from_arrays([pa.array([text for _, text in rows])], ["text"])
    parts = [b for flat in (shape.begin(1), shape.begin(2)) for b in lm._learner(shape, flat, 0.01)(iter([batch]))]
    assert sum(len(p) for b in parts for p in b.column(2).to_pylist()) == 2 * 4 * shape.total
    by_chunk = sorted(parts, key=lambda b: b.column(0)[0].as_py())
    (out,) = lm._averaged(iter(by_chunk))
    half = len(parts) // 2
    whole = [np.frombuffer(b"".join(b.column(2)[0].as_py() for b in own), "<f4") for own in (parts[:half], parts[half:])]
    assert np.allclose(np.frombuffer(b"".join(out.column(1).to_pylist()), "<f4"), (whole[0] + whole[1]) / 2, atol=1e-6)


def test_bounds_of_all_classes_equal_those_of_each():
    """One pass over the word classes finds each one's own bound, the last and shorter one's too."""
    _, shape = plain_shape(rows(), 3, 5)
    shape = lm.Shape(list(zip(shape.words, shape.counts, strict=True))[:13], list(shape.kind_tokens), list(shape.kind_words), 5)
    flat = shape.begin(4) + np.random.default_rng(4).standard_normal(shape.total).astype(np.float32)
    model = lm.Model(shape, flat)
    top, safe = lm._bounds(model.p["word"], model.p["word_bias"], model._empty)
    each = [lm._bound(model.p["word"][c][:, : 13 - 5 * c], model.p["word_bias"][c][: 13 - 5 * c]) for c in range(3)]
    assert np.allclose(top, [t for t, _ in each])
    assert safe.tolist() == [s for _, s in each]


def test_a_trace_leaves_the_states_as_they_are():
    """Learning and scoring walk the same steps, and the trace holds the gates and states of each."""
    draw = np.random.default_rng(6)
    _, shape = plain_shape(rows(), 3, 4)
    model = lm.Model(shape, (draw.standard_normal(shape.total) * 0.3).astype(np.float32))
    x, keep = draw.integers(0, shape.size + lm.KINDS, (7, 3)), np.ones((7, 3), np.float32)
    keep[0], keep[4, 1] = 0, 0
    n = shape.hidden
    h = draw.standard_normal((3, n)).astype(np.float32)
    trace = before, gates, new, _ = tuple(np.empty((7, *own, 3, n), np.float32) for own in ((), (2,), (), ()))
    out = model.states(x, keep, h, trace)
    assert (out == model.states(x, keep, h)).all()
    assert np.allclose(before[1:], out[:-1] * keep[1:, :, None], atol=1e-6) and (before[0] == 0).all()
    assert np.allclose(out, gates[:, 0] * before + (1 - gates[:, 0]) * new, atol=1e-5)
