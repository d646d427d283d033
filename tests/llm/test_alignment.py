"""Cross-tokenizer alignment against a plain walk along both token lists."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rolesift.llm import alignment
from rolesift.llm.common import prepare
from rolesift.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain(rows, tokenizers):
    a, b = tokenizers
    chars = byte_level()
    out, all_links = [], []
    for doc, text in rows:
        want = f" {text or ''}".encode()
        ids_a = a.encode(f" {text or ''}", add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            out.append([doc, 0, 0, 0, ""])
            all_links.append(Counter())
            continue
        groups, links, i, j, end_a, end_b = [([], [])], Counter(), 0, 0, 0, 0
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b and i < len(ids_a):
                groups[-1][0].append(ids_a[i])
                end_a += len(bytes_a[i])
                i += 1
            else:
                groups[-1][1].append(ids_b[j])
                end_b += len(bytes_b[j])
                j += 1
            if end_a == end_b:
                groups.append(([], []))
        groups = [g for g in groups if g[0]]
        for g in groups:
            links.update((x, y) for x in g[0] for y in g[1])
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([doc, len(ids_a), len(ids_b), len(groups), hashlib.sha256(told.encode()).hexdigest()])
        all_links.append(links)
    counts = Counter(p for links in all_links for p in links)
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (doc, n_a, n_b, n, sum(links.values()), sum(k for p, k in links.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in links.items()), digest)
            for (doc, n_a, n_b, n, digest), links in zip(out, all_links, strict=True)
        ),
        key=repr,
    )


def awkward():
    draw = random.Random(4)
    parts = ["the ", "  ", "\n", "\t", "é", "ß", "中文", "\U0001f600", "a" * 40, "x́", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "don't ", "1234", " ", "\r\n", "İ."]
    rows = [(k, "".join(draw.choice(parts) for _ in range(draw.randint(1, 30)))) for k in range(200)]
    rows += [(300, None), (301, ""), (302, " "), (303, "a▁b"), (304, "\x00"), (305, "e" * 5000), (306, "the cat " * 3000), (None, "null id"), (307, "twice"), (307, "twice")]
    return rows


@pytest.mark.parametrize("frequent", [1 << 18, 5, 0])
def test_alignment_equals_a_plain_walk(spark, monkeypatch, tokenizers, frequent):
    monkeypatch.setattr(alignment, "GROUP_LINKS", 6)
    prepare(spark)
    docs = spark.createDataFrame([(*r, "own", 1) for r in awkward()], "doc_id long, text string, pair string, n int").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, frequent=frequent).collect()), key=repr)
    assert got == plain(awkward(), tokenizers)
    assert alignment.align(docs.limit(0), frequent=frequent).isEmpty()


def test_galloping_finds_the_first_not_less():
    draw = np.random.default_rng(1)
    for _ in range(200):
        long = np.unique(draw.integers(0, 500, draw.integers(1, 200)))
        short = np.sort(draw.integers(0, long[-1] + 1, draw.integers(1, 100)))
        guess = draw.integers(0, 300, len(short))
        assert (alignment.gallop(short, long, guess) == np.searchsorted(long, short)).all()


def test_ranks_give_the_ids_of_the_tokenizer(tokenizers):
    ranked = alignment.Ranked(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c} '{c}s\n" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    theirs = tokenizers[0].encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
    differ = [t for t, mine, e in zip(texts, ranked.encode(texts), theirs, strict=True) if mine.tolist() != e.ids]
    assert not differ, (len(differ), [hex(ord(c)) for c in differ[0] if ord(c) > 127][:3])


def test_query_equals_a_plain_walk(spark, tokenizers):
    small = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, small).collect()), key=repr) == plain(rows, tokenizers)
