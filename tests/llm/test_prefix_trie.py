"""The conversation trie against a plain version, with narrow storeys and tiny shards."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from rolesift.llm import prefix_trie as trie
from rolesift.llm.common import prepare
from rolesift.llm.queries import QUERIES

SCHEMA = "conv_id long, turn int, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(role, text) for _, _, role, _, text in sorted(t)] for c, t in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), parent, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def mixed(n, turns, ids):
    draw = random.Random(n)
    rows = []
    for _ in range(n):
        c = draw.choice(ids)
        rows += [
            (c, draw.choice([t, t, t, None]), draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", None, "é"])) for t in range(draw.randint(1, turns))
        ]
    return rows


COPIES = [(c, t, "user", f"x{t}") for c in range(300) for t in range(7)] + [(7000, t, "user", str(t % 3)) for t in range(300)]
CASES = {
    "no rows": ([], 64, 1 << 24), "no conversation": ([(None, 1, "a", "b")], 64, 1 << 24), "no turns left": ([(5, 1, None, None)], 64, 1 << 24),
    "many shards": (mixed(60, 9, range(250)), 2, 300), "ids below zero": (mixed(200, 4, range(-120, 400)), 64, 2000),
    "copies and a long one": (COPIES, 100, 3000),
}


@pytest.mark.parametrize("case", CASES)
def test_trie_equals_a_plain_version(spark, monkeypatch, case):
    rows, storey, shard_bytes = CASES[case]
    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    prepare(spark)
    turns = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", depth string").repartition(4)
    assert sorted((tuple(r) for r in trie.prefix_trie(turns, storey, shard_bytes).collect()), key=repr) == plain(rows)


def test_query_equals_a_plain_version(spark):
    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, small).collect()), key=repr) == plain(rows)
