"""Every operator against a plain version of itself, on a small table of awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolesift.llm import chat, packing, pii, sharding
from rolesift.llm.common import prepare
from rolesift.llm.decontaminate import contained_items, drop_contaminated
from rolesift.llm.fingerprints import edited_fingerprints, near_links
from rolesift.llm.language import LEAST_QUANTILE, LEAST_SHARE, UNKNOWN, Profiles, held_out, identify, keep_identified, learn_least, learn_profiles
from rolesift.llm.licenses import TEMPLATES, scan_licenses
from rolesift.llm.ngram_join import keep_one, near_classes
from rolesift.llm.token_files import read_token_files, write_token_files

SCHEMA = "doc_id long, text string, lang string, class_id string, score string, block string, n_chars long"


def words(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n))


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    found = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {tuple(found[k : k + n]) for k in range(max(1, len(found) - n + 1))} if found else set()


def texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 120)
    near = base.split()
    near[40], near[90] = "changed", "again"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper() + "!"), (5, words(2, 80)), (6, None), (7, ""), (8, "!!! ..."),
        (9, "!!! ..."), (10, "one two three"), (11, "One, two three."), (12, words(3, 20000)), (13, words(4, 60) + " " + words(9, 30) + " " + words(5, 60)),
        (13, words(4, 60) + " " + words(9, 30) + " " + words(5, 60)), (None, words(6, 50)), (None, None), (14, "é" * 300), (15, "a\nb\tc  d e f"),
        (16, "Mail a.b@c.example.org or +1 (234) 555-0199, host 10.0.0.1, card 4111 1111 1111 1111."),
    ]
    # a group of near copies of many different texts
    for k in range(60):
        own = base.split()
        own[2 * k] = f"own{k}"
        rows.append((100 + k, " ".join(own)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t, "xx", "own", "own", "own", None if t is None else len(t)) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return prepare(spark).createDataFrame([], SCHEMA)


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            same = sets[a] or sets[b]
            if (common >= 0.8 * len(sets[a] | sets[b]) - 1e-9) if same else (rows[a][1] or "") == (rows[b][1] or ""):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    low = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return [(rows[k][0], low[find(k)], links[k]) for k in range(len(rows))]


def test_classes_and_links_equal_brute_force(docs):
    got = near_classes(docs)
    rows = [tuple(r) for r in got.select("doc_id", "class_id", "n_links").collect()]
    expected = brute_classes(texts())
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    firsts = got.filter("is_first").groupBy("class_id").count().filter("count > 1 and class_id is not null")
    assert firsts.isEmpty()


def test_keep_one_keeps_columns_and_one_of_each_class(docs, none):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 5, 8, 10, 12, 13, 14, 15, 16} <= set(ids) and not {2, 3, 4, 9, 11, 100, 159} & set(ids)
    assert ids.count(13) == 1 and sum(i in (6, 7) for i in ids) == 1
    assert keep_one(none).isEmpty() and near_classes(none).isEmpty()


def test_bands_are_compared_across_homes(spark):
    """A chain: each text is linked to the next only."""
    own = words(20, 200).split()
    rows = []
    for k in range(12):
        rows.append((k, " ".join(own)))
        for j in range(4):
            own[(k * 17 + 4 * j * 5) % 200] = f"new{k}x{j}"
    got = near_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes(rows))


def test_contained_items_equal_brute_force(spark, docs, none):
    cut = words(2, 80).split()
    items = [
        (1, words(9, 30)), (2, " ".join(cut[10:40])), (3, words(77, 25)), (4, None), (5, ""), (6, "one two three"),
        (7, " ".join(words(3, 20000).split()[15000:15064])), (8, words(9, 27) + " zz yy xx"), (None, words(6, 50)), (9, words(9, 30)),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contained_items(docs, frame).collect()}
    expected = set()
    for i, t in texts():
        for j, q in items:
            own = shingles(q)
            if own and len(own & shingles(t)) >= 0.8 * len(own) - 1e-9:
                expected.add((i, j))
    assert got == expected
    left = drop_contaminated(docs, frame)
    assert left.columns == docs.columns
    hit = {i for i, _ in expected}
    assert sorted(r[0] for r in left.filter("doc_id is not null").select("doc_id").collect()) == sorted(i for i, _ in texts() if i is not None and i not in hit)
    assert left.filter("doc_id is null").count() == 1  # one of the two was hit
    assert contained_items(none, frame).isEmpty() and contained_items(docs, frame.limit(0)).isEmpty()
    assert drop_contaminated(docs, frame.limit(0)).count() == docs.count()


def test_small_items_are_all_found(spark):
    """Items of five to twelve words inside long texts, next to each other and alone; other containments too."""
    items = [(k, words(500 + k, 5 + k % 8)) for k in range(160)]
    rows = [(k, f"{words(900 + k, 50)} {text} {words(1900 + k, 50)}") for k, text in items]
    rows += [(200, items[0][1]), (201, None), (202, ""), (203, " ".join(text for _, text in items)), (204, items[3][1] + " extra")]
    rows += [(205, " ".join(items[2][1].split()[:-1]))]  # two of three shingles
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for containment in (0.8, 0.6):
        expected = set()
        for i, t in rows:
            held = shingles(t)
            for j, q in items:
                own = shingles(q)
                if len(own & held) >= containment * len(own) - 1e-9:
                    expected.add((i, j))
        small = {j for j, q in items if len(q.split()) <= 8}
        got = {(r["doc_id"], r["item_id"]) for r in contained_items(docs, asked, containment).collect()}
        assert {p for p in got if p[1] in small} == {p for p in expected if p[1] in small}
        assert got <= expected and len(got) >= 0.99 * len(expected)
    assert contained_items(docs, asked.filter("item_id = 0")).count() == 3
    assert contained_items(docs.limit(0), asked).isEmpty()


def test_decontamination_runs_no_python(spark, docs):
    frame = spark.createDataFrame([(1, words(9, 30))], "item_id long, text string")
    plan = contained_items(docs, frame)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_licenses_equal_plain_search(spark, none):
    filler = words(30, 200)
    rows = [(k, f"{words(40 + k, 3 * k)} {t[2]}. {filler}") for k, t in enumerate(TEMPLATES)] + [(90, filler), (91, None), (92, TEMPLATES[2][2])]
    rows += [(93, f"{filler} {filler} Licensed under the Apache Licence, Version 3.0"), (None, TEMPLATES[0][2])]
    got = {(r["doc_id"], r["template"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = set()
    for i, t in rows:
        for name, _, text in TEMPLATES:
            own = shingles(text)
            if len(own & shingles(t)) >= 0.8 * len(own) - 1e-9:
                expected.add((i, name))
    assert got == expected
    assert scan_licenses(none).isEmpty()


def test_fingerprints(docs, none):
    got = {r["doc_id"]: r for r in edited_fingerprints(docs.filter("doc_id <> 13")).collect()}
    rows = sorted(((i, t or "") for i, t in texts() if i is not None and i != 13), reverse=True)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        row = got[i]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        assert abs(row["near_edited"] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"]
    assert edited_fingerprints(docs).count() == docs.count() and edited_fingerprints(none).isEmpty()
    assert edited_fingerprints(docs.filter("doc_id = 5")).first()["near_next"] == 1.0


def test_near_links_are_verified(docs, none):
    rows = {(r["doc_id"], r["leader_id"]) for r in near_links(docs).collect()}
    by_id = dict(texts())
    assert {(2, 1), (3, 1), (4, 1), (11, 10)} <= rows
    for a, b in rows:
        x, y = shingles(by_id[a]), shingles(by_id[b])
        assert len(x & y) >= 0.8 * len(x | y) - 1e-9
    assert near_links(none).isEmpty()


def test_near_links_equal_brute_force(spark, docs):
    def linked(rows):
        got = near_links(prepare(spark).createDataFrame(rows, "doc_id long, text string")).collect()
        own = [(i, t) for i, t in rows if i is not None and shingles(t)]
        expected = [r for r in brute_classes(own) if r[2]]
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == sorted(expected)
        for r in got:
            x, others = shingles(dict(own)[r["doc_id"]]), []
            for i, t in own:
                y = shingles(t)
                if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                    others.append((i, len(x & y) / len(x | y)))
            assert (r["leader_id"], round(r["jaccard"], 9)) == min((i, round(j, 9)) for i, j in others)

    linked(texts())
    # documents of lower doc_id, below 0.8 to all others, come first in every bucket that two near copies share
    rows = []
    for k in range(10):
        middle = words(300 + k, 150).split()
        last = middle.copy()
        last[75] = "last"
        for v in range(12):
            other = middle.copy()
            for j in (10, 45, 80, 115):
                other[j + 2 * v] = f"other{v}x{j}"
            rows.append((20 * k + v, " ".join(other)))
        rows += [(20 * k + 12, " ".join(middle)), (20 * k + 13, " ".join(last))]
    linked(rows)


def ids_of(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    from rolesift.llm.tokens import vocabulary_path

    return Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    from rolesift.llm.tokens import Encoder

    odd = [
        None, "", "a  b c\x1cd <|endoftext|>x", "<|ENDOFTEXT|>.", "́a ́b İstanbul ΣΑΣ Σ", "1234 don't 'll", "a.b.c, x", "H̱ T̈. x",
        "a,'b \"q\"... é. ≮ x≮", "é,é̀.", "A's a-'s", "x\t\ty z w", "ßẞ Ａ", words(5, 400),
    ]
    flat, offsets = Encoder().encode(pa.array(odd, pa.string()))
    for k, text in enumerate(odd):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == ids_of(text), repr(text)


def test_encoder_equals_the_tokenizer_on_letters_and_marks():
    import unicodedata

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from rolesift.llm.tokens import Encoder

    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    # one of many for ideographs and syllables, which have no case
    letters = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L" and (c < 0x2E00 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x20000 or c % 97 == 0)]
    texts = ["".join(f"{c}{m}" for m in marks) for c in letters] + ["Tİ, Aİ.", "ÇELİK-İŞ, BELEDİYESİ.", "aİ'S"]
    draw = random.Random(11)
    alphabet = [*"abcXYZ 019.,'-<|>\n\t", *"éÉßİıñΣσςЖ中か한\u0301\u0307\u0338\u0327\u200d\u00a0\u2028😀", "<|endoftext|>", "'s", "don't", "naïve", "L'été", "ﬁ", "K", "Å"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 24))) for _ in range(100_000)]
    tokenizer, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Encoder()
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        flat, offsets = mine.encode(pa.array(part))
        for k, e in enumerate(tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            assert flat[offsets[k] : offsets[k + 1]].tolist() == e.ids, repr(part[k])


def test_batches_may_be_slices_of_larger_ones():
    import pyarrow as pa

    from rolesift.llm import shingles
    from rolesift.llm.common import slices
    from rolesift.llm.tokens import Encoder

    every = [words(k, 5 + 7 * k) + " É. x" for k in range(40)] + [None, ""]
    coder = Encoder()
    for kind in (pa.string(), pa.large_string()):
        whole = pa.RecordBatch.from_arrays([pa.array(every, kind)], ["t"])
        flat, offsets = coder.encode(whole.column(0))
        forms = pa.RecordBatch.from_arrays([pa.array([shingles.words_of(t or "") for t in every], kind)], ["t"])
        grams, at = shingles.shingle_hashes(forms.column(0))
        got, got_grams = [], []
        for part in slices(iter([whole]), 0, 700):
            own, bounds = coder.encode(part.column(0))
            got += [own[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for part in slices(iter([forms]), 0, 700):
            own, bounds = shingles.shingle_hashes(part.column(0))
            got_grams += [own[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got_grams == [grams[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_token_files_round_trip(spark, docs, none, tmp_path):
    root = str(tmp_path / "tokens")
    write_token_files(docs, root)
    got = [tuple(r) for r in read_token_files(spark, root).drop("part").collect()]
    start, expected = 0, []
    for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*ids_of(t), 2], dtype="<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    write_token_files(none, str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).isEmpty()


def test_packing_places_every_piece(docs, none):
    rows = packing.pack(docs, length=256).collect()
    by_key: dict = {}
    for i, t in texts():
        ids = np.array([*ids_of(t), 0], dtype="<u4")
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            by_key.setdefault((i, k // 256, k, len(part), zlib.crc32(part.tobytes())), []).append(1)
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows))) == sorted(repr(k) for k, v in by_key.items() for _ in v)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(r["length"] for r in rows) // 256)
    assert len(sequences) <= 1.03 * least + 1
    assert packing.pack(none).isEmpty()


def test_packing_plan_is_tight():
    draw = np.random.default_rng(3)
    for n in (1, 7, 400, 30000):
        sizes = np.clip(draw.lognormal(6, 1, n).astype(int), 1, 2048)
        histogram = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True), strict=True)}
        plan = packing.Plan(histogram)
        assert plan.sequences <= 1.02 * sizes.sum() / 2048 + 2


def test_nnls_meets_its_conditions():
    draw = np.random.default_rng(1)
    for _ in range(20):
        matrix, target = draw.random((12, 30)), draw.random(12)
        x = packing.nnls(matrix, target)
        slope = matrix.T @ (target - matrix @ x)
        assert (x >= 0).all() and slope.max() < 1e-5 and np.abs(slope[x > 0]).max() < 1e-5


def test_shards(spark, docs, none):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    where: dict = {}
    for r in rows:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    assert all(len(s) == 1 for s in where.values())
    known = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert known[6]["size"] == 16 and known[6]["text_crc32"] == 0 and known[14]["size"] == 616
    assert known[14]["text_crc32"] == zlib.crc32(("é" * 300).encode())
    assert sharding.shard_documents(none).isEmpty()


def greedy(sizes, capacity):
    used, held = 1, 0
    for x in sizes:
        used, held = (used, held + x) if held + x <= capacity else (used + 1, x)
    return used


def test_shard_capacity_is_the_least_feasible(spark):
    draw = random.Random(4)
    sizes = [draw.randint(1, 400) for _ in range(500)]
    frame = prepare(spark).createDataFrame(list(enumerate(sizes)), "grp int, bytes long")
    shards = {r["grp"]: r["shard"] for r in sharding.group_shards(frame, 12).collect()}
    assert [shards[k] for k in range(500)] == sorted(shards.values())
    loads = [sum(s for k, s in enumerate(sizes) if shards[k] == n) for n in range(12)]
    least = next(c for c in range(max(sizes), sum(sizes)) if greedy(sizes, c) <= 12)
    assert max(loads) <= least and min(loads) > 0.8 * sum(sizes) / 12
    hot = prepare(spark).createDataFrame([*enumerate(sizes), (900, 60000)], "grp int, bytes long")
    shards = {r["grp"]: r["shard"] for r in sharding.group_shards(hot, 12).collect()}
    assert sum(s == shards[900] for s in shards.values()) == 1 and len(set(shards.values())) == 12


def brute_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum((n := int(c) * (1 + k % 2)) - 9 * (n > 9) for k, c in enumerate(reversed(s))) % 10 == 0

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_equal_the_patterns():
    draw = random.Random(2)
    for _ in range(20000):
        text = "".join(draw.choice("a@.-+1 2(9%_é\n") for _ in range(draw.randrange(40)))
        assert pii.base_spans(text) == brute_spans(text), repr(text)
    assert pii.base_spans("1" * 50000) == [] and pii.base_spans("a" * 50000) == []


def test_personal_data_of_awkward_rows(docs, none):
    rows = pii.find_spans(docs).collect()
    assert len(rows) == len(texts())
    by_id = dict(texts())
    for r in rows:
        base = brute_spans(by_id[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and r["spans"] == pii.joined(base)
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert clean[16]["text"] == "Mail [EMAIL] or [PHONE], host [IP], card [CARD]." and clean[16]["n_chars"] == len(clean[16]["text"])
    assert clean[6]["text"] is None and clean[5]["text"] == by_id[5] and clean[1]["class_id"] == "own"
    assert pii.sanitise(docs).schema == docs.schema
    assert pii.find_spans(none).isEmpty() and pii.sanitise(none).isEmpty()


def test_disclosing_terms_are_found_and_clean_ones_left(spark):
    rows = []
    for k in range(200):
        rows.append((k, f"{words(500 + k, 30)} common words here {words(900 + k, 10)}"))
    for k in range(4):  # a name that is only seen near one address, in different surroundings
        rows.append((300 + k, f"{words(700 + k, 30)} please write wilhelmina common at w.b@mail.example.com now {words(800 + k, 30)}"))
    for k in range(4):  # copies of one text prove nothing
        rows.append((400 + k, f"{words(99, 30)} onlyhere other@mail.example.com {words(98, 30)}"))
    for k in range(12):  # nor do near copies
        own = f"{words(97, 60)} nearhere third@mail.example.com {words(96, 60)}".split()
        own[5 * k] = own[121 - 4 * k] = f"own{k}"
        rows.append((500 + k, " ".join(own)))
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(frame).collect()}
    text = dict(rows)[300]
    at = text.index("wilhelmina")
    assert f"remove:{at}:{at + 10}" in spans[300].split(",")
    common = text.index("common")
    assert not any(s.split(":")[1] == str(common) for s in spans[300].split(","))
    assert spans[400].count(":") == 2 and all(not spans[k] for k in range(200))
    assert all(spans[500 + k].count(":") <= 2 for k in range(12))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert "wilhelmina" not in clean[301] and "[EMAIL]" in clean[301] and clean[7] == dict(rows)[7]


@pytest.mark.parametrize("told_bytes", [1 << 24, 0])
def test_families_vote_once_and_terms_go_everywhere(spark, monkeypatch, told_bytes):
    monkeypatch.setattr(pii, "TOLD_BYTES", told_bytes)
    rows = [(k, f"{words(500 + k, 30)} common words here") for k in range(200)]
    for k in range(4):  # the name stands far from the address
        rows.append((300 + k, f"wilhelmina common {words(700 + k, 60)} w.b@mail.example.com {words(800 + k, 10)}"))
    rows += [(400 + k, rows[203][1]) for k in range(60)]  # one of them is copied often
    rows.append((500, f"{words(950, 20)} Wilhelmina, without the address"))
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.find_spans(frame).collect()}
    assert all("remove:0:10" in spans[k] for k in (300, 301, 302, 303, 400, 459))
    at = rows[-1][1].index("Wilhelmina")
    assert f"remove:{at}:{at + 10}" in spans[500]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert not any("wilhelmina" in t.lower() for t in clean.values())
    assert all("common words here" in clean[k] for k in range(200))


def test_edited_copies_are_one_witness(spark):
    """Twelve copies of one text, each with every twelfth word changed, are below 0.8 to each other and still prove nothing."""
    base = f"{words(41, 60)} edited@mail.example.com {words(42, 60)}".split()
    rows = [(k, f"{words(2000 + k, 40)} common words here") for k in range(200)] + [(300, " ".join(base))]
    for k in range(12):
        own = [f"own{k}x{i}" if i % 12 == k and "@" not in w else w for i, w in enumerate(base)]
        rows.append((301 + k, " ".join(own)))
    for k in range(4):  # independent texts with one address tell on the name as before
        rows.append((400 + k, f"{words(2400 + k, 40)} wilhelmina {words(2500 + k, 12)} w.b@mail.example.com"))
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string")

    def sets(text):
        ws = re.sub(r"[\W_]+", " ", text).split()
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}

    own = [sets(t) for d, t in rows if 301 <= d < 313]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(own) for b in own[:i])
    told = {r["term"] for r in pii.disclosing_terms(frame, pii._search(frame), 0.5, 0.8).collect()}
    assert told == {"wilhelmina"}
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(frame).collect()}
    assert all(spans[300 + k].count(":") == 2 for k in range(13)) and all(not spans[k] for k in range(200))


@pytest.mark.parametrize("few_bytes", [1 << 25, 0])
def test_told_pairs_equal_a_plain_count(spark, monkeypatch, few_bytes):
    """Families, the ratio and the test against chance, counted one by one; words and addresses meet at random and by rule."""
    monkeypatch.setattr(pii, "BROADCAST_BYTES", few_bytes)  # without it all terms are counted
    draw = random.Random(21)
    filler = words(31, 400).split()
    rows = []
    for k in range(240):
        body = [draw.choice(filler) for _ in range(25)]
        if k % 3 == 0:
            who = draw.randrange(12)
            body += [f"w{who}@mail.example.com", *([f"name{who}"] if draw.random() < 0.8 else []), f"other{who % 5}"]
        rows.append((k, " ".join(body)))
    rows += [(300 + k, rows[3][1]) for k in range(30)]
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = {(r["value"], r["term"]): (r["action"], r["disclosure"]) for r in pii.disclosing_terms(frame, pii._search(frame), 0.5, 0.8).collect()}
    families, own = {}, []  # equal texts are the only near copies here
    for _, text in rows:
        values = {f"email:{m}" for m in re.findall(r"w\d+@mail\.example\.com", text)}
        if values and text in families:
            continue
        families[text] = True
        every = set(re.sub(r"[\W_]+", " ", text).split())
        outside = set(re.sub(r"\S+@\S+", " ", text).split()) if values else set()
        own.append((values, {t for t in every if len(t) >= 3}, {t for t in outside if len(t) >= 3}))
    total = len(own)
    pairs = {}
    for v in {v for values, _, _ in own for v in values}:
        n_v = sum(v in values for values, _, _ in own)
        for t in {t for values, _, outside in own if v in values for t in outside}:
            n_t, both = sum(t in every for _, every, _ in own), sum(v in values and t in outside for values, _, outside in own)
            if n_v >= 3 and both >= 3 and n_t <= n_v**0.5 * total**0.5 + 1e-6:
                pairs[v, t] = n_v, n_t, both
    expected = {}
    for pair, (n_v, n_t, both) in pairs.items():
        ratio = min(1.0, np.log2(both * total / n_v / n_t) / -np.log2(n_v / total))
        a, p = both / n_v, n_t / total
        surprise = n_v * (a * np.log(a / p) + ((1 - a) * np.log((1 - a) / (1 - p)) if a < 1 else 0)) if a > p else 0
        if ratio >= 0.5 and surprise >= np.log(len(pairs) / pii.BY_CHANCE):
            expected[pair] = ("remove" if ratio >= 0.8 else "generalise", ratio)
    assert expected and set(told) == set(expected) and not any(t in filler for _, t in told)
    assert all(told[k][0] == expected[k][0] and abs(told[k][1] - expected[k][1]) < 1e-9 for k in expected)


def test_language_of_awkward_rows(spark, docs, none):
    draw = random.Random(5)
    rows = []
    for k in range(120):
        lang, letters = (("aa", "abcde"), ("bb", "efghi"), ("çç", "çéïab"))[k % 3]
        rows.append((k, " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(40)), lang))
    rows += [(500, None, "aa"), (501, "123 !!", "bb"), (502, words(3, 10), None)]
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = learn_profiles(frame.filter(~held_out()))
    assert sorted(profiles) == ["aa", "bb", "çç"]
    got = {r["doc_id"]: r for r in identify(frame.withColumn("score", F.lit("x")), profiles).collect()}
    held = [r for r in rows[:120] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 10 and all(got[i]["lang_pred"] == lang for i, _, lang in held)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == UNKNOWN and got[500]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = keep_identified(frame, profiles)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {500, 501}
    assert identify(docs, {}).filter(F.col("lang_pred") != UNKNOWN).isEmpty()
    assert learn_profiles(none) == {} and identify(none, profiles).isEmpty() and keep_identified(none, profiles).isEmpty()
    assert identify(docs, profiles).count() == docs.count()


def test_language_is_learned_from_every_labelled_document(spark):
    """More than 2,000 documents a language: those with the greatest hashes of doc_id count too."""
    n = 2400
    last = (F.xxhash64("id").cast("double") / F.lit(2.0**64) + 0.5) * n >= 2000
    frame = prepare(spark).range(n).select(
        F.col("id").alias("doc_id"), F.when(last, "zzzz " * 8).otherwise("abc abd abe " * 4).alias("text"), F.lit("aa").alias("lang")
    )
    late = frame.filter(F.col("text").startswith("z")).count()
    assert late > 100
    profiles = learn_profiles(frame)
    assert (ord("z") << 42 | ord("z") << 21 | ord("z")) in profiles["aa"]
    few = {"aa": [g for g in profiles["aa"] if g != ord("z")]}
    model = Profiles(few)
    scores = [model.predict(t)[1] for t in [" zzzz zzzz zzzz "] * late + [" abc abd abe abc "[:15] + " "] * (n - late)]
    assert abs(learn_least(frame, few)[16] - LEAST_SHARE * np.quantile(scores, LEAST_QUANTILE)) < 1e-9


def test_labels_have_to_be_a_language_column(spark):
    frame = spark.range(1200).selectExpr("id AS doc_id", "'a b' AS text", "CAST(id AS string) AS lang")
    with pytest.raises(ValueError, match="labels"):
        learn_profiles(frame)


def conversations():
    draw = random.Random(8)
    rows = [(1, 0, "system", "Be [INST] kind"), (1, 1, "user", None), (1, 2, "assistant", "</s>\\"), (2, None, None, "odd"), (2, 0, "tool", "<|end|>")]
    rows += [(None, 0, "user", "who"), (None, 1, "assistant", "nobody"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    for k in range(40):
        rows.append((4, k, "system" if not k else ("user", "assistant")[k % 2], words(k, draw.randint(1, 60))))
    rows.append((5, 0, "assistant", words(77, 3000)))
    return rows


def test_chat_round_trip_and_budget(spark, none):
    frame = prepare(spark).createDataFrame(conversations(), "conv_id long, turn long, role string, text string").withColumn("window_no", F.lit("own"))
    windows = chat.format_windows(frame, budget=300, history_tokens=120).cache()
    got = {r["conv_id"]: r for r in chat.read_windows(windows).collect()}
    by_conv: dict = {}
    for c, t, r, x in sorted(conversations(), key=lambda v: (repr(v[0]), -1 if v[1] is None else v[1], v[2] or "", v[3] or "")):
        by_conv.setdefault(c, []).append((r or "", x or ""))
    assert len(got) == len(by_conv)
    for c, turns in by_conv.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    many = [r for r in windows.filter("conv_id = 4").orderBy("window_no").collect()]
    assert len(many) > 2 and all(r["n_tokens"] <= 300 for r in many)
    assert all(r["text"].startswith("<<SYS>>") and r["n_repeated"] >= 1 for r in many[1:])
    assert got[4]["formatted_chars"] == sum(len(r["text"]) for r in many)
    windows.unpersist()
    empty = frame.limit(0)
    assert chat.read_windows(chat.format_windows(empty)).isEmpty()


def test_turns_parse_back():
    draw = random.Random(0)
    for _ in range(5000):
        turns = [(draw.choice(["user", "assistant", "system", "tool", "<|x", ""]), "".join(draw.choice("<>[]/\\s |INST\n") for _ in range(draw.randrange(12)))) for _ in range(draw.randrange(5))]
        text = "".join("".join(chat.format_turn(*t)) for t in turns)
        assert [(r, chat.unescape(text[a:b])) for r, a, b in chat.parse_turns(text)] == turns
