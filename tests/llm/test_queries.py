"""The registered queries on the smallest tables, and the pipeline against a plain version of itself."""

from __future__ import annotations

import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rolesift.llm.oracle import ORACLE
from rolesift.llm.queries import QUERIES
from tests.llm.test_operators import brute_classes, brute_spans, ids_of, shingles

SMALL = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4_minimax_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op6_document_fingerprints": [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ],
    "op7_ngram_join": ["doc_id", "class_id", "n_links"],
    "op9_chat_windows": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_give_their_columns(spark, name):
    got = QUERIES[name](spark, SMALL)
    assert got.columns == COLUMNS[name]
    if name == "op9_chat_windows":
        assert got.filter("conv_id = -7").first()["n_turns"] == 2
    elif name == "op3_best_fit_packing":
        assert got.select("doc_id").distinct().count() == 200
    else:
        assert got.count() == 200 and got.select("doc_id").distinct().count() == 200


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    theirs = sorted(repr(r) for r in result.fetchall())
    got = QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == theirs


def test_held_out_languages_are_found(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op10_language_id"](spark, SMALL).collect() if r["held_out"]]
    assert {r["doc_id"] for r in rows} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.98 * len(rows)


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in sorted(rows.items()) if re.search(r"[^\W\d_]", t)]
    first = {c for _, c, _ in brute_classes(left)}
    left = [(i, t) for i, t in left if i in first]
    left = [(i, t) for i, t in left if not any(len(q & shingles(t)) >= 0.8 * len(q) - 1e-9 for q in items)]
    expected = []
    for i, text in left:
        clean, at, covered = [], 0, 0
        for kind, a, b in brute_spans(text):
            if a >= covered:
                clean += [text[at:a], f"[{kind.upper()}]"]
            covered = at = max(covered, b)
        ids = np.array([*ids_of("".join((*clean, text[at:]))), 0], dtype="<u4")
        expected += [(i, k // 2048, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == expected
    held: dict = {}
    for r in got:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    assert max(held.values()) <= 2048


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).schema == docs.schema
        assert stage(spark, docs.limit(0), SMALL).isEmpty()


def test_language_stage_rejects_other_languages_and_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(6)
    polish = (
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i "
        "powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w "
        "niniejszej deklaracji bez względu na różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych."
    )
    finnish = (
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja "
        "heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa "
        "esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun, väriin tai muuhun perustuvaa erotusta."
    )
    hexed = " ".join("".join(draw.choice("0123456789abcdef") for _ in range(4)) for _ in range(300))
    letters = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(100))
    odd = spark.createDataFrame([(-1, polish), (-2, finnish), (-3, hexed), (-4, letters)], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(odd, allowMissingColumns=True), SMALL)
    clean = {r["doc_id"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == clean
