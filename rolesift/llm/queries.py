"""The registered query of every operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolesift.llm.alignment import align
from rolesift.llm.chat import format_windows, read_windows
from rolesift.llm.common import documents, shared_folder, written
from rolesift.llm.decontaminate import contained_items
from rolesift.llm.fingerprints import edited_fingerprints, near_links
from rolesift.llm.language import held_out, identify, learn_profiles
from rolesift.llm.language_model import score_documents
from rolesift.llm.licenses import scan_licenses
from rolesift.llm.ngram_join import near_classes
from rolesift.llm.oracle import ORACLE
from rolesift.llm.packing import pack
from rolesift.llm.pii import find_spans
from rolesift.llm.prefix_trie import prefix_trie
from rolesift.llm.sharding import shard_documents
from rolesift.llm.token_files import read_token_files, write_token_files


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back from them."""
    folder = shared_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data in every document, and the disclosing terms around them."""
    return find_spans(documents(spark, sf_dir)).drop("text_key")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack(documents(spark, sf_dir))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return shard_documents(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and licence notice it holds."""
    return scan_licenses(documents(spark, sf_dir))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edited_fingerprints(documents(spark, sf_dir))


def fingerprint_near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 6: class and links of each document by the bands of its fingerprint, verified."""
    return near_links(documents(spark, sf_dir))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class of near copies and its number of links."""
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it contains."""
    return contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, written and read back; one more is made of control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return read_windows(written(format_windows(turns), "chat-windows"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs.filter(~held_out()))
    texts = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(texts, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of two tokenizers meet in every document, and how usual its links are in the corpus."""
    return align(documents(spark, sf_dir))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document under counts and under the recurrent model, learned from the others."""
    return score_documents(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations after the shared beginnings are put in."""
    return prefix_trie(documents(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_personal_data": op2_personal_data,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_license_scan": op5_license_scan,
    "op6_document_fingerprints": op6_document_fingerprints,
    "fingerprint_near_links": fingerprint_near_links,
    "op7_ngram_join": op7_ngram_join,
    "op9_chat_windows": op9_chat_windows,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_language_model": op12_language_model,
    "op13_prefix_trie": op13_prefix_trie,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
}
