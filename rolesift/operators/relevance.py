"""Relevance scores: vector, lexical, few-shot, and hooks for plugged-in models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.constants import FEWSHOT_MIN_PER_CLASS, SEMANTIC_THRESHOLD
from rolesift.functions.normalize import clamp01
from rolesift.functions.text import overlap_cosine, tokenize, words
from rolesift.operators.dedup import top_per_key
from rolesift.session import written
from rolesift.sources.tables import Tables

BM25_K1, BM25_B = 1.2, 0.75
# Share of a query's term weight a document has to reach for a neutral score of 0.
BM25_NEUTRAL = 0.5


# --- vectors --------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float vectors, summed in double precision."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_score(
    items: DataFrame,
    queries: DataFrame,
    on: tuple[str, str],
    item_vector: str = "embedding",
    query_vector: str = "query_embedding",
) -> DataFrame:
    """Score each item against the query it was found for: cosine, clamped to [0, 1].

    ``on`` names the item's and the query's key. Items meet only their own
    query, so the work is linear in the items. The query vectors are written first:
    while their true size is below Spark's broadcast threshold items are not exchanged.
    """
    item_key, query_key = on
    joined = items.join(
        written(queries, "query-vectors"), F.col(item_key) == F.col(query_key)
    )
    score = clamp01(cosine(F.col(item_vector), F.col(query_vector)))
    return joined.select(*items.columns, score.alias("semantic_score"))


def passes_semantic(scored: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    return scored.filter(F.col("semantic_score") >= threshold)


def semantic_topk(scored: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The ``k`` best items per query."""
    order = [F.round("semantic_score", 9).desc(), F.col(item)]
    return top_per_key(scored, [query], order, k, rank="position")


def lexical_semantic(postings: DataFrame, keyword: str, title: str) -> DataFrame:
    """Vector-free stand-in for the semantic score: cosine of the two token sets."""
    score = overlap_cosine(tokenize(F.col(keyword)), tokenize(F.coalesce(title, F.lit(""))))
    return postings.withColumn("semantic_score", score)


# --- query/document pairs ---------------------------------------------------------
def pair_score_bm25(items: DataFrame, key: str, keyword: str, text: str) -> DataFrame:
    """(key, pair_score): BM25 of each text for its own keyword, shifted so 0 is neutral.

    The corpus is the given items. Texts are read twice: a first job counts the
    documents of each query term and writes the term weights of every keyword; the
    scores are then local to each row. The weights are joined by their true size, so
    Spark broadcasts them while they are below its threshold and texts stay where
    they are; beyond it the keyword is exchanged and skewed keywords are split.
    """
    docs = items.select(key, F.col(keyword).alias("_q"), words(F.col(text)).alias("_w"))
    query_terms = docs.select("_q").distinct().select(
        "_q", F.explode(tokenize(F.col("_q"))).alias("_term")
    )
    vocabulary = query_terms.select("_term").distinct()
    frequency = (
        docs.select(F.explode(F.array_distinct("_w")).alias("_term"))
        .join(vocabulary, "_term", "left_semi")
        .groupBy("_term").agg(F.count(F.lit(1)).alias("_df"))
    )
    corpus = docs.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("_w")).alias("length")).alias("_corpus")
    ).scalar()
    df = F.coalesce(F.col("_df"), F.lit(0))
    idf = F.log(1 + (F.col("_corpus.n") - df + 0.5) / (df + 0.5))
    weighted = query_terms.join(frequency, "_term", "left").withColumn("_corpus", corpus)
    weights = weighted.groupBy("_q").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_term").alias("term"), idf.alias("idf"))))
        .alias("_terms"),
        F.max("_corpus.length").alias("_avg"),
    )
    joined = docs.join(written(weights, "term-weights"), "_q", "left")
    spread = BM25_K1 * (1 - BM25_B + BM25_B * F.size("_w") / F.col("_avg"))

    def gain(term: Column) -> Column:
        tf = F.size("_w") - F.size(F.array_remove("_w", term["term"]))
        return term["idf"] * (tf * (BM25_K1 + 1) / (tf + spread) - BM25_NEUTRAL)

    score = F.aggregate("_terms", F.lit(0.0), lambda total, term: total + gain(term))
    return joined.select(key, F.coalesce(score, F.lit(0.0)).alias("pair_score"))


Scorer = Callable[[pd.DataFrame], "pd.Series"]


def run_scorer(
    items: DataFrame, key: str, columns: list[str], make: Callable[[], Scorer], name: str
) -> DataFrame:
    """(key, score) from a plugged-in model; ``make`` loads it once per Python worker task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for batch in batches:
            values = pd.Series(score(batch), dtype="float64").to_numpy()
            yield pd.DataFrame({key: batch[key].to_numpy(), name: values})

    return items.select(key, *columns).mapInPandas(run, f"{key} string, {name} double")


# --- few-shot title classifier ------------------------------------------------------
def training_counts(labels: DataFrame) -> DataFrame:
    """Usable accept / reject titles per profile (``unsure`` and blank titles do not count)."""
    usable = labels.filter(F.coalesce(F.col("title_norm"), F.lit("")) != "")
    return usable.groupBy("profile_id").agg(
        F.count_if(F.col("label") == "accept").alias("n_accept"),
        F.count_if(F.col("label") == "reject").alias("n_reject"),
    )


def trainable_profiles(labels: DataFrame, minimum: int = FEWSHOT_MIN_PER_CLASS) -> DataFrame:
    return training_counts(labels).filter(
        (F.col("n_accept") >= minimum) & (F.col("n_reject") >= minimum)
    )


class FewShot:
    """Per-profile title classifiers: smoothed log-odds of the words of accepted and rejected titles.

    The model is two tables, one row per (profile, word) and one per profile, counted with map-side
    combine; profiles share nothing and words are not hashed, so one profile never moves another.
    """

    def __init__(self, weights: DataFrame, profiles: DataFrame):
        self.weights, self.profiles = weights, profiles

    @classmethod
    def train(cls, labels: DataFrame) -> FewShot | None:
        """Counts the labelled titles; None when no profile has enough labels."""
        ready = written(
            trainable_profiles(labels).withColumn("bias", F.log((F.col("n_accept") + 1) / (F.col("n_reject") + 1))),
            "fewshot-profiles",
        )
        if ready.isEmpty():
            return None
        rows = labels.filter(
            F.col("label").isin("accept", "reject")
            & (F.coalesce(F.col("title_norm"), F.lit("")) != "")
        ).select("profile_id", "label", F.explode(tokenize(F.col("title_norm"))).alias("word"))
        seen = rows.groupBy("profile_id", "word").agg(
            F.count_if(F.col("label") == "accept").alias("a"), F.count_if(F.col("label") == "reject").alias("r")
        )
        weight = F.log((F.col("a") + 0.5) / (F.col("n_accept") + 1)) - F.log((F.col("r") + 0.5) / (F.col("n_reject") + 1))
        weights = seen.join(ready, "profile_id").select("profile_id", "word", weight.alias("weight"))
        return cls(written(weights, "fewshot-weights"), ready.select("profile_id", "n_accept", "n_reject", "bias"))

    @classmethod
    def load(cls, tables: Tables) -> FewShot | None:
        """The published classifiers; None when none were published or no profile had enough labels."""
        profiles = tables.read("fewshot_profiles")
        return None if profiles.isEmpty() else cls(tables.read("fewshot_weights"), profiles)

    def save(self, tables: Tables) -> None:
        """Publish both tables together, so readers never see the weights of one training with the profiles of another."""
        tables.publish({"fewshot_profiles": self.profiles, "fewshot_weights": self.weights})

    def predict(self, postings: DataFrame, key: str, title: str = "title") -> DataFrame:
        """(key, fewshot_score): P(relevant), and 1.0 for profiles without a model.

        ``key`` is unique. Words leave their row to meet the weights and are summed per key.
        """
        words_of = postings.select(key, "profile_id", F.explode(tokenize(F.coalesce(title, F.lit("")))).alias("word"))
        told = (
            words_of.join(self.weights, ["profile_id", "word"])
            .groupBy(key).agg(F.sum(F.round("weight", 12)).alias("_told"))
        )
        odds = F.col("bias") + F.coalesce("_told", F.lit(0.0))
        score = F.when(F.col("bias").isNotNull(), 1 / (1 + F.exp(-odds))).otherwise(1.0)
        rows = postings.select(key, "profile_id").join(self.profiles.select("profile_id", "bias"), "profile_id", "left").join(told, key, "left")
        return rows.select(key, score.alias("fewshot_score"))


def fewshot_scores(model: FewShot | None, postings: DataFrame, key: str) -> DataFrame:
    if model is None:
        return postings.select(key, F.lit(1.0).alias("fewshot_score"))
    return model.predict(postings, key)
