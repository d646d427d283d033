"""Benchmark items inside documents: size-partitioned MinHash containment, exact check after it.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.llm.common import SHINGLE_WORDS, SIMILAR_AT, bounded_side, word_form, written

RECALL = 0.999
#: The smallest size class of the windows; a class holds the items of more than half as many shingles as it says.
LEAST_CLASS = 8
#: Items of at most so many shingles are looked up by single shingles, without windows.
SMALL_ITEM = LEAST_CLASS // 2


def _words(text: Column) -> Column:
    return F.array_remove(F.split(word_form(text), " "), "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def _runs(words: Column, n: int, make) -> Column:
    """``make`` of each run of n words; of all words when there are fewer; none without words."""
    count = F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.size(words) - n + 1, F.lit(1)))
    starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    return F.slice(F.transform(starts, lambda i: make(F.slice(words, i, n))), F.lit(1), count)


def _hashed(text: Column, n: int) -> Column:
    """The hashed shingles of a text in order."""
    return _bound(F.transform(_words(text), lambda w: F.xxhash64(w)), lambda words: _runs(words, n, F.xxhash64))


def _strings(text: Column, n: int) -> Column:
    """The distinct shingles of a text."""
    return _bound(_words(text), lambda words: F.array_distinct(_runs(words, n, lambda run: F.concat_ws(" ", run))))


def _hash_count(containment: float, recall: float) -> int:
    """Hash functions that retrieve a contained item with the wanted probability.

    An item of q shingles, s/2 < q <= s, lies whole in a window of 2 s shingles. At containment c their
    Jaccard similarity is c q / (2 s + q - c q) at least, least at q = s/2; each hash function
    finds the item with that probability.
    """
    least = containment / (4 + 1 - containment)
    return math.ceil(math.log(1 - recall) / math.log1p(-least))


def _minima(n: int) -> list[Column]:
    return [F.min(F.hash("gram", F.lit(k))).alias(f"h{k}") for k in range(n)]


def _signature_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.array(*(F.col(f"h{k}") for k in range(n)))).alias("fn", "value"))


def _least_grams(containment: float) -> Column:
    """The item's least hashed shingles, so many that a document without any of them lacks too much of the item.

    To hold ``need`` of n shingles a document must hold one of any n - need + 1 of them.
    """
    n = F.size("grams")
    need = F.greatest(F.ceil(F.lit(containment) * n - 1e-9).cast("int"), F.lit(1))
    return F.slice(F.array_sort("grams"), F.lit(1), n - need + 1)


def contained_items(
    docs: DataFrame, items: DataFrame, containment: float = SIMILAR_AT,
    n_words: int = SHINGLE_WORDS, recall: float = RECALL,
) -> DataFrame:
    """(doc_id, text) and (item_id, text) to doc_id, item_id, n_item, n_shared, containment.

    A row says that the document holds at least ``containment`` of the item's distinct shingles (five
    words in lower case, letters and digits only).

    Items are partitioned by size into classes of powers of two. For a class of size s the shingles of every
    document are dealt into blocks of s, and two neighbouring blocks make a window of 2 s: an item of
    that class lies whole inside a window, and item and window never differ much in size, however long the
    document. Item and window are candidates when the minima of one of the hash functions agree; their
    number follows from the least Jaccard similarity a contained item can have with its window
    (recall 0.999 in that worst case). Items of at most four shingles differ too much from any such window; of them
    the least hashes alone are the signature, as many as make every document that holds the item
    show one (one at 0.8), and they meet the documents' shingles: nothing is missed. Candidates are verified on the words themselves.

    Plan: documents are shuffled once, by a row key; block minima and windows then need no further
    exchange. Small items cost one more pass over the shingles, where there are any. Item signatures are broadcast when
    their counted size is below a bound, else both sides are shuffled.

    Cases: null or wordless documents contain nothing; null or wordless items are in no document; an item of fewer than
    five words is one shingle, matched where a document consists of these words alone or has them as its only shingle. Repeated
    rows give a result row each; a null doc_id or item_id is kept. No rows on a side give no rows.
    """
    n = _hash_count(containment, recall)
    listed = written(
        items.select("item_id", "text").withColumn("item_key", F.monotonically_increasing_id())
        .select(
            "item_key", "item_id", _strings(F.col("text"), n_words).alias("item_shingles"),
            F.array_distinct(_hashed(F.col("text"), n_words)).alias("grams"),
        )
        .filter(F.size("grams") > 0)
        .withColumn(
            "size_class",
            F.greatest(F.lit(LEAST_CLASS), F.pow(F.lit(2.0), F.ceil(F.log2(F.size("grams"))))).cast("int"),
        ),
        "benchmark-items",
    )
    small_item = F.size("grams") <= SMALL_ITEM
    sizes = listed.groupBy("size_class", small_item.alias("small")).count().collect()  # powers of two: a few dozen at most
    classes = sorted({r["size_class"] for r in sizes if not r["small"]})
    item_minima = (
        listed.filter(~small_item).select("item_key", "size_class", F.explode("grams").alias("gram"))
        .groupBy("item_key", "size_class").agg(*_minima(n))
    )
    item_rows = written(_signature_rows(item_minima, n, "item_key", "size_class"), "benchmark-signatures")

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc_key"))
    least = classes[0] if classes else LEAST_CLASS
    # hashed once, for the blocks of the least class; larger blocks are made of those
    small_minima = (
        keyed.select("doc_key", "text").repartition("doc_key")
        .select("doc_key", F.posexplode(_hashed(F.col("text"), n_words)).alias("at", "gram"))
        .groupBy("doc_key", F.floor(F.col("at") / least).cast("int").alias("small")).agg(*_minima(n))
    )
    blocks = F.array(
        *(F.struct(F.lit(s).alias("size_class"), F.floor(F.col("small") / (s // least)).cast("int").alias("block")) for s in classes or [least])
    )
    block_minima = (
        small_minima.select("doc_key", F.inline(blocks), *(f"h{k}" for k in range(n)))
        .groupBy("doc_key", "size_class", "block").agg(*(F.min(f"h{k}").alias(f"h{k}") for k in range(n)))
    )
    following = W.partitionBy("doc_key", "size_class").orderBy("block")
    windows = block_minima.select(
        "doc_key", "size_class",
        *(F.least(f"h{k}", F.lead(f"h{k}").over(following)).alias(f"h{k}") for k in range(n)),
    )
    found = (
        _signature_rows(windows, n, "doc_key", "size_class")
        .join(bounded_side(item_rows, 40), ["size_class", "fn", "value"])
        .select("doc_key", "item_key").distinct()
    )
    if any(r["small"] for r in sizes):
        signs = written(
            listed.filter(small_item).select("item_key", F.explode(_least_grams(containment)).alias("gram")), "benchmark-small-items"
        )
        shown = (
            keyed.select("doc_key", F.explode(_hashed(F.col("text"), n_words)).alias("gram"))
            .join(bounded_side(signs, 24), "gram").select("doc_key", "item_key").distinct()
        )
        found = found.unionByName(shown) if classes else shown
    candidates = written(found, "benchmark-candidates")
    own = listed.select("item_key", "item_id", "item_shingles")
    verified = (
        keyed.join(bounded_side(candidates, 32), "doc_key")
        .join(bounded_side(own, F.length(F.concat_ws("", "item_shingles")) + 64), "item_key")
        .select(
            "doc_id", "item_id", F.size("item_shingles").alias("n_item"),
            F.size(F.array_intersect("item_shingles", _strings(F.col("text"), n_words))).alias("n_shared"),
        )
    )
    return verified.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= containment - 1e-9)


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that hold no benchmark item. Columns stay as they are."""
    slim = docs.select("doc_id", "text")
    # the query's rows name doc_id only; a null doc_id is matched by its text
    found = contained_items(slim.withColumn("doc_id", F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("k"))), items, **settings)
    hit = written(found.select(F.col("doc_id.doc_id").alias("_hit_id"), F.col("doc_id.k").alias("_hit_key")).distinct(), "benchmark-hits")
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.md5(F.coalesce(F.col("text"), F.lit(""))) == F.col("_hit_key"))
    return docs.join(bounded_side(hit, 64), same, "left_anti")
