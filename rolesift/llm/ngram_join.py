"""Near copies by word n-grams: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm import shingles as S
from rolesift.llm.common import SHINGLE_WORDS, SIMILAR_AT, bounded_side, groups, slices, text_key, word_form, written
from rolesift.llm.components import components

RECALL = 0.999
HASHES = 144
#: A block holds about so many sets and so many n-grams; a unit compares two blocks.
BLOCK_SETS = 512
BLOCK_GRAMS = 1 << 20
DESCRIBED = "doc_id long, text_key string, set_key string, n_grams long, bands array<long>"


def describe(n_words: int, bands: int, rows: int, sign):
    """The set, its key and its bands of each text; ``sign`` makes signatures of shingle hashes and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            flat, offsets = S.shingle_hashes(batch.column(2), n_words)
            sets = S.sets_of(flat, offsets)
            keys = [
                hashlib.md5(s.tobytes()).hexdigest() if len(s) else "text-" + k
                for s, k in zip(sets, batch.column(1).to_pylist(), strict=True)
            ]
            bands_of = S.band_hashes(sign(flat, offsets), bands, rows)
            ends = np.arange(len(sets) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(keys, pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands_of.reshape(-1))),
                ],
                ["doc_id", "text_key", "set_key", "n_grams", "bands"],
            )

    return run


def _linked(similarity: float, n_words: int, lead: bool):
    """Links inside one unit: for each set its linked documents and the root it hangs on.

    With ``lead`` also the least doc_id among them, and how similar it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, 4):
            flat, offsets = S.shingle_hashes(unit.column(7).combine_chunks(), n_words)
            sets = S.sets_of(flat, offsets)
            side, rep, copies = (unit.column(k).to_numpy() for k in (4, 5, 6))
            left = np.flatnonzero(side != 1)
            right = np.flatnonzero(side != 0)
            sizes = np.array([len(s) for s in sets], dtype=np.float64)
            common = S.common_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.float64)
            union = sizes[left][:, None] + sizes[right][None, :] - common
            link = common >= similarity * union - 1e-9
            link &= rep[left][:, None] != rep[right][None, :]
            if not link.any():
                continue
            counts = np.zeros(len(sets), dtype=np.int64)
            counts[left] += link @ copies[right]
            if (side != 2).any():  # two different blocks; one block against itself sees both directions
                counts[right] += link.T @ copies[left]
            label = rep.copy()
            top = np.iinfo(np.int64).max
            more: list[pa.Array] = []
            if lead:
                first = unit.column(8).to_numpy()
                led, alike = np.full(len(sets), top), np.zeros(len(sets))
                jaccard = common / np.maximum(union, 1)
                for own, other, linked, share in ((left, right, link, jaccard), (right, left, link.T, jaccard.T)):
                    ids = np.where(linked, first[other][None, :], top)
                    at = ids.argmin(axis=1)
                    led[own], alike[own] = ids[np.arange(len(own)), at], share[np.arange(len(own)), at]
            while True:
                before = label.copy()
                label[left] = np.minimum(label[left], np.where(link, label[right][None, :], top).min(axis=1))
                label[right] = np.minimum(label[right], np.where(link, label[left][:, None], top).min(axis=0))
                if (before == label).all():
                    break
            use = counts > 0
            if lead:
                more = [pa.array(led[use]), pa.array(alike[use])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[use]), pa.array(counts[use]), pa.array(label[use]), *more],
                ["rep", "links", "root", *("lead_id", "jaccard")[: len(more)]],
            )

    return run


def near_classes(
    docs: DataFrame, similarity: float = SIMILAR_AT, n_words: int = SHINGLE_WORDS,
    recall: float = RECALL, hashes: int = HASHES,
) -> DataFrame:
    """(doc_id, text) to one row a document: doc_id, text_key, class_id, n_links, is_first.

    Two documents are linked when the Jaccard similarity of their sets of n-grams (words in lower
    case, letters and digits only) reaches ``similarity``; a class is a connected set of links and is named by
    its least doc_id; ``n_links`` counts the linked documents; ``is_first`` marks one row of each class.

    1. Each text gives its n-gram set, reduced to a key, and MinHash bands (recall 0.999 at the
       threshold). Equal sets collapse to one representative with a weight.
    2. One shuffle on the band hashes finds the buckets of two or more. A set weighs as much as its buckets
       hold; the heaviest of a bucket leads it, and a set's home is the heaviest leader of its own heaviest
       leader, so a group of near copies has one home. Homes that meet in a bucket are compared too, so every candidate pair
       lies in exactly one unit of work.
    3. Homes are split into blocks of bounded size; a unit compares two blocks on their full sets and
       returns a row for each member (its links and a root), never pairs.

    Cases: null text reads as empty. Texts without a word are alike only when equal. Repeated
    rows are copies of each other, one of them is first. A null doc_id is kept; its class is named by the
    least known doc_id, or null. Other columns are not looked at. No rows give no rows.
    """
    bands, rows = S.choose_bands(similarity, recall, hashes)
    a, b = S.permutations(bands * rows)
    described = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), word_form(F.col("text")).alias("form"))
        .mapInArrow(describe(n_words, bands, rows, lambda flat, offsets: S.signatures(flat, offsets, a, b)), DESCRIBED)
        .withColumn("row_id", F.monotonically_increasing_id()),
        "ngram-sets",
    )
    result = linked_rows(docs, described, similarity, n_words)
    # nulls sort last, so a class with a known doc_id starts with its least one
    first = result.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")).getField("row_id").alias("first_row")
    )
    return result.join(first, "component").select(
        "doc_id", "text_key", "class_id", "n_links", (F.col("row_id") == F.col("first_row")).alias("is_first")
    )


def linked_rows(docs: DataFrame, described: DataFrame, similarity: float, n_words: int, lead: bool = False) -> DataFrame:
    """Steps 2 and 3 of ``near_classes``: described texts to doc_id, text_key, row_id, component, class_id, n_links.

    ``lead`` adds leader_id, the least doc_id among a row and the rows linked to it, and its jaccard; doc_ids
    must be known then.
    """
    led_by = ["first_id"] if lead else []
    reps = written(
        described.groupBy("set_key")
        .agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"),
            F.min("text_key").alias("text_key"), F.first("bands").alias("bands"),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "ngram-reps",
    )
    placed = (
        reps.filter("n_grams > 0").select("rep", F.posexplode("bands").alias("band", "hash"))
    )
    shared = (
        placed.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    members = written(placed.join(shared, ["band", "hash"]), "ngram-members")
    # the most central set leads: the one that meets most others over all its buckets
    central = written(members.groupBy("rep").agg(F.sum("n").alias("weight")), "ngram-central")
    weighed = members.join(central, "rep").withColumn("lead", F.struct("weight", F.negative("rep").alias("back")))
    leaders = weighed.groupBy("band", "hash").agg(F.max("lead").alias("lead"))
    led = written(
        members.join(leaders, ["band", "hash"]).groupBy("rep").agg(F.max("lead").alias("lead"))
        .select("rep", F.negative("lead.back").alias("home")),
        "ngram-led",
    )
    # a set led by a member of another home moves there, so few homes meet
    homes = written(
        led.join(led.select(F.col("rep").alias("home"), F.col("home").alias("further")), "home")
        .select("rep", F.col("further").alias("home"))
        .join(reps.select("rep", "copies", "n_grams", "text_key", *led_by), "rep"),
        "ngram-homes",
    )
    sizes = written(
        homes.groupBy("home").agg(
            F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
        ),
        "ngram-blocks",
    )
    met = members.join(homes.select("rep", "home"), "rep").select("band", "hash", "home").distinct()
    several = met.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "hash")
    met = written(met.join(several, ["band", "hash"]), "ngram-met")
    across = (
        met.select("band", "hash", F.col("home").alias("home_a"))
        .join(met.select("band", "hash", F.col("home").alias("home_b")), ["band", "hash"])
        .filter("home_a < home_b").select("home_a", "home_b").distinct()
    )
    blocks_a = sizes.select(F.col("home").alias("home_a"), F.col("blocks").alias("blocks_a"))
    blocks_b = sizes.select(F.col("home").alias("home_b"), F.col("blocks").alias("blocks_b"))
    across = written(across.join(blocks_a, "home_a").join(blocks_b, "home_b"), "ngram-across")

    texts = docs.select(text_key(F.col("text")).alias("text_key"), word_form(F.col("text")).alias("form"))
    wanted = homes.select("rep", "home", "copies", "text_key", *led_by).join(sizes, "home")
    wanted = bounded_side(written(wanted, "ngram-wanted"), 96)
    work = written(
        texts.join(wanted, "text_key").groupBy("rep")
        .agg(*(F.first(c).alias(c) for c in ("home", "copies", "blocks", "form", *led_by)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")),
        "ngram-work",
    )
    # one home: block i meets every block j; a pair of blocks is one unit
    inside = work.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("home").alias("home_a"), F.col("home").alias("home_b"),
        F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        "rep", "copies", "form", *led_by,
    )
    parts = []
    for side, own, other in ((0, "a", "b"), (1, "b", "a")):
        met_by = across.withColumnRenamed(f"home_{own}", "home")
        parts.append(
            work.join(met_by, "home")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{other}") - 1)))
            .select(
                (F.col("home") if side == 0 else F.col("home_a")).alias("home_a"),
                (F.col("home") if side == 1 else F.col("home_b")).alias("home_b"),
                (F.col("block") if side == 0 else F.col("other")).alias("block_a"),
                (F.col("block") if side == 1 else F.col("other")).alias("block_b"),
                F.lit(side).alias("side"), "rep", "copies", "form", *led_by,
            )
        )
    unit = ["home_a", "home_b", "block_a", "block_b"]
    compared = inside.union(parts[0]).union(parts[1])
    found = written(
        compared.repartition(*unit).sortWithinPartitions(*unit)
        .mapInArrow(_linked(similarity, n_words, lead), "rep long, links long, root long" + ", lead_id long, jaccard double" * lead),
        "ngram-links",
    )
    linked = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = [F.min(F.struct("lead_id", "jaccard")).alias("least")] if lead else []
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"), *least)
    itself = F.col("least").isNull() | (F.col("first_id") <= F.col("least.lead_id"))
    leading = [
        F.when(itself, F.col("first_id")).otherwise(F.col("least.lead_id")).alias("leader_id"),
        F.when(itself, 1.0).otherwise(F.col("least.jaccard")).alias("jaccard"),
    ] if lead else []
    known = written(
        reps.select("set_key", "rep", "first_id", "copies")
        .join(totals, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "set_key", "first_id", F.coalesce("component", "rep").alias("component"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), *leading,
        ),
        "ngram-known",
    )
    names = known.groupBy("component").agg(F.min("first_id").alias("class_id"))
    return written(
        described.select("doc_id", "text_key", "row_id", "set_key").join(known, "set_key").join(names, "component")
        .select("doc_id", "text_key", "row_id", "component", "class_id", "n_links", *(("leader_id", "jaccard") if lead else ())),
        "ngram-classes",
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents with one of each class kept: its least doc_id. Columns stay as they are."""
    firsts = near_classes(docs, **settings).filter("is_first").select(
        F.col("doc_id").alias("_first_id"), F.col("text_key").alias("_first_key")
    )
    own = docs.withColumn("_own_key", text_key(F.col("text"))).withColumn("_own_id", F.col("doc_id").cast("long"))
    firsts = bounded_side(written(firsts, "ngram-firsts"), 64)
    kept = own.join(firsts, F.col("_own_key").eqNullSafe(F.col("_first_key")) & F.col("_own_id").eqNullSafe(F.col("_first_id")), "left_semi")
    # rows repeated whole carry the same key and number: one of them stays
    return kept.dropDuplicates(["_own_key", "_own_id"]).drop("_own_key", "_own_id")
