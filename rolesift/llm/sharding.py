"""Shards of nearly equal bytes: the smallest capacity at which ordered groups still fit.

Only DataFrame and SQL functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.llm.common import bounded_side, text_key, written

SHARDS = 40
#: Equal texts always fall in one group; groups are the first four hex digits of the text's key.
GROUP_DIGITS = 4
#: Rows of a shard are numbered in so many cells.
CELLS = 1024
ROW_BYTES = 16


def group_shards(totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(grp, bytes), one row a group, to (grp, shard): the minimax contiguous partition.

    A group larger than an equal share of what is left has a shard of its own. For the others, in order of grp, the
    capacity is searched by bisection between the largest group (or the mean) and mean plus largest group: a
    capacity is feasible when filling shards greedily in order needs no more than there are. The order is then cut
    at the smallest feasible capacity, as near to equal shares as a feasible rest allows. The table has 65,536 rows at most, so one row
    holds it and the whole search is one SQL expression.
    """
    listed = written(
        totals.agg(F.sort_array(F.collect_list(F.struct("grp", "bytes"))).alias("every"))
        .selectExpr(
            "every",
            "array_sort(every, (a, b) -> CASE WHEN a.bytes <> b.bytes THEN IF(a.bytes > b.bytes, -1, 1) WHEN a.grp < b.grp THEN -1 WHEN a.grp > b.grp THEN 1 ELSE 0 END) AS falling",
            "aggregate(every, 0L, (s, x) -> s + x.bytes) AS total",
        ),
        "shard-groups",
    )
    parted = written(
        listed.selectExpr(
            "every", "falling",
            f"""aggregate(falling, named_struct('n', 0, 'left', total), (s, x) ->
                IF(s.n < {shards} - 1 AND x.bytes * ({shards} - s.n) > s.left,
                   named_struct('n', s.n + 1, 'left', s.left - x.bytes), s)) AS large""",
        ).selectExpr(
            "slice(falling, 1, large.n) AS alone", f"{shards} - large.n AS many", "large.left AS left",
            "IF(large.n = 0, every, array_sort(slice(falling, large.n + 1, size(falling)))) AS rest",
        ),
        "shard-parted",
    )
    most = "array_max(transform(rest, x -> x.bytes))"
    bounds = written(
        parted.selectExpr("*", f"coalesce(greatest({most}, CAST(ceil(left / many) AS BIGINT)), 0L) AS low", f"coalesce({most} + CAST(ceil(left / many) AS BIGINT), 0L) AS high"),
        "shard-bounds",
    )
    used = """aggregate(rest, named_struct('n', 1, 'held', 0L), (s, x) ->
        IF(s.held + x.bytes <= (b.low + b.high) div 2,
           named_struct('n', s.n, 'held', s.held + x.bytes), named_struct('n', s.n + 1, 'held', x.bytes)), s -> s.n)"""
    searched = written(
        bounds.selectExpr(
            "alone", "rest", "many",
            f"""aggregate(sequence(1, 64), named_struct('low', low, 'high', high), (b, i) ->
                CASE WHEN b.low >= b.high THEN b
                     WHEN {used} <= many THEN named_struct('low', b.low, 'high', (b.low + b.high) div 2)
                     ELSE named_struct('low', (b.low + b.high) div 2 + 1, 'high', b.high) END, b -> b.high) AS capacity""",
        ),
        "shard-capacity",
    )
    # latest[j]: where a tail that still fits j shards may begin at the earliest
    tails = written(
        searched.selectExpr(
            "alone", "rest", "capacity", "many", "aggregate(rest, 0L, (s, x) -> s + x.bytes) AS total",
            """aggregate(reverse(rest), named_struct('held', 0L, 'first', -1, 'tails', CAST(array() AS array<int>)), (s, x) ->
                IF(s.held + x.bytes <= capacity, named_struct('held', s.held + x.bytes, 'first', x.grp, 'tails', s.tails),
                   named_struct('held', x.bytes, 'first', x.grp, 'tails', array_append(s.tails, s.first))), s -> s.tails) AS tails""",
        ),
        "shard-tails",
    )
    cut = written(
        tails.selectExpr(
            "alone", "rest",
            """aggregate(rest, named_struct('held', 0L, 'done', 0L, 'cuts', CAST(array() AS array<int>)), (s, x) ->
                IF(s.held + x.bytes > capacity
                   OR (s.held > 0 AND size(s.cuts) < many - 1
                       AND s.done + x.bytes / 2 > (size(s.cuts) + 1) * (total / many)
                       AND x.grp >= coalesce(get(tails, many - size(s.cuts) - 2), -1)),
                   named_struct('held', x.bytes, 'done', s.done + x.bytes, 'cuts', array_append(s.cuts, x.grp)),
                   named_struct('held', s.held + x.bytes, 'done', s.done + x.bytes, 'cuts', s.cuts)), s -> s.cuts) AS cuts""",
        ),
        "shard-cuts",
    )
    own = cut.select(F.posexplode("alone").alias("shard", "x")).select("x.grp", "shard")
    shared = cut.select(F.size("alone").alias("n"), "cuts", F.explode("rest").alias("x")).selectExpr(
        "x.grp", "n + size(filter(cuts, c -> c <= x.grp)) AS shard"
    )
    return own.union(shared)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text) to doc_id, size, text_crc32, law, shard, slot, grown_shard, one row a document.

    ``law`` is ``bytes``: sizes (UTF-8 bytes and 16 a row) are as equal as whole groups allow. Equal texts share a
    group and so a shard; ``slot`` counts the rows of a shard without gaps; ``grown_shard`` is null, as a further
    shard moves every cut.

    Plan: one pass over the texts writes four narrow columns; sizes are summed by group before anything else. Slots are row
    numbers inside 1,024 hashed cells of a shard plus the prefix sums of the cells' counts, so a
    group that holds a third of all rows is numbered by many tasks.

    Cases: null text has no bytes and groups with the empty text, crc 0. Repeated rows take a slot each. A null
    doc_id is kept. Fewer groups than shards leave shards empty. No rows give no rows.
    """
    grp = F.conv(F.substring(text_key(F.col("text")), 1, GROUP_DIGITS), 16, 10).cast("int")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            grp.alias("grp"),
        ),
        "shard-rows",
    )
    placed = written(group_shards(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), shards), "shard-placed")
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int")
    dealt = rows.join(bounded_side(placed, 16), "grp").withColumn("cell", cell)
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    bases = written(
        dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
        "shard-bases",
    )
    inside = W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("number", F.row_number().over(inside))
        .join(bounded_side(bases, 24), ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
