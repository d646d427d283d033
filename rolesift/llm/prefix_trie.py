"""The trie of all conversations: padded matrices of turn ids, sorted and cut into nodes in numpy.

A turn's id is 128 bits of the digest of its role and text, so equal turns have equal ids everywhere. Conversations are
cut into storeys of ``STOREY`` turns; a storey is a table of (key of all turns before it, path of turn ids). Range shards of
its sorted paths are matrices with a row a path, padded with zeros. Nodes on the first and the last row
of a shard may go on in another one; these alone are put together across shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rolesift.llm.common import bounded_side, written

#: Turns a storey; a bound on the width of the matrices and on what is gathered for a conversation at once.
STOREY = 64
#: Bytes of a shard's matrix.
SHARD_BYTES = 16 << 20
#: Joined conv_ids that are handed on in one piece when the list of a sequence crosses partitions.
PIECE_IDS = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ID = 16


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key (16 bytes), chars of every turn; nulls of turn first, ties by role and digest.

    Turns are dealt into ranges of (conv_id, turn) and counted there; only conversations that cross a range
    need a base, at most one a range, so no conversation is gathered and the bases are broadcast.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, _ID).alias("key"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            at = np.arange(len(conv)) - np.repeat(first, np.diff(np.append(first, len(conv))))
            if conv[0] == last:
                at[: first[1] if len(first) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(conv), pa.int32()), pa.array(at), batch.column(1), batch.column(2)],
                ["conv_id", "part", "at", "key", "chars"],
            )

    counted = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "chars")
        .mapInArrow(count, "conv_id long, part int, at long, key binary, chars long"),
        "trie-turns",
    )
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = counted.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = runs.select("conv_id", "part", F.sum("n").over(before).alias("base")).filter("base > 0")
    return counted.join(F.broadcast(bases), ["conv_id", "part"], "left").select(
        "conv_id", (F.coalesce("base", F.lit(0)) + F.col("at")).alias("pos"), "key", "chars"
    )


def rebuilt_turns(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, len), (turns: conv_id, depth from 1, key, chars) after the shared beginning is put in.

    The first h turns of conversation ``c - c % 100`` (floor, also below zero), then c's own after its first h.
    """
    lens = written(ordered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "trie-convs")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = lens.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(100))).alias("from_id"))
    roots = lens.filter(F.pmod("conv_id", F.lit(100)) == 0).select(F.col("conv_id").alias("from_id"), F.col("own").alias("theirs"))
    convs = written(
        convs.join(roots, "from_id", "left").select(
            "conv_id", "from_id", "h", F.least("h", F.coalesce("theirs", F.lit(0))).alias("taken"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("kept")
        ),
        "trie-plan",
    )
    heads = ordered.filter((F.col("pos") < 5) & (F.pmod("conv_id", F.lit(100)) == 0)).select(F.col("conv_id").alias("from_id"), "pos", "key", "chars")
    begun = convs.filter("taken > 0").join(heads, "from_id").filter("pos < taken").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "chars")
    own = ordered.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "chars"
    )
    return convs.select("conv_id", (F.col("taken") + F.col("kept")).alias("len")), begun.unionByName(own)


_PIECE = pa.schema([
    ("seq", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("digest", pa.string()), ("piece", pa.binary()), ("part", pa.int32()), ("at", pa.int32()),
])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) rows to one row a sequence; the first and the last of a partition stay in pieces."""
    part = TaskContext.get().partitionId()
    seq, ids, at, whole = None, [], 0, False  # whole: the sequence has begun here and fits one piece
    out: list[dict] = []

    def close(last: bool) -> None:
        nonlocal ids, at, whole
        piece = ",".join(map(str, ids)).encode()
        done = whole and not last
        digest = hashlib.sha256(piece).hexdigest() if done else None
        out.append({"seq": seq, "n": len(ids), "least": ids[0], "digest": digest, "piece": None if done else piece, "part": part, "at": at})
        ids, at, whole = [], at + 1, False

    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != seq:
                if ids:
                    close(False)
                whole, seq, at = seq is not None, own, 0
            elif len(ids) == PIECE_IDS:
                whole = False
                close(True)
            ids.append(conv)
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, _PIECE)
            out = []
    if ids:
        close(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECE)


def _joined_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (seq, part, at) to one row a sequence; the digest runs along the pieces."""
    held, state = None, None
    out: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held is not None and held["seq"] == r["seq"]:
                state.update(b",")
                held["n"] += r["n"]
            else:
                if held is not None:
                    out.append(held | {"digest": state.hexdigest()})
                held, state = {"seq": r["seq"], "n": r["n"], "least": r["least"]}, hashlib.sha256()
            state.update(r["piece"])
    if held is not None:
        out.append(held | {"digest": state.hexdigest()})
    schema = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("digest", pa.string())])
    yield pa.RecordBatch.from_pylist(out, schema)


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, seq) to one row a distinct sequence: seq, n, least, digest of its ascending conv_ids.

    Members are dealt into ranges of (seq, conv_id), so those of one sequence may fill many partitions. A sequence inside
    one is done there; of the others only joined pieces meet, in order.
    """
    parts = written(
        convs.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
        .mapInArrow(_digests, "seq binary, n long, least long, digest string, piece binary, part int, at int"),
        "trie-members",
    )
    columns = ("seq", "n", "least", "digest")
    joined = (
        parts.filter("digest is null").repartition("seq").sortWithinPartitions("seq", "part", "at")
        .select("seq", "n", "least", "piece").mapInArrow(_joined_digest, "seq binary, n long, least long, digest string")
    )
    return written(parts.filter("digest is not null").select(*columns).unionByName(joined), "trie-sequences")


_NODE = (
    "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "edge boolean, node binary, parent binary, chars long, alive boolean, above array<binary>, root binary"
)
_NODE_TYPES = (
    pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.binary(),
)


def _matrix(paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """High and low halves of the ids, zero-padded, rows in order; the row lengths and the order."""
    paths = paths.cast(pa.large_binary())
    _, ends, data = paths.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64)[paths.offset : paths.offset + len(paths) + 1] // _ID
    flat = np.frombuffer(data, dtype=">u8")[: 2 * int(bounds[-1])].reshape(-1, 2).astype(np.uint64)
    size = np.diff(bounds)
    width = int(size.max())
    inside = np.arange(width) < size[:, None]
    halves = []
    for half in (0, 1):
        padded = np.zeros((len(size), width), dtype=np.uint64)
        padded[inside] = flat[int(bounds[0]) : int(bounds[-1]), half]
        halves.append(padded)
    high, low = halves
    # the last key leads: the first column is compared first, a shorter row precedes its continuations
    order = np.lexsort((size, *(m[:, c] for c in range(width - 1, -1, -1) for m in (low, high))))
    return high[order], low[order], size[order], order


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    high, low, size, order = _matrix(table.column("path").combine_chunks())
    rows, width = high.shape
    number = {c: table.column(c).to_numpy()[order] for c in ("n", "least", "more_children", "more_leaves", "more_saved")}
    chars = np.zeros((rows, width), dtype=np.int64)  # of the turn that leads to a column; none leads to the first
    lists = table.column("chars").combine_chunks().take(pa.array(order))
    inside = np.arange(width) < size[:, None]
    chars[:, 1:][inside[:, 1:]] = lists.flatten().to_numpy()
    alive = table.column("alive").to_numpy(zero_copy_only=False)[order]
    path, ends = table.column("path").take(pa.array(order)), table.column("ends").take(pa.array(order)).to_pylist()

    # a node starts where any column up to its own differs from the row above
    changed = np.ones((rows, width), dtype=bool)
    changed[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    starts = np.logical_or.accumulate(changed, axis=1) & inside
    edge_paths = {0: path[0].as_py(), rows - 1: path[rows - 1].as_py()}

    def name(row: int, depth: int) -> bytes:
        return hashlib.blake2b(edge_paths[row][: _ID * (depth + 1)], digest_size=_ID).digest()

    levels = []
    for depth in range(width):
        own = np.flatnonzero(inside[:, depth])
        cut = np.flatnonzero(starts[own, depth])
        edges = {}  # node of this depth: the row that names it
        if inside[0, depth]:
            edges[0] = 0
        if inside[-1, depth]:
            edges.setdefault(len(cut) - 1, rows - 1)
        levels.append((own, cut, edges))
    inner = starts.copy()
    for depth, (own, cut, edges) in enumerate(levels):
        inner[own[cut[list(edges)]], depth] = False
    last = size - 1
    extended = np.zeros(rows, dtype=bool)
    extended[:-1] = ~np.logical_or.accumulate(changed, axis=1)[np.arange(1, rows), last[:-1]]
    leaves = number["more_leaves"] + (inner[np.arange(rows), last] & ~extended & ~alive)
    saved = number["more_saved"].copy()
    ended = np.full((rows,), -1)
    ended[:] = last

    found, aggregated = [], {}
    for depth in range(width - 1, -1, -1):
        own, cut, edges = levels[depth]
        first = own[cut]
        n = np.add.reduceat(number["n"][own], cut)
        least = np.minimum.reduceat(number["least"][own], cut)
        size_here = chars[first, depth]
        kept = np.ones(len(cut), dtype=bool)
        kept[list(edges)] = False
        saved[first[kept]] += ((n - 1) * size_here)[kept]
        ends_here = ended[first] == depth
        below = inner[own, depth + 1] if depth + 1 < width else np.zeros(len(own), dtype=np.int64)
        children = np.add.reduceat(below.astype(np.int64), cut) + np.where(ends_here, number["more_children"][first], 0)
        aggregated[depth] = (first, least, edges)
        found.append((depth, first, n, least, children, np.add.reduceat(leaves[own], cut), np.add.reduceat(saved[own], cut), size_here, ends_here, edges))

    for depth, first, n, least, children, n_leaves, total, size_here, ends_here, edges in found:
        count = len(first)
        parent_conv, parent = np.zeros(count, dtype=np.int64), [None] * count
        hidden = np.ones(count, dtype=bool)
        if depth:
            above_first, above_least, above_edges = aggregated[depth - 1]
            at = np.searchsorted(above_first, first, side="right") - 1
            parent_conv, hidden = above_least[at], np.isin(at, list(above_edges))
            for node, row in above_edges.items():
                for k in np.flatnonzero(at == node).tolist():
                    parent[k] = name(row, depth - 1)
        node, above = [None] * count, [None] * count
        for k, row in edges.items():
            node[k] = name(row, depth)
            above[k] = [name(row, d) for d in range(depth + 1)]
        is_edge = np.zeros(count, dtype=bool)
        is_edge[list(edges)] = True
        columns = (
            np.full(count, depth), least, pa.array(parent_conv, mask=hidden), n, children, n_leaves, total,
            [ends[r] if e else None for r, e in zip(first.tolist(), ends_here.tolist(), strict=True)], is_edge, node, parent, size_here,
            ends_here & alive[first], above, [path[r].as_py()[:_ID] if depth == 0 else None for r in first.tolist()],
        )
        yield pa.RecordBatch.from_arrays(
            [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)],
            [c.split()[0] for c in _NODE.split(", ")],
        )


def storey_nodes(rows: DataFrame, width: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All nodes of a storey: its paths in range shards, the nodes on shard edges put together.

    ``rows``: path (key of the turns before, then turn ids), chars, n, least, ends, alive and what lies below
    the end of a path that goes on (more_children, more_leaves, more_saved). Depth 0 is the storey's top.
    """
    shards = max(1, -(-rows.count() * (width + 1) * _ID // shard_bytes))
    nodes = written(rows.repartitionByRange(shards, "path").mapInArrow(_shard, _NODE), "trie-nodes")
    parts = nodes.filter("edge").groupBy("node").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends"),
        F.max("chars").alias("chars"), F.max("alive").alias("alive"), F.first("above").alias("above"), F.first("root").alias("root"),
    )
    # as many rows as shards have depths, twice
    parts = written(parts, "trie-edges")
    split = parts.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("also"))
    whole = parts.join(split, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("also", F.lit(0))).drop("also")
    own = whole.select(
        F.explode("above").alias("node"), ((F.col("n_children") == 0) & ~F.col("alive")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    ).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    columns = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "root")
    # a hot parent would gather its children in one task, and so would the nodes without a parent here
    names = bounded_side(parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("edge_conv")), 64)
    edges = (
        whole.join(own, "node").join(names, "parent", "left")
        .withColumns({
            "n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saved"), "parent_conv_id": F.col("edge_conv"),
        }).select(*columns)
    )
    inner = nodes.filter("not edge").join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "edge_conv"))
    return inner.select(*columns).unionByName(edges)


def prefix_trie(turns: DataFrame, storey: int = STOREY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(conv_id, turn, role, text) to a row a node of the trie of the rebuilt conversations.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    1. Turns are numbered (``ordered_turns``) and the shared beginnings put in (``rebuilt_turns``).
    2. Equal conversations, however many, become one sequence with its number of members (``distinct_sequences``).
    3. Storeys of ``storey`` turns are worked off from the deepest up, each as range shards (``storey_nodes``); what
       lies below the end of a path is joined to it by the key of its turns. Conversations of usual
       length have one storey.

    Cases: rows without conv_id belong to no conversation. Null role or text reads as empty, a null turn comes first, turns with one
    number are ordered by role and digest, repeated rows are repeated turns. A conversation left without
    turns is a member of the root alone. No rows give no rows. Other columns are not looked at.
    """
    convs, rebuilt = rebuilt_turns(ordered_turns(turns))
    rebuilt = rebuilt.withColumn("storey", F.floor((F.col("depth") - 1) / storey).cast("int"))
    salted = [F.xxhash64(F.lit(seed), "depth", "key") for seed in (1, 2)]
    rebuilt = written(rebuilt, "trie-rebuilt")
    # keys of runs of turns: exclusive or needs no order, so the parts of a long conversation combine anywhere
    sums = rebuilt.groupBy("conv_id", "storey").agg(*(F.bit_xor(h).alias(f"x{k}") for k, h in enumerate(salted)))
    sums = written(sums, "trie-sums")
    binary = lambda a, b: F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (a, b))))
    nothing = F.lit(0).cast("long")
    total = sums.groupBy("conv_id").agg(F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    keyed = convs.join(total, "conv_id", "left").select(
        "conv_id", "len", F.concat(binary(F.coalesce("x0", nothing), F.coalesce("x1", nothing)), F.unhex(F.lpad(F.hex("len"), 16, "0"))).alias("seq")
    )
    keyed = written(keyed, "trie-keyed")
    distinct = distinct_sequences(keyed)
    chosen = written(distinct.join(keyed.select(F.col("conv_id").alias("least"), "len"), "least").select("least", "len", "n", "digest"), "trie-chosen")
    longest = chosen.agg(F.max("len")).first()[0]
    if longest is None:
        return _answer(turns.sparkSession.createDataFrame([], "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"))
    # the storey of a conversation that ends where a storey ends has no turns
    runs = chosen.select("least", "len", "n", "digest", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / storey).cast("int"))).alias("storey"))
    before = W.partitionBy("conv_id").orderBy("storey")
    keys = sums.select(
        F.col("conv_id").alias("least"), (F.col("storey") + 1).alias("storey"), *(F.bit_xor(x).over(before).alias(x) for x in ("x0", "x1"))
    )
    paths = rebuilt.withColumnRenamed("conv_id", "least").groupBy("least", "storey").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "chars"))).alias("turns"))
    top = binary(F.coalesce("x0", nothing), F.coalesce("x1", nothing))
    none = F.array().cast("array<struct<depth:long,key:binary,chars:long>>")
    rows = runs.join(paths, ["least", "storey"], "left").join(keys, ["least", "storey"], "left").select(
        "least", "storey", "n", "digest", top.alias("top"), (F.floor(F.col("len") / storey) > F.col("storey")).alias("alive"),
        F.coalesce("turns", none).alias("turns"),
    )
    below = rows.select("least", (F.col("storey") - 1).alias("storey"), F.col("top").alias("next"))
    joined = lambda b: F.aggregate("turns", b, lambda acc, t: F.concat(acc, t["key"]))
    rows = written(
        rows.join(below, ["least", "storey"], "left").select(
            "least", "storey", "n", "digest", "alive", "next", joined(F.col("top")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")
        ),
        "trie-rows",
    )
    done, carry = [], None
    for level in range(longest // storey, -1, -1):
        own = (
            rows.filter(F.col("storey") == level).groupBy("path", "alive")
            .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("chars").alias("chars"), F.first("next").alias("next"), F.first("digest").alias("digest"))
        )
        if carry is None:
            own = own.select("path", "alive", "n", "least", "chars", F.col("digest").alias("ends"), *(nothing.alias(f"more_{c}") for c in ("children", "leaves", "saved")))
        else:
            more = carry.select(
                F.col("root").alias("next"), F.col("ends").alias("own_ends"), F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"),
                F.col("saved_tokens").alias("more_saved"),
            )
            own = own.join(more, "next", "left").select(
                "path", "alive", "n", "least", "chars", F.when(F.col("alive"), F.col("own_ends")).otherwise(F.col("digest")).alias("ends"),
                *(F.coalesce(f"more_{c}", nothing).alias(f"more_{c}") for c in ("children", "leaves", "saved")),
            )
        nodes = written(storey_nodes(own, min(storey, longest), shard_bytes), "trie-storey")
        carry = nodes.filter("depth = 0")
        done.append(nodes.filter(F.col("depth") > (0 if level else -1)).withColumn("depth", (F.col("depth") + level * storey).cast("long")))
    out = done[0]
    for nodes in done[1:]:
        out = out.unionByName(nodes)
    return _answer(out)


def _answer(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
