"""Token ids as flat binary files with 64-bit document offsets, read back by memory mapping.

A folder holds, for each part, ``part-N.ids`` (little-endian unsigned integers, 16 bits when the vocabulary
fits, else 32), ``part-N.offsets`` (64-bit, one more than documents, counted inside the part) and ``part-N.docs``
(64-bit doc_ids). Parts follow each other in ascending doc_id; ``manifest.json`` lists them with
their bases, the prefix sums of the parts' token counts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.common import slices
from rolesift.llm.tokens import encoder, vocabulary_path

END_ID = 2
#: Stands for a null doc_id in the file.
NO_ID = -(2**63)
MANIFEST = "manifest.json"


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _writer(root: str, end_id: int, vocabulary: str | None, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = _store(root)
        # a second attempt writes its own files; the rename makes either one the part
        names = {kind: (f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{part:06d}.{kind}") for kind in ("ids", "offsets", "docs")}
        out = {kind: store.open_output_stream(draft) for kind, (draft, _) in names.items()}
        n_docs = n_tokens = 0
        for batch in slices(batches, 1):
            flat, offsets = encoder(vocabulary).encode(batch.column(1))
            flat = np.insert(flat.astype(width), offsets[1:], end_id)
            starts = offsets[:-1] + np.arange(len(offsets) - 1)
            out["ids"].write(flat.tobytes())
            out["offsets"].write((n_tokens + starts).astype("<i8").tobytes())
            out["docs"].write(batch.column(0).fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
            n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + len(flat)
        out["offsets"].write(np.array([n_tokens], dtype="<i8").tobytes())
        for kind, (draft, final) in names.items():
            out[kind].close()
            if n_docs:
                store.move(draft, final)
            else:
                store.delete_file(draft)
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
                ["part", "n_docs", "n_tokens"],
            )

    return run


def write_token_files(
    docs: DataFrame, root: str, end_id: int = END_ID, vocabulary: str | None = None,
) -> list[dict]:
    """(doc_id, text) to token files below ``root``, a new folder that all executors reach; the manifest's parts.

    Whole texts are encoded (null: empty) without special tokens and ``end_id`` is appended to each. Documents are
    dealt into ranges of doc_id and sorted inside them, nulls first; rows with one doc_id stay in
    the order of their texts. The driver sees one row a part. No rows give a manifest without parts.
    """
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(vocabulary or vocabulary_path()).get_vocab_size(), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    store, folder = _store(root)
    store.create_dir(folder, recursive=True)
    parts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(_writer(root, end_id, vocabulary, width), "part int, n_docs long, n_tokens long")
    )
    rows = sorted(parts.collect())
    bases = [0, *accumulate(r["n_tokens"] for r in rows)]
    listed = [r.asDict() | {"base": base} for r, base in zip(rows, bases, strict=False)]
    with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
        out.write(json.dumps({"width": width, "end_id": end_id, "n_tokens": bases[-1], "parts": listed}).encode())
    return listed


def _opened(store, path: str):
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32, part.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as little-endian
    unsigned 32-bit integers. Each part is mapped by one task, which touches one document at a time.
    """
    store, folder = _store(root)
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    width = np.dtype(manifest["width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets_file, docs_file = (_opened(store, f"{folder}/part-{part:06d}.{kind}") for kind in ("ids", "offsets", "docs"))
                offsets = np.frombuffer(offsets_file.read(), dtype="<i8")
                docs = np.frombuffer(docs_file.read(), dtype="<i8")
                for at in range(0, len(docs), 4096):
                    own = offsets[at : at + 4097]
                    crc = []
                    for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
                        mapped = np.frombuffer(ids.read_at((b - a) * width.itemsize, a * width.itemsize), dtype=width)
                        crc.append(zlib.crc32(mapped.astype("<u4").tobytes()))
                    doc = docs[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(base + own[:-1]),
                            pa.array(np.diff(own)), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "part"],
                    )

    parts = [(p["part"], p["base"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(parts, "part int, base long").repartition(max(1, len(parts)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int")
