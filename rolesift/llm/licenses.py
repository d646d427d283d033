"""Licence notices in texts: MinHash bands over overlapping windows, exact containment after them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm import shingles as S
from rolesift.llm.common import SHINGLE_WORDS, SIMILAR_AT, slices, word_form

RECALL = 0.999
MOST_HASHES = 48

# fixed values: public licence notices (name of the template, licence, text)
TEMPLATES = (
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit-line", "MIT", "Released under the MIT License"),
    ("mit-permission", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("bsd-conditions", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-header", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc-permission", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def size_class(n: int) -> int:
    """The least power of two that is not below n."""
    return 1 << max(0, math.ceil(math.log2(n)))


def band_setting(containment: float, recall: float) -> tuple[int, int]:
    """Bands and rows by which a window finds the template it holds with that probability.

    A template of q shingles, s/2 < q <= s, lies whole in a window of 2 s. At containment c their Jaccard similarity
    is c q / (2 s + q - c q) at least; q = s/2 is the worst case.
    """
    return S.choose_bands(containment / (5 - containment), recall, MOST_HASHES)


class Scanner:
    """Signatures of the templates by size class; scans batches of texts in word form."""

    def __init__(self, templates=TEMPLATES, containment: float = SIMILAR_AT, n_words: int = SHINGLE_WORDS, recall: float = RECALL):
        self.containment, self.n_words = containment, n_words
        self.bands, self.rows = band_setting(containment, recall)
        self.a, self.b = S.permutations(self.bands * self.rows)
        flat, offsets = S.shingle_hashes(pa.array([S.words_of(t[2]) for t in templates], pa.large_string()), n_words)
        self.sets = S.sets_of(flat, offsets)
        signature = S.band_hashes(S.signatures(flat, offsets, self.a, self.b), self.bands, self.rows)
        self.classes: dict[int, dict[int, dict[int, list[int]]]] = {}
        for k, own in enumerate(self.sets):
            if len(own):
                for band, value in enumerate(signature[k].tolist()):
                    self.classes.setdefault(size_class(len(own)), {}).setdefault(band, {}).setdefault(value, []).append(k)

    def _candidates(self, flat: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, first shingle of the window, template) where a band agrees."""
        found: set[tuple[int, int, int]] = set()
        counts = np.diff(offsets)
        hashed = [((flat * a + b) >> S.SHIFT).astype(np.uint32) for a, b in zip(self.a, self.b, strict=True)] if len(flat) else []
        for size, bands in self.classes.items():
            blocks = -(-counts // size)
            if not len(flat) or not blocks.sum():
                continue
            text = np.repeat(np.arange(len(counts)), blocks)
            number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = offsets[text] + number * size
            last = np.append(text[1:] != text[:-1], True)
            signature = np.empty((len(starts), len(self.a)), dtype=np.uint32)
            for k, values in enumerate(hashed):
                least = np.minimum.reduceat(values, starts)
                signature[:, k] = np.where(last, least, np.minimum(least, np.append(least[1:], least[-1:])))
            hashes = S.band_hashes(signature, self.bands, self.rows)
            for band, wanted in bands.items():
                for row in np.flatnonzero(np.isin(hashes[:, band], np.fromiter(wanted, np.int64, len(wanted)))):
                    found.update((int(text[row]), int(starts[row] - offsets[text[row]]), k) for k in wanted[int(hashes[row, band])])
        return found

    def scan(self, forms: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, template, shingles found, first word) of the best verified window of each template in a text."""
        flat, offsets = S.shingle_hashes(forms, self.n_words)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, start, template in sorted(self._candidates(flat, offsets)):
            own = self.sets[template]
            begin = offsets[text] + start
            window = flat[begin : min(begin + 2 * size_class(len(own)), offsets[text + 1])]
            hit = np.isin(window, own)
            n = len(np.unique(window[hit]))
            if n >= self.containment * len(own) - 1e-9 and n > best.get((text, template), (0, 0))[0]:
                best[text, template] = (n, start + int(hit.argmax()))
        return [(text, template, n, first) for (text, template), (n, first) in sorted(best.items())]


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, containment: float = SIMILAR_AT, n_words: int = SHINGLE_WORDS, recall: float = RECALL,
) -> DataFrame:
    """(doc_id, text) to doc_id, template, license, n_shingles, n_found, containment, first_word.

    A row says that some window of the text holds at least ``containment`` of the template's distinct shingles (five words
    in lower case); it describes the window that holds most, the first of equal ones.

    Templates are classed by size in powers of two. For a class of size s a text is cut into blocks of s shingles and
    windows of two neighbouring blocks, so a template always lies whole in a window; MinHash bands retrieve templates
    with probability 0.999 in the worst case; then the shingles themselves are compared. Templates are a
    constant of the program and travel with it; nothing is shuffled.

    Cases: null and wordless texts hold nothing; a text or template of fewer than five words is one shingle. Repeated rows give
    repeated results; a null doc_id is kept. No rows give no rows.
    """
    listed = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(listed, containment, n_words, recall)
        for batch in slices(batches, 1, 1 << 20):
            found = scanner.scan(batch.column(1))
            if found:
                texts, kinds, counts, firsts = zip(*found, strict=True)
                sizes = [len(scanner.sets[k]) for k in kinds]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(texts)), pa.array([listed[k][0] for k in kinds]), pa.array([listed[k][1] for k in kinds]),
                        pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                        pa.array([n / size for n, size in zip(counts, sizes, strict=True)]), pa.array(firsts, pa.int64()),
                    ],
                    ["doc_id", "template", "license", "n_shingles", "n_found", "containment", "first_word"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_form(F.col("text")).alias("form")).mapInArrow(
        run, "doc_id long, template string, license string, n_shingles long, n_found long, containment double, first_word long"
    )
