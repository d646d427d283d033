"""Token ids of whole batches of texts with a public tokenizer.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins across it, lowers case, and parts letters from
punctuation. So the ids of a text are those of its pieces in order, pieces may be lowered first, and each
distinct piece is encoded once by a worker. Three cases are exempt and stay as they are: texts with the name of a
special token, capitals under combining marks (they compose before they are lowered), and letters whose normal form ends in a
combining mark, which the tokenizer keeps with the punctuation behind it.

Pieces of plain letters pass the normal form and the parting unchanged, so they go to the model itself.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Pieces remembered by a task before it starts afresh; a bound on memory, results do not depend on it.
REMEMBERED = 1 << 19

#: ASCII punctuation but the apostrophe (contractions) is always parted from a letter before it.
_LETTER_THEN_MARK = r"(\p{L})([!-&(-/:-@\[-`{-~])"
_COMPOSED_CAPITAL = r"[A-Z]\p{M}"
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _letters_with_marks() -> str:
    """The letters that the tokenizer's normal form, composed and lowered, turns into a letter and a mark, as a class."""
    letters = map(chr, range(0x80, 0x30000))
    found = (c for c in letters if unicodedata.category(c)[0] == "L" and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] == "M")
    return f"[{''.join(found)}]"


def _byte_letters() -> dict[int, str]:
    """What a byte-level model is given for each two-byte letter of a plain piece.

    Bytes that print stand for themselves, the others for the characters from 256 on, in order.
    """
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in prints)}
    return {c: "".join(hidden.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xDF, 0x100)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary files lie, looked up where the tokenizer runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches; holds the ids of the pieces seen so far in one flat array."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self._tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._letters, self._marked = _byte_letters(), _letters_with_marks()
        self._forget()

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        model, letters, plain = self._tokenizer.model, self._letters, _PLAIN.fullmatch
        out: list = [None] * len(pieces)
        others = []
        for k, piece in enumerate(pieces):
            if plain(piece):
                out[k] = [t.id for t in model.tokenize(piece if piece.isascii() else piece.translate(letters))]
            else:
                others.append(k)
        for k, e in zip(others, self._tokenizer.encode_batch_fast([pieces[k] for k in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._flat = np.empty(1 << 16, dtype=np.uint16 if self._tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self._starts = np.zeros(1 << 14, dtype=np.int64)
        self._sizes = np.zeros(1 << 14, dtype=np.int64)
        self._used = 0

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            found = self._ids(part)
            sizes = np.array([len(ids) for ids in found], dtype=np.int64)
            first, total = len(self._at), int(sizes.sum())
            while self._used + total > len(self._flat):
                self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
            while first + len(part) > len(self._starts):
                self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
                self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
            self._flat[self._used : self._used + total] = [i for ids in found for i in ids]
            self._starts[first : first + len(part)] = self._used + np.cumsum(sizes) - sizes
            self._sizes[first : first + len(part)] = sizes
            self._at.update((piece, first + k) for k, piece in enumerate(part))
            self._used += total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch in text order, and the offsets of the texts in them; null reads as empty."""
        # a copy of its own: lowering a slice of a larger array reads past the slice
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_THEN_MARK, r"\1 \2")
        exempt = pc.or_(pc.match_substring_regex(texts, _COMPOSED_CAPITAL), pc.match_substring_regex(texts, self._marked))
        for name in self._special:
            exempt = pc.or_(exempt, pc.match_substring(texts, name, ignore_case=True))
        blank = pc.replace_substring(pc.if_else(exempt, texts, parted), "\n", " ")
        lists = pc.split_pattern(blank, " ")
        words = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._at) + len(distinct) > REMEMBERED:
            self._forget()
        at = self._at
        new = [w for w in distinct if w not in at]
        if new:
            self._learn(new)
        place = np.fromiter((at[w] for w in distinct), dtype=np.int64, count=len(distinct))
        place = place[words.indices.to_numpy(zero_copy_only=False)]
        sizes = self._sizes[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self._starts[place] - (ends - sizes), sizes)
        offsets = np.concatenate(([0], ends))[bounds]
        return self._flat[source], offsets


def encoder(path: str | None = None) -> Encoder:
    """One encoder a Python worker: it stays in a module of its own from task to task."""
    held = sys.modules.setdefault("_rolesift_worker", types.ModuleType("_rolesift_worker"))
    key = path or VOCABULARY
    if key not in held.__dict__:
        held.__dict__[key] = Encoder(path)
    return held.__dict__[key]
