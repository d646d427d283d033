"""Chat formatting in budgeted windows with a loss mask, and its exact inverse."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import slices
from rolesift.llm.tokens import encoder

#: Tokens of a window, and the earlier turns repeated in the next one (at most, and of so many tokens).
BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = 512

# fixed values: how each role's turn begins and ends
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
OTHER_ROLE, OTHER_TEXT, OTHER_END = "<|role|>", "<|text|>", "<|end|>"
TARGET = "assistant"

_CONTROL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BODY = r"((?:[^\\<\[]|\\.)*?)"
_TURN = re.compile(
    "|".join(re.escape(a) + _BODY + re.escape(b) for a, b in MARKS.values())
    + "|" + re.escape(OTHER_ROLE) + _BODY + re.escape(OTHER_TEXT) + _BODY + re.escape(OTHER_END),
    re.DOTALL,
)


def escape(text: str) -> str:
    """Every control string begins with < or [; a backslash before these and before itself makes text of them."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the escaped text, and what stands after it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER_ROLE + escape(role) + OTHER_TEXT, OTHER_END
    return before, escape(text), after


def parse_turns(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end of the escaped text) of every turn of a window."""
    roles, at = list(MARKS), 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        if found.lastindex <= len(roles):
            yield roles[found.lastindex - 1], *found.span(found.lastindex)
        else:
            yield unescape(found.group(found.lastindex - 1)), *found.span(found.lastindex)
        at = found.end()


class _Windows:
    """Cuts one conversation into windows while its turns arrive; holds little more than a window."""

    def __init__(self, conv_id, budget: int, turns: int, tokens: int):
        self.conv_id, self.budget, self.history_turns, self.history_tokens = conv_id, budget, turns, tokens
        self.system: tuple | None = None
        self.history: list[tuple] = []
        self.waiting: list[tuple] = []
        self.waiting_tokens = self.made = 0

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        self.waiting.append((role, text, tokens))
        self.waiting_tokens += tokens
        while self.waiting_tokens > self.budget and len(self.waiting) > 1:
            yield self._cut()

    def end(self) -> Iterator[tuple]:
        while self.waiting:
            yield self._cut()

    def _cut(self) -> tuple:
        fixed, history = [self.system] if self.system else [], self.history
        while history and sum(t[2] for t in (*fixed, *history, self.waiting[0])) > self.budget:
            history = history[1:]
        repeated = fixed + history
        room = self.budget - sum(t[2] for t in repeated)
        reach = np.cumsum([t[2] for t in self.waiting])
        n = max(1, int(np.searchsorted(reach, room, side="right")))
        new, self.waiting = self.waiting[:n], self.waiting[n:]
        self.waiting_tokens -= int(reach[n - 1])
        parts, mask, at = [], [], 0
        for k, (role, text, _) in enumerate(chain(repeated, new)):
            before, body, after = format_turn(role, text)
            if role == TARGET and k >= len(repeated):
                mask.append({"start": at + len(before), "end": at + len(before) + len(body)})
            parts += (before, body, after)
            at += len(before) + len(body) + len(after)
        row = (self.conv_id, self.made, "".join(parts), mask, len(repeated), n, sum(t[2] for t in chain(repeated, new)))
        self.made += 1
        if self.made == 1 and new[0][0] == "system":
            self.system = new[0]
        recent = [t for t in (*history, *new) if t is not self.system][-self.history_turns :] if self.history_turns else []
        while recent and sum(t[2] for t in recent) > self.history_tokens:
            recent.pop(0)
        self.history = recent
        return row


_MASK = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_WINDOW = pa.schema([
    ("conv_id", pa.int64()), ("window_no", pa.int64()), ("text", pa.string()), ("mask", pa.list_(_MASK)),
    ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()),
])
WINDOW = "conv_id long, window_no long, text string, mask array<struct<start: long, end: long>>, n_repeated int, n_turns int, n_tokens long"


def _format(budget: int, history_turns: int, history_tokens: int, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Windows | None = None
        for batch in slices(batches, 2):
            ids, roles, texts = (batch.column(c).to_pylist() for c in range(3))
            formatted = pa.array(["".join(format_turn(r, t)) for r, t in zip(roles, texts, strict=True)], pa.large_string())
            tokens = np.diff(encoder(vocabulary).encode(formatted)[1]).tolist()
            made: list[tuple] = []
            for conv_id, role, text, n in zip(ids, roles, texts, tokens, strict=True):
                if current is None or current.conv_id != conv_id:
                    made.extend(current.end() if current else ())
                    current = _Windows(conv_id, budget, history_turns, history_tokens)
                made.extend(current.add(role, text, n))
            yield from _rows(made)
        if current:
            yield from _rows(list(current.end()))

    return run


def _rows(made: list[tuple]) -> Iterator[pa.RecordBatch]:
    if made:
        columns = [pa.array(c, kind.type) for c, kind in zip(zip(*made, strict=True), _WINDOW, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=_WINDOW)


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS, vocabulary: str | None = None,
) -> DataFrame:
    """(conv_id, turn, role, text) to windows: conv_id, window_no, text, mask, n_repeated, n_turns, n_tokens.

    Prefix sums of the turns' tokens choose how many whole turns a window takes within the budget. Each window after
    the first repeats the leading system turn and the latest turns (at most two, 512 tokens of them, and only what leaves
    room for the next turn). ``mask`` lists the code points under the loss: the texts of the new assistant turns; repeated ones are
    context only, so every target counts once.

    Cases: null text and role read as empty; a null conv_id is one conversation; equal turn numbers are ordered by role
    and text, null turns come first; repeated rows are turns of their own. A turn that does not fit
    beside the system turn has a window of its own, which then exceeds the budget. No rows give no rows.

    A conversation is walked in one task, whose memory is bounded by a window; the digest of a conversation is
    sequential by nature, so one of any length is not split further.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), "turn",
    )
    return (
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_format(budget, history_turns, history_tokens, vocabulary), WINDOW)
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, state = object(), None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row():
        turns, loss = state[1], state[3]
        values = ([current], [state[0]], [turns.hexdigest()], [state[2]], [loss.hexdigest()], [state[4]])
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for conv_id, text, mask, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv_id != current:
                if state:
                    yield row()
                current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for k, (role, start, end) in enumerate(parse_turns(text)):
                if k >= repeated:
                    state[0] += 1
                    state[1].update(f"{role}\n{unescape(text[start:end])}\n".encode())
            for span in mask:
                target = unescape(text[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
    if state:
        yield row()


def read_windows(windows: DataFrame) -> DataFrame:
    """Windows back to conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return (
        windows.repartition("conv_id").sortWithinPartitions("conv_id", "window_no")
        .select("conv_id", "text", "mask", "n_repeated")
        .mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )
