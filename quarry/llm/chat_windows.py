"""Chat formatting in budgeted windows (operator 6).

A conversation's turns stream by in order. The prefix sum of their tokens closes a
window where the next turn would exceed the budget, so windows hold whole turns. Each
later window repeats the system turn and as many of the last turns as the history
budget allows; loss is on new assistant turns alone, so every target counts once.

A turn reads ``### role: text</turn>`` and a newline. Inside texts and roles the
characters that controls begin with, and the escape itself, get a backslash.
"""

from __future__ import annotations

import re
from collections import deque
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches

BUDGET = 512
HISTORY = 128
MARKUP = 4  # tokens of a turn's markup

_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.)*+)</turn>\n", re.S)


def escape(s: str) -> str:
    return re.sub(r"([\\#<:])", r"\\\1", s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def turn_tokens(text: str) -> int:
    return len(text.split()) + MARKUP


_WINDOW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.large_string()), ("new_from", pa.int64()),
    ("tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
WINDOW = "conv_id long, window long, text string, new_from long, tokens long, loss array<struct<start: bigint, end: bigint>>"


class _Conversation:
    """State of one conversation: bounded by the system turns, the history budget and
    one window."""

    def __init__(self, conv_id, budget, history):
        self.conv_id, self.budget, self.limit = conv_id, budget, history
        self.system, self.system_tokens = [], 0
        self.past, self.past_tokens = deque(), 0
        self.turns, self.tokens, self.windows, self.started = [], 0, 0, False

    def add(self, role, text):
        cost = turn_tokens(text)
        out = None
        if self.turns and self._base() + self.tokens + cost > self.budget:
            out = self.close()
        if role == "system" and not self.started:
            self.system.append((role, text))
            self.system_tokens += cost
        self.started = self.started or role != "system"
        self.turns.append((role, text, cost))
        self.tokens += cost
        return out

    def _base(self):
        return (self.system_tokens + self.past_tokens) if self.windows else 0

    def close(self):
        parts, loss, length = [], [], 0

        def put(role, text, target):
            nonlocal length
            head, body = f"### {escape(role)}: ", escape(text)
            if target:
                loss.append({"start": length + len(head), "end": length + len(head) + len(body)})
            parts.append(f"{head}{body}</turn>\n")
            length += len(parts[-1])

        if self.windows:
            for role, text in self.system:
                put(role, text, False)
            for role, text, _ in self.past:
                put(role, text, False)
        new_from = length
        for role, text, _ in self.turns:
            put(role, text, role == "assistant")
        row = (self.conv_id, self.windows, "".join(parts), new_from, self._base() + self.tokens, loss)
        system = len(self.system) if not self.windows else 0
        for turn in self.turns[system:]:
            self.past.append(turn)
            self.past_tokens += turn[2]
            while self.past and self.past_tokens > self.limit:
                self.past_tokens -= self.past.popleft()[2]
        self.turns, self.tokens = [], 0
        self.windows += 1
        return row


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, window, text, new_from, tokens, loss)`` of ``turns(conv_id, turn,
    role, text)``: the formatted windows in order, where their new turns start, and
    the character spans under the loss mask.

    A conversation streams through one task in order, holding one window; rows are
    dealt by conversation and sorted, so its length costs no memory.

    * null text and null role: empty; a null conv_id is one conversation;
    * equal turn numbers: ordered by role, then text; repeated rows are turns each;
    * a turn beyond the budget has a window of its own, whole;
    * a system turn after others is an ordinary turn; system turns that open the
      conversation are kept in every window, even beyond the budget;
    * an empty table gives no rows; other columns are ignored.
    """
    byte_batches(turns.sparkSession)
    rows = (
        turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches):
        current, out = None, []
        for batch in batches:
            for conv_id, role, text in zip(
                batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()
            ):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        out.append(current.close())
                    current = _Conversation(conv_id, budget, history)
                if row := current.add(role, text):
                    out.append(row)
            if out:
                yield _rows(out)
                out = []
        if current is not None:
            yield _rows([current.close()])

    return rows.mapInArrow(run, WINDOW)


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _WINDOW)], schema=_WINDOW)


def parse(text: str, start: int = 0) -> list[tuple[str, str]]:
    """(role, text) of every turn from ``start``."""
    return [(unescape(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(text, start)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold, parsed from their texts and masks:
    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    Takes the frame of :func:`windows` itself, whose partitions hold whole
    conversations in order; nothing is shuffled again.
    """

    def run(batches):
        state = None

        def row():
            conv_id, n, turns, chars, loss, size = state
            return [conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), size]

        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if state is None or state[0] != w["conv_id"]:
                    if state is not None:
                        out.append(row())
                    state = [w["conv_id"], 0, sha256(), 0, sha256(), 0]
                for role, text in parse(w["text"], w["new_from"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for x in w["loss"]:
                    target = unescape(w["text"][x["start"] : x["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(w["text"])
            if out:
                yield _digests(out)
        if state is not None:
            yield _digests([row()])

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(out):
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out), types)],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )
