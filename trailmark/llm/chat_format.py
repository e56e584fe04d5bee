"""Chat formatting: a state machine over roles and a declarative template.

``format_turns`` validates the turn order of each conversation and emits, for
each turn, text segments with loss flags. Text inside a turn is escaped so that
no control string can occur in it; ``read_back`` parses segments to the turns.

Rows are dealt by conversation and sorted by turn inside each task, then a
stream of Arrow batches runs through the machine: a task keeps one state and
never a whole conversation, however long it is. A conversation is one ordered
chain (its digest too), so its rows meet in one task, but only as a stream.

Edge cases: a null text is empty, a null role is the empty role, a null id is a
conversation of its own; rows of equal turn are taken by role and then text
(null first), a null turn before all others; repeated rows are turns of their
own; an empty table gives no rows; other columns are ignored. An invalid order
is reported (``valid``, ``error``), the turns are formatted all the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import slices

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """What stands before and after each turn, whose text bears loss, and which roles may follow which."""

    head: str = START + "{role}\n"
    tail: str = END + "\n"
    loss_roles: frozenset = frozenset({"assistant"})
    #: state -> role -> next state; a conversation starts in "start".
    moves: dict = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user", "tool": "tool"}, "tool": {"assistant": "assistant", "tool": "tool"}})
    #: States in which a conversation may end.
    accept: frozenset = frozenset({"assistant"})


CHATML = Template()
#: A turn's segments are its head, its text and its tail.
TURNS = "conv_id long, pos long, state string, valid boolean, error string, segments array<struct<text: string, loss: boolean>>"


def escape(text: str) -> str:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def escape_role(role: str) -> str:
    """As a text, but on one line."""
    return escape(role).replace("\n", "\\n")


def format_turns(turns: DataFrame, *, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: ``conv_id``, ``pos`` from 0, the machine's ``state`` after
    it, whether the order was ``valid`` so far with the first ``error``, and the
    ``segments``. Rows of a conversation are adjacent and in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, pos, state, error = object(), 0, "start", None
        kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for b in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv or type(c) is not type(conv):
                    conv, pos, state, error = c, 0, "start", None
                after = template.moves.get(state, {}).get(role)
                if after is None:
                    error = error or f"turn {pos}: {role or 'no role'} after {state}"
                    after = role if role in template.moves else state
                state = after
                loss = role in template.loss_roles
                segments = [{"text": template.head.format(role=escape_role(role)), "loss": False}, {"text": escape(text), "loss": loss}, {"text": template.tail, "loss": False}]
                for column, value in zip(out, (c, pos, state, error is None, error, segments), strict=True):
                    column.append(value)
                pos += 1
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["conv_id", "pos", "state", "valid", "error", "segments"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(turn_col).alias("turn"), F.col(text_col).isNotNull().alias("has_text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "has_text", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(task, TURNS)


def read_back(segments: list[dict], template: Template = CHATML) -> tuple[str, str, str]:
    """Role, text and the text under the loss mask, parsed from one turn's output."""
    whole = "".join(s["text"] for s in segments)
    before, after = template.head.split("{role}")
    at = whole.index(after, len(before))
    end = whole.index(template.tail, at + len(after))
    if not whole.startswith(before) or end + len(template.tail) != len(whole):
        raise ValueError(f"not a turn of this template: {whole[:80]!r}")
    masked = "".join(s["text"] for s in segments if s["loss"])
    return unescape(whole[len(before) : at]), unescape(whole[at + len(after) : end]), unescape(masked)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digests(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row a conversation, computed from what ``format_turns`` emitted and in
    its order, without another shuffle; the digests are fed turn by turn."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Open:
            def __init__(self, conv):
                self.conv, self.n, self.loss_chars, self.chars, self.valid = conv, 0, 0, 0, True
                self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

            def row(self):
                return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid

        now, done = None, []

        def emit() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            columns = [pa.array(v, t) for v, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        for b in slices(batches):
            names = ("conv_id", "pos", "state", "valid", "segments")
            for conv, pos, state, valid, segments in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if now is None or pos == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Open(conv)
                role, text, masked = read_back(segments, template)
                now.n += 1
                now.chars += sum(len(s["text"]) for s in segments)
                now.turns.update(f"{role}\n{text}\n".encode())
                now.loss.update(masked.encode())
                now.loss_chars += len(masked)
                now.valid = valid and state in template.accept
            if done:
                yield emit()
        if now is not None:
            done.append(now.row())
            yield emit()

    return formatted.mapInArrow(task, DIGESTS)
