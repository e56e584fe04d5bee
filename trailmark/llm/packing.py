"""Packing of tokenised documents into fixed windows by sum-of-squares placement.

A document is its token ids and then ``end_id``. Whole windows are cut off its
front first; the rest (1..window tokens) is one item of an online bin packing. A
level array counts the partially filled windows by fill, in levels of a 32nd of
a window. The item starts a window, joins the fullest window of a level in which
it fits, or is cut to fill a window of a level in which it does not: whatever
makes the sum of the squared counts least, where a cut counts ``cut_cost`` more.
So documents stay whole until windows of a level pile up, and the number of open
windows is bounded by the levels and ``cut_cost``, not by the input.

The work is a map over input partitions without a shuffle. A task holds only
its open windows. At its end the fullest of them, as many as all their tokens
fill, stay as they were placed; the pieces of the others are cut into their
gaps, so that one padded window at most is left in each task.

Edge cases: null and empty texts are documents of one token, ``end_id``;
repeated rows (and rows with null ids) are packed once per row; an empty table
gives no rows; other columns are ignored; very long texts become many whole
windows. White space or words of millions of characters cost linear time (texts
with white space beyond ``LONG_SPACE``, at which the encoder's pattern fails,
are encoded by ``bpe``). A special token's string in a text gets that token's id, as the
``tokenizers`` library gives it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import bpe
from trailmark.llm.common import by_bytes, small_batches, text_of, tidy

WINDOW = 2048
END_ID = 1
TOKENIZER = bpe.TOKENIZER
#: Characters of white space that the encoder's pattern surely takes.
LONG_SPACE = 50_000
#: Bytes of text that a task holds decoded, and ids in a batch that it returns.
TEXT_BYTES, BATCH_IDS = 1 << 20, 1 << 19
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SCHEMA_IDS = SCHEMA + ", ids array<int>"


@lru_cache(maxsize=4)
def encoder(path: str):
    """A byte-pair encoder over the vocabulary of a byte-level ``tokenizers`` file.

    ``path`` is a file, or the bare name of a public vocabulary. Ids must rise in
    the order of the file's merges, so that they serve as ranks (else an error);
    the ids equal those of the ``tokenizers`` library (tested) at several times
    its speed.
    """
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    ranks_of = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(a >= b for a, b in zip(ranks_of[:-1], ranks_of[1:], strict=True)):
        raise ValueError(f"{path}: ids do not rise with the merges")
    raw = bpe.byte_names()
    ranks = {bytes(raw[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


def has_long_space(text: str) -> bool:
    return len(text) >= LONG_SPACE and _LONG_SPACE.search(text) is not None


def encode(text: str, tokenizer: str = TOKENIZER) -> np.ndarray:
    """The ids of a text as little-endian unsigned 32-bit numbers."""
    if has_long_space(text):
        return next(bpe.encoder(tokenizer).encode([text]))
    return encoder(tokenizer).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class Packer:
    """One task's online packing. ``place`` and ``finish`` give pieces of closed windows.

    A window is a list of its fill and its pieces ``(doc, start, ids, doc tokens)``.
    """

    def __init__(self, window: int = WINDOW, cut_cost: int = 8, first_sequence: int = 0):
        self.window, self.cut_cost, self.next = window, cut_cost, first_sequence
        self.grain = max(1, window // 32)
        self.levels = [0] * (window // self.grain + 1)  # partially filled windows at each level
        self.at: list[list[list]] = [[] for _ in self.levels]
        self.placed = self.moved = 0  # tokens of items, and those that ``finish`` moved

    def place(self, piece: tuple, may_cut: bool = True) -> Iterator[tuple]:
        """``piece``: (doc, start, ids, doc tokens) of at most ``window`` tokens."""
        doc, start, ids, total = piece
        size = len(ids)
        if size == self.window:
            yield from self._close([size, [piece]])
            return
        # A new window at level l changes the sum by 2 * levels[l] + 1, one that
        # closes by 1 - 2 * levels[l], one that moves by both.
        least, into, fits = 2 * self.levels[size // self.grain] + 1, None, True
        for level in range(len(self.levels) - 1, -1, -1):  # of equal changes the fullest level
            count = self.levels[level]
            if not count:
                continue
            fill = max((w[0] for w in self.at[level] if w[0] + size <= self.window), default=None)
            if fill is not None:
                to = (fill + size) // self.grain
                change = 1 - 2 * count if fill + size == self.window else 0 if to == level else 2 * (self.levels[to] - count) + 2
            elif may_cut:
                change = 2 - 2 * count + self.cut_cost
            else:
                continue
            if change < least:
                least, into, fits = change, level, fill is not None
        if into is None:
            self._open([size, [piece]])
        elif fits:
            held = self._take(into, size)
            held[0] += size
            held[1].append(piece)
            if held[0] == self.window:
                yield from self._close(held)
            else:
                self._open(held)
        else:
            held = self._take(into, 0)
            gap = self.window - held[0]
            held[1].append((doc, start, ids[:gap], total))
            yield from self._close(held)
            yield from self.place((doc, start + gap, ids[gap:], total), may_cut=False)

    def finish(self) -> Iterator[tuple]:
        """The open windows: the fullest as placed, their gaps filled with the others' pieces."""
        held = sorted((w for at in self.at for w in at), key=lambda w: -w[0])
        need = -(-sum(w[0] for w in held) // self.window)
        stay, thin = held[:need], [p for w in held[need:] for p in w[1]]
        self.moved = sum(len(p[2]) for p in thin)
        for fill, pieces in stay:
            while thin and fill < self.window:
                doc, start, ids, total = thin.pop()
                part, rest = ids[: self.window - fill], ids[self.window - fill :]
                pieces.append((doc, start, part, total))
                fill += len(part)
                if len(rest):
                    thin.append((doc, start + len(part), rest, total))
            yield from self._close([fill, pieces])
        self.levels = [0] * len(self.levels)
        self.at = [[] for _ in self.levels]

    def _open(self, held: list) -> None:
        self.at[held[0] // self.grain].append(held)
        self.levels[held[0] // self.grain] += 1

    def _take(self, level: int, size: int) -> list:
        """The level's fullest window in which ``size`` tokens fit."""
        windows = self.at[level]
        i = max((i for i, w in enumerate(windows) if w[0] + size <= self.window), key=lambda i: windows[i][0])
        self.levels[level] -= 1
        return windows.pop(i)

    def _close(self, held: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in held[1]:
            yield doc, start, ids, total, self.next, offset
            offset += len(ids)
        self.next += 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, window: int = WINDOW, end_id: int = END_ID, cut_cost: int = 8, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, unless ``with_ids`` is false, the ``ids`` themselves. ``sequence_id`` is
    unique over all tasks: the partition in the upper bits, a count below.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        packer = Packer(window, cut_cost, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype="<u4")
        rows: list[tuple] = []

        def emit() -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        held = 0
        for b in by_bytes(batches, TEXT_BYTES):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text, tokenizer), end])
                total, whole = len(ids), len(ids) // window * window
                for i in range(0, whole, window):
                    rows.extend(packer.place((doc, i, ids[i : i + window], total)))
                if whole < total:
                    # A copy: an open window must not hold on to a long document.
                    rows.extend(packer.place((doc, whole, ids[whole:].copy(), total)))
                held += total
                if len(rows) >= 2000 or held >= BATCH_IDS:
                    if rows:
                        yield emit()
                    held = 0
        rows.extend(packer.finish())
        if rows:
            yield emit()
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(task, SCHEMA_IDS if with_ids else SCHEMA)
