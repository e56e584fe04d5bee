"""Token counts that follow edits without encoding whole texts again.

A text is cut into leaves of about ``leaf_chars`` characters, only between a
character that is no white space and a space or line end after it: there the
byte-level pre-tokeniser always ends a pre-token, whatever stands around, so
counts of leaves add up. A binary segment tree over the leaves keeps sums of
characters and tokens. An edit descends the tree to the leaves it touches
(those within one character of it, for the cut's own context), re-encodes
these alone and once for all edits that meet in them, and updates the sums on the way to the root.

``build`` makes the trees (leaf sums are enough to store one), ``recount``
applies edits to stored trees. Both are maps over Arrow batches; nothing shuffles.

Edge cases: null and empty texts count 0 tokens and can be edited; edits are in
offsets (code points) of the unedited text, taken by start; one that overlaps
an earlier one, or lies outside the text, is not applied and is not counted; a
null edit list is empty; repeated rows are counted each; a text without white
space is one leaf; an empty table gives no rows; other columns are ignored.
Special tokens' strings are ordinary text here. White space and words of millions
of characters cost linear time: an e-mail address is sought once in each run of
its characters, so one that starts within such a run, right after another
address, is no edit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm import bpe
from trailmark.llm.common import by_bytes, text_of
from trailmark.llm.packing import TOKENIZER, encoder, has_long_space

LEAF_CHARS = 512

#: Edits of the query: personal data and noise that a clean-up would replace.
CLEANUP = (
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<address>"),
    (r"\+?\d[\d ()-]{7,}\d", "<phone>"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"([!?*#$%&])\1{2,}", r"\1"),
)


def leaves(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    return list(bpe.blocks(text, leaf_chars))


class TokenTree:
    """Sums of characters and tokens over leaves; node 1 is the root."""

    def __init__(self, texts: Sequence[str], tokens: Sequence[int], count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf, self.leaf_chars = count, list(texts), leaf_chars
        self.width = 1 << max(0, len(self.leaf) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (text, n) in enumerate(zip(texts, tokens, strict=True)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(text), n
        for i in range(self.width - 1, 0, -1):
            self._sum(i)
        self.encoded_chars = 0

    @classmethod
    def of(cls, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS) -> TokenTree:
        parts = leaves(text, leaf_chars)
        return cls(parts, [count(p) for p in parts], count, leaf_chars)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one with text, at the end) and where it starts."""
        offset, start, i = min(offset, max(0, self.chars[1] - 1)), 0, 1
        while i < self.width:
            i *= 2
            if offset - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, edits: Sequence[tuple[int, int, str]]) -> None:
        """Replace ranges of the present text, given in order and apart from each
        other. Edits whose leaves overlap are encoded together, once."""
        groups: list[list] = []  # first leaf, its start, last leaf, edits
        for start, end, text in edits:
            first, at = self.find(max(0, start - 1))
            last, _ = self.find(end)
            if groups and first <= groups[-1][2]:
                groups[-1][2] = max(last, groups[-1][2])
                groups[-1][3].append((start, end, text))
            else:
                groups.append([first, at, last, [(start, end, text)]])
        for first, at, last, some in groups:
            old, new, done = "".join(self.leaf[first : last + 1]), [], 0
            for start, end, text in some:
                new += [old[done : start - at], text]
                done = end - at
            new.append(old[done:])
            slots = last + 1 - first
            parts = leaves("".join(new), self.leaf_chars)
            parts = [*parts[: slots - 1], "".join(parts[slots - 1 :])]
            for i in range(slots):
                part = parts[i] if i < len(parts) else ""
                self._put(first + i, part, self.count(part))
            self.encoded_chars += sum(map(len, parts))

    def _put(self, i: int, text: str, tokens: int) -> None:
        self.leaf[i] = text
        i += self.width
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def text(self) -> str:
        return "".join(self.leaf)


def counter(tokenizer: str = TOKENIZER) -> Callable[[str], int]:
    encode, other = encoder(tokenizer).encode_ordinary, bpe.encoder(tokenizer)
    return lambda text: 0 if not text else len(next(other.encode([text], special=False))) if has_long_space(text) else len(encode(text))


def cleanup_edits(text: str, rules: Sequence[tuple[str, str]] = CLEANUP) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of all matches of the rules, by start."""
    return sorted((m.start(), m.end(), m.expand(to)) for pattern, to in rules for m in re.finditer(pattern, text))


def apply_edits(tree: TokenTree, edits: Sequence[tuple[int, int, str]]) -> int:
    """Apply what can be applied; how many that is."""
    size, upto, chosen = tree.chars[1], 0, []
    for start, end, text in sorted(edits):
        if upto <= start <= end <= size:
            chosen.append((start, end, text))
            upto = end
    tree.edit(chosen)
    return len(chosen)


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, text, leaf_chars, leaf_tokens, n_tokens``: each document's tree by its leaf sums."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ints = counter(tokenizer), pa.list_(pa.int32())
        for b in by_bytes(batches, 4 << 20):
            chars, tokens = [], []
            for text in b.column(1).to_pylist():
                parts = leaves(text, leaf_chars)
                chars.append([len(p) for p in parts])
                tokens.append([count(p) for p in parts])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chars, ints), pa.array(tokens, ints), pa.array([sum(t) for t in tokens], pa.int64())], names=["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(task, "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def recount(trees: DataFrame, *, edits_col: str | None = None, rules: Sequence[tuple[str, str]] = CLEANUP, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_chars, n_tokens, n_edits, n_chars_edited, n_tokens_edited, encoded_chars``.

    The edits are in ``edits_col`` (an array of structs of start, end and text)
    or, without it, what ``rules`` match. ``encoded_chars`` is how much text was
    encoded for them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "encoded_chars"]
        for b in by_bytes(batches, 4 << 20):
            out: list[tuple] = []
            for doc, text, chars, tokens, edits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = cleanup_edits(text, rules) if edits_col is None else [(e["start"], e["end"], e["text"] or "") for e in edits or [] if e and e["start"] is not None and e["end"] is not None]
                if not found:
                    out.append((doc, len(text), sum(tokens), 0, len(text), sum(tokens), 0))
                    continue
                parts, at = [], 0
                for n in chars:
                    parts.append(text[at : at + n])
                    at += n
                tree = TokenTree(parts, tokens, count)
                before = tree.tokens[1]
                n_edits = apply_edits(tree, found)
                out.append((doc, len(text), before, n_edits, tree.chars[1], tree.tokens[1], tree.encoded_chars))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    edits = F.col(edits_col) if edits_col else F.lit(None).cast("string")
    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", edits.alias("edits")).mapInArrow(task, "doc_id long, n_chars long, n_tokens long, n_edits long, n_chars_edited long, n_tokens_edited long, encoded_chars long")
