"""Byte-pair encoding by speculation, and decoding, over whole tables.

Greedy longest match proposes the tokens of a word. Whether a proposal is what
merging would give follows from its adjacent pairs alone: merging gives exactly
the one sequence of tokens in which no two neighbours would have merged across
their border. So the borders of all new words of a slice are tested at once, in
numpy, and only words with a failing border are merged, lowest rank first.

A border of tokens ``a, b`` is tested back through time: ``a`` was built from
parts of which the last lay at the border, as the first of ``b``'s did. At each
time a last part of ``a`` and a first part of ``b`` met there; the border fails
if a merge of the two came before either had been merged into its own token.
Tokens that merging their own bytes does not give are never proposed.

Encoding and decoding are maps over Arrow batches; nothing shuffles. A task
keeps the ids of at most ``KEPT`` short words, and cuts very long texts into
blocks at places where a pre-token always ends.

Edge cases: null and empty texts have no ids; null and empty ids give the empty
text; repeated rows are encoded each; an empty table gives no rows; other
columns are ignored. White space of any length is one pre-token, handled in
linear time; a word of n letters without a break takes n log n. A special
token's string in a text gets that token's id, as the ``tokenizers`` library
gives it, unless ``special`` is false. Ids that the vocabulary lacks are an
error on decoding; bytes that are no UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import slices, text_of

TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a task keeps, and their greatest length in characters.
KEPT, KEPT_CHARS = 1 << 18, 48
#: Failing words of up to so many bytes are merged together, longer ones one by one.
MERGED_TOGETHER = 64
#: Characters that are encoded together, and of a block of a longer text.
TOGETHER = 1 << 20
NEVER = np.iinfo(np.int64).max

#: Between these two characters a pre-token always ends, whatever stands around.
CUT = regex.compile(r"(?<=[!-~À-ɏ])(?=[ \n])")


def blocks(text: str, chars: int) -> Iterator[str]:
    """The text in parts of about ``chars`` characters whose ids add up to its own."""
    at = 0
    while len(text) - at > chars:
        m = CUT.search(text, at + chars)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def byte_names() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: character -> byte."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Sorted:
    """A map of integers by binary search over numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


class Encoder:
    """The vocabulary of a byte-level ``tokenizers`` file, with its pre-tokeniser."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        file = path if "/" in path else public_tokenizers.path(path)
        with open(file, encoding="utf-8") as f:
            model = json.load(f)
        added = model["added_tokens"]
        pre = model["pre_tokenizer"] or {}
        if model["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.special = {t["content"]: t["id"] for t in added}
        self._any_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self._words = regex.compile(public_tokenizers.PATTERN).findall
        self._library = Tokenizer.from_file(file).pre_tokenizer
        vocab, names = model["model"]["vocab"], byte_names()
        size = 1 + max(vocab.values())
        self.bytes: list[bytes | None] = [None] * max(size, 1 + max(self.special.values(), default=0))
        for name, i in vocab.items():
            self.bytes[i] = name.encode() if name in self.special else bytes(names[c] for c in name)
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.of_byte = np.array([vocab[name] for name, _ in sorted(names.items(), key=lambda x: x[1])], dtype=np.int64)
        # How a token is built: its two parts, and when (the rank of their merge).
        self.left, self.right, self.rank = (np.full(size, -1, dtype=np.int64) for _ in range(3))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        a, b, whole = (np.array([vocab[x] for x in part], dtype=np.int64) for part in (*zip(*pairs, strict=True), (x + y for x, y in pairs)))
        self.left[whole], self.right[whole], self.rank[whole] = a, b, np.arange(len(pairs))
        self.merge_rank = _Sorted(a << 32 | b, np.arange(len(pairs)))
        self._whole = whole
        self._merges = {k: (r, t) for k, r, t in zip((a << 32 | b).tolist(), range(len(pairs)), whole.tolist(), strict=True)}
        # Tokens that their own bytes give: both parts are such, and nothing merges across sooner.
        own = ~self._crossed(a, b, within=True)
        stands = np.zeros(size, dtype=bool)
        stands[self.of_byte] = True
        for x, y, t, ok in zip(a.tolist(), b.tolist(), whole.tolist(), own.tolist(), strict=True):
            stands[t] = ok and stands[x] and stands[y]
        self._build_trie([(self.bytes[i], i) for i in np.flatnonzero(stands).tolist()])
        self._known: dict[str, bytes] = {}
        #: Words proposed, and of these the ones that had to be merged.
        self.proposed = self.merged = 0

    def _build_trie(self, tokens: Sequence[tuple[bytes, int]]) -> None:
        child: dict[int, int] = {}
        at_node = [-1]
        for raw, i in tokens:
            node = 0
            for byte in raw:
                key = node << 8 | byte
                node = child.setdefault(key, len(at_node))
                if node == len(at_node):
                    at_node.append(-1)
            at_node[node] = i
        self._child = _Sorted(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child)))
        self._at_node = np.array(at_node, dtype=np.int64)

    # ------------------------------------------------------------ speculation

    def _propose(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Longest matches from each word's start on: the places in ``raw`` where tokens
        start, and the longest token at every place."""
        n = len(raw)
        end = np.repeat(ends, ends - starts)
        length, token = np.ones(n, dtype=np.int64), self.of_byte[raw]
        at, node, depth = np.arange(n), np.zeros(n, dtype=np.int64), 0
        while len(at):
            inside = at + depth < end[at]
            at, node = at[inside], node[inside]
            node = self._child.get(node << 8 | raw[at + depth], -1)
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
            found = self._at_node[node]
            hit = found >= 0
            token[at[hit]], length[at[hit]] = found[hit], depth
        starting = np.zeros(n, dtype=bool)
        at = starts[ends > starts]
        while len(at) > 32:
            starting[at] = True
            at = at + length[at]
            at = at[at < n]
            at = at[~starting[at]]  # a word's end is the next one's start, which is marked
        for i in at.tolist():
            while i < n and not starting[i]:
                starting[i] = True
                i += int(length[i])
        return np.flatnonzero(starting), token

    def _crossed(self, a: np.ndarray, b: np.ndarray, within: bool = False) -> np.ndarray:
        """Whether a merge crosses the border of each pair of tokens. With ``within``
        the merge of the two themselves does not count."""
        crossed = np.zeros(len(a), dtype=bool)
        row, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        first = within
        while len(row):
            when = self.merge_rank.get(x << 32 | y, NEVER)
            hit = (when < x_until) & (when <= y_until) & (when != NEVER)
            if first:
                hit[:], first = False, False
            crossed[row[hit]] = True
            rx, ry = self.rank[x], self.rank[y]
            on = ~hit & ((rx >= 0) | (ry >= 0))
            row, x, y, x_until, y_until, rx, ry = (v[on] for v in (row, x, y, x_until, y_until, rx, ry))
            back = rx > ry  # of equal tokens the left one was built first
            x_until, y_until = np.where(back, rx, x_until), np.where(back, y_until, ry)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return crossed

    def _speculate(self, words: Sequence[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit numbers."""
        encoded = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at, token = self._propose(np.frombuffer(b"".join(encoded), dtype=np.uint8).astype(np.int64), starts, ends)
        ids = token[at]
        upto = np.searchsorted(at, ends)  # tokens of a word end here
        inner = np.ones(max(0, len(ids) - 1), dtype=bool)
        inner[upto[:-1][upto[:-1] < len(ids)] - 1] = False
        border = np.flatnonzero(inner)
        pairs, which = np.unique(ids[border] << 32 | ids[border + 1], return_inverse=True)
        failing = border[self._crossed(pairs >> 32, pairs & 0xFFFFFFFF)[which]]
        wrong = np.unique(np.searchsorted(upto, failing, side="right"))
        self.proposed += len(words)
        self.merged += len(wrong)
        flat = ids.astype("<u4").tobytes()
        out = [flat[4 * i : 4 * j] for i, j in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]
        short = [i for i in wrong.tolist() if len(encoded[i]) <= MERGED_TOGETHER]
        for i, merged in zip(short, self._merge_all([encoded[i] for i in short]), strict=True):
            out[i] = merged
        for i in wrong.tolist():
            if len(encoded[i]) > MERGED_TOGETHER:
                out[i] = self.merge(encoded[i])
        return out

    # ------------------------------------------------------------ exact merging

    def _merge_all(self, words: Sequence[bytes]) -> list[bytes]:
        """``merge`` of many short words: in each round every word's next merge at once."""
        if not words:
            return []
        ids = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(ids)
        size = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(size) - size
        last = np.zeros(n + 1, dtype=bool)
        last[starts + size - 1] = True
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last[:n]] = n
        before[starts] = n  # both ends point at a place of no use
        ids, after, before = np.append(ids, -1), np.append(after, n), np.append(before, n)
        # The pair that starts at a place: its rank and the place in one number.
        pair = np.full(n + 1, NEVER)

        def look(at: np.ndarray) -> None:
            rank = self.merge_rank.get(ids[at] << 32 | ids[after[at]], NEVER)
            pair[at] = np.where((after[at] < n) & (rank != NEVER), rank << 32 | at, NEVER)

        look(np.flatnonzero(~last[:n]))
        while True:
            least = np.minimum.reduceat(pair[:n], starts)
            least = least[least != NEVER]
            if not len(least):
                break
            i = least & 0xFFFFFFFF
            j = after[i]
            ids[i], ids[j] = self._whole[least >> 32], -1
            after[i] = after[j]
            before[after[i]] = i
            pair[j] = NEVER
            look(i)
            look(before[i][before[i] < n])
        left = np.flatnonzero(ids[:n] >= 0)
        flat, ends = ids[left].astype("<u4").tobytes(), np.searchsorted(left, starts + size).tolist()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def merge(self, word: bytes) -> bytes:
        """The ids by merging: of all adjacent pairs the one of the lowest rank, the leftmost first."""
        merges, n = self._merges, len(word)
        ids = array("q", self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        # A rank and a place in one number.
        heap = [m[0] << 40 | i for i in range(n - 1) if (m := merges.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = merges.get(ids[i] << 32 | ids[j])
            if m is None or m[0] != entry >> 40:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = m[1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get(ids[i] << 32 | ids[after[i]]):
                    heapq.heappush(heap, m[0] << 40 | i)
            if before[i] >= 0 and (m := merges.get(ids[before[i]] << 32 | ids[i])):
                heapq.heappush(heap, m[0] << 40 | before[i])
        found = np.frombuffer(ids, dtype=np.int64)
        return found[found >= 0].astype("<u4").tobytes()

    # ------------------------------------------------------------ texts

    def words(self, text: str) -> list[str]:
        """The pre-tokens. Characters younger than Python's own character table are
        left to the library, whose table may be another than the pattern's."""
        if not text.replace("\n", "").isprintable() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[i:j] for _, (i, j) in self._library.pre_tokenize_str(text)]
        return self._words(text)

    def _parts(self, text: str, special: bool) -> Iterator[list[str] | int]:
        """Pre-tokens of the text's blocks, and ids of special tokens between them."""
        at = 0
        if special and self.special:
            for m in self._any_special.finditer(text):
                for block in blocks(text[at : m.start()], TOGETHER):
                    yield self.words(block)
                yield self.special[m.group()]
                at = m.end()
        for block in blocks(text[at:] if at else text, TOGETHER):
            yield self.words(block)

    def encode(self, texts: Iterable[str], special: bool = True) -> Iterator[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit numbers."""
        some: list[list] = []
        chars = 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from self._together(some)
                some, chars = [], 0
                # A long text by its blocks.
                yield np.concatenate([self._ids([part])[0] for part in self._parts(text, special)] or [np.zeros(0, "<u4")])
                continue
            some.append(list(self._parts(text, special)))
            chars += len(text)
            if chars >= TOGETHER:
                yield from self._together(some)
                some, chars = [], 0
        yield from self._together(some)

    def _together(self, texts: list[list]) -> Iterator[np.ndarray]:
        found = iter(self._ids([part for parts in texts for part in parts]))
        for parts in texts:
            own = [next(found) for _ in parts]
            yield own[0] if len(own) == 1 else np.concatenate(own)

    def _ids(self, parts: Sequence[list[str] | int]) -> list[np.ndarray]:
        if len(self._known) > KEPT:
            self._known.clear()
        known = self._known
        new = list(set().union(*(p for p in parts if not isinstance(p, int))) - known.keys())
        if new:
            known.update(zip(new, self._speculate(new), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)) if not isinstance(p, int) else p.to_bytes(4, "little"), dtype="<u4") for p in parts]
        for word in new:
            if len(word) > KEPT_CHARS:
                del known[word]
        return out

    def count(self, text: str) -> int:
        """How many ids a short text has, special strings being ordinary text; its new words are merged."""
        total = 0
        for word in self.words(text):
            ids = self._known.get(word)
            if ids is None:
                ids = self.merge(word.encode())
                if len(word) <= KEPT_CHARS and len(self._known) <= KEPT:
                    self._known[word] = ids
            total += len(ids) // 4
        return total

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        try:
            return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        except (IndexError, TypeError):
            raise ValueError("an id is not in the vocabulary") from None


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER) -> Encoder:
    """``path`` is a file, or the bare name of a public vocabulary."""
    return Encoder(path)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, special: bool = True) -> DataFrame:
    """``doc_id, ids``: the token ids of every text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in slices(batches):
            ids = list(own.encode(b.column(1).to_pylist(), special))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(task, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, ids, text``: the texts of token ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in slices(batches):
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
            texts = [own.decode(flat[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(task, "doc_id long, ids array<int>, text string")
