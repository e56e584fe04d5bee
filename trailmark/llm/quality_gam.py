"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numeric features (shares of character classes, word and line
statistics of the whole text). Each feature is cut into bins; cyclic boosting
visits the features in turn and adds, with a small step, a shallow tree on the
feature's bins to its lookup table. Then the pairs that explain most of what is
left get tables of their own in the same way. A score is the sum of table
entries, found for all rows of a batch by indexing, through the logistic curve.

The model is fitted on the driver on at most ``fit_rows`` labelled documents
(those of the smallest hash of id); their features come from executors, where
the bounded label table is broadcast. Scoring is a map over Arrow batches.

Edge cases: null and empty texts have features too (all counts 0) and so a
score; a null id is held out of nothing; documents labelled twice count twice,
rows of ``labels`` with nulls do not count; without labels, or with one class
only, the score is the (smoothed) share of label 1; repeated rows get equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import slices, text_of

#: Character classes: upper, lower, other letters, digits, space, line end, sentence marks, other marks, rest.
CLASSES = 9
MARKS = ".,;:?'\"-()"
NAMES = (
    "log_chars", "upper", "lower", "other_letters", "digits", "space", "line_end", "sentence_marks", "other_marks", "rest",
    "word_length", "distinct_words", "upper_words", "marked_words", "long_words", "short_words", "bar_words",
    "line_length", "distinct_lines", "unended_lines", "commonest_word", "marks_a_word",
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point of the first plane; others count as rest."""
    out = np.full(0x10000, 8, dtype=np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        out[c] = {"Lu": 0, "Lt": 0, "Ll": 1, "Lo": 2, "Lm": 2, "Nd": 3, "Zs": 4}.get(kind, 7 if kind[0] in "PS" else 8)
    out[ord("\t")], out[ord("\n")] = 4, 5
    out[[ord(c) for c in MARKS]] = 6
    return out


def features(texts: list[str]) -> np.ndarray:
    """A row of ``NAMES`` for each text. Works on whole texts."""
    out = np.zeros((len(texts), len(NAMES)))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts):
        return out
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _classes()[np.minimum(points, 0xFFFF)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(sizes)
    out[:, 0] = np.log1p(sizes)
    if len(full):
        for k in range(CLASSES):
            out[full, 1 + k] = np.add.reduceat((kinds == k).view(np.int8), starts[full], dtype=np.int64) / sizes[full]
    for i, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        if words:
            n, counts = len(words), {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            kinds_of = [(c, w) for w, c in counts.items()]
            out[i, 10] = sum(c * len(w) for c, w in kinds_of) / n
            out[i, 11] = len(counts) / n
            out[i, 12] = sum(c for c, w in kinds_of if w.isupper() and len(w) > 1) / n
            out[i, 13] = sum(c for c, w in kinds_of if not w[-1].isalnum() and w[-1] not in MARKS) / n
            out[i, 14] = sum(c for c, w in kinds_of if len(w) > 14) / n
            out[i, 15] = sum(c for c, w in kinds_of if len(w) < 3) / n
            out[i, 16] = (counts.get("|", 0) + counts.get("-", 0) + counts.get("*", 0)) / n
            out[i, 20] = max(counts.values()) / n
            out[i, 21] = (out[i, 7] + out[i, 8]) * sizes[i] / n
            out[i, 17] = np.log1p(sizes[i] / len(lines))
            out[i, 18] = len(set(lines)) / len(lines)
            out[i, 19] = sum(x.rstrip()[-1] not in ".?!\"')" for x in lines) / len(lines)
    return out


def _leaves(gain_of, parts: list, most: int):
    """Split greedily the part whose best cut gains most, up to ``most`` parts."""
    while len(parts) < most:
        found = [(*gain_of(p), i) for i, p in enumerate(parts)]
        gain, cut, i = max(found, key=lambda x: x[0])
        if gain <= 1e-9:
            break
        parts[i : i + 1] = cut
    return parts


def _best_cut(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Of sums over consecutive bins: the gain of the best cut and its place."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A shallow tree on a line of bins: the step of each bin."""

    def gain_of(p):
        a, b = p
        gain, at = _best_cut(g[a:b], h[a:b], l2)
        return gain, [(a, a + at), (a + at, b)]

    out = np.zeros(len(g))
    for a, b in _leaves(gain_of, [(0, len(g))], leaves):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A shallow tree on a grid of bins, cut along either axis."""

    def gain_of(p):
        a, b, c, d = p
        rows, at_row = _best_cut(g[a:b, c:d].sum(1), h[a:b, c:d].sum(1), l2)
        columns, at_column = _best_cut(g[a:b, c:d].sum(0), h[a:b, c:d].sum(0), l2)
        if rows >= columns:
            return rows, [(a, a + at_row, c, d), (a + at_row, b, c, d)]
        return columns, [(a, b, c, c + at_column), (a, b, c + at_column, d)]

    out = np.zeros(g.shape)
    for a, b, c, d in _leaves(gain_of, [(0, g.shape[0], 0, g.shape[1])], leaves):
        out[a:b, c:d] = -g[a:b, c:d].sum() / (h[a:b, c:d].sum() + l2)
    return out


@dataclass
class Gam:
    """Bin edges and lookup tables. ``fit`` learns them, ``score`` adds entries up."""

    bins: int = 32
    coarse: int = 8
    rounds: int = 60
    pair_rounds: int = 20
    pairs: int = 6
    rate: float = 0.2
    leaves: int = 3
    l2: float = 1.0
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    thin: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        self.bias = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.array([]) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.thin = [np.arange(len(e) + 1) * self.coarse // (len(e) + 1) for e in self.edges]
        self.pair_tables = {}
        if n == 0 or y.min() == y.max():
            return self
        at = self._bin(x)
        z = np.full(n, self.bias)
        for _ in range(self.rounds):
            for k, table in enumerate(self.tables):
                g, h = self._slope(z, y)
                m = len(table)
                step = self.rate * tree_1d(np.bincount(at[k], g, m), np.bincount(at[k], h, m), self.leaves, self.l2)
                table += step
                z += step[at[k]]
        c = self.coarse
        cell = {(i, j): self.thin[i][at[i]] * c + self.thin[j][at[j]] for i, j in combinations(range(len(at)), 2)}
        g, h = self._slope(z, y)

        def left(pair) -> float:
            gg, hh = np.bincount(cell[pair], g, c * c), np.bincount(cell[pair], h, c * c)
            tree = tree_2d(gg.reshape(c, c), hh.reshape(c, c), 4, self.l2).ravel()
            return float(-(gg * tree + 0.5 * (hh + self.l2) * tree**2).sum())

        chosen = sorted(cell, key=lambda p: (-left(p), p))[: self.pairs]
        self.pair_tables = {p: np.zeros((c, c)) for p in chosen}
        for _ in range(self.pair_rounds):
            for p, table in self.pair_tables.items():
                g, h = self._slope(z, y)
                gg, hh = (np.bincount(cell[p], v, c * c).reshape(c, c) for v in (g, h))
                step = self.rate * tree_2d(gg, hh, 4, self.l2)
                table += step
                z += step.ravel()[cell[p]]
        return self

    @staticmethod
    def _slope(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    def _bin(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        at = self._bin(x)
        z = np.full(len(x), self.bias)
        for table, i in zip(self.tables, at, strict=True):
            z += table[i]
        for (i, j), table in self.pair_tables.items():
            z += table[self.thin[i][at[i]], self.thin[j][at[j]]]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 20_000) -> Gam:
    """A model of at most ``fit_rows`` labelled rows that are not held out.

    The bound keeps the broadcast label table and what comes to the driver
    (``fit_rows`` rows of features) of a fixed size.
    """
    known = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("y")).where(F.col("labelled").isNotNull() & F.col("y").isin(0, 1) & ~held_out("labelled"))
    some = known.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(fit_rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    joined = docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).select(F.col("doc_id").cast("long"), "text", "y")
    # The same document may stand in several rows; they are bounded here as the labels are.
    rows = joined.mapInArrow(task, "doc_id long, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(fit_rows).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    return Gam().fit(x, np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Gam, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = model.score(features(b.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(docs, text_col).alias("text")).mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Gam, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [model.score(features(texts.iloc[i : i + 256].tolist())) for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return docs.where(of(text_of(docs, text_col)) >= least)
