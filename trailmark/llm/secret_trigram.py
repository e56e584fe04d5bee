"""Secret scans over whole texts by a trigram inverted index.

For each rule's regular expression a Boolean query over trigrams is derived: a
text that matches must satisfy it. Each slice of documents is indexed (trigram
to the documents holding it, both lower-cased in ASCII), the query intersects
and unites postings, and only the candidates are searched with the expression.
A rule from which no mandatory trigram follows searches every document.

It is a map over Arrow batches; nothing shuffles. Offsets are code points, ends
exclusive. Matches of a kind are the leftmost, non-overlapping ones. A private
key spans its body and END line; where END is missing, the base64 after BEGIN
(and perhaps one word after its last run, which may be the rest of a line).

Edge cases: null and empty texts have no spans; repeated rows are scanned each;
an empty table gives no rows; other columns are ignored or, by ``redact``, kept;
very long runs of one class of characters are read in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as sre
from re import _parser as sre_parser

from trailmark.llm.common import by_bytes, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.A
    #: The group whose length counts, and the least length.
    group: int = 0
    least: int = 0
    #: The group that is the secret; what stands before it only anchors the search.
    span: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.A, 0, 20),
    Rule("hex", r"[0-9a-f]+", re.A, 0, 24),
)
#: What stands between the lines of a key: line ends (also written as ``\\n``), quotes and marks of quoting.
_GAP = r"""(?:[\s"'`,;>\#*|]|\\[nrt]|\+(?=\s))"""
_IN_LINE = r"""(?:[\x20\t\r"'`,;]|\\r|\+(?=\s))"""
_NEXT_LINE = rf"""(?:{_IN_LINE}*+\\n(?:{_IN_LINE}*+\n)?+|{_IN_LINE}*+\n)[\x20\t"'`>\#*|]*+"""
_LINE_END = r"""(?=[\x20\t\r"'`,;]*+(?:\n|\\[nr]|\Z))"""
_HEADERS = rf"""(?:{_GAP}++(?:[A-Z][A-Za-z0-9]*+-[A-Z][A-Za-z0-9-]*+|Comment):[^\n\\]*+)*+"""
_BODY = rf"""(?:{_GAP}++[A-Za-z0-9+/]{{16,}}+={{0,2}}|{_NEXT_LINE}[A-Za-z0-9+/]++={{0,2}}{_LINE_END})++(?:[\x20\t]++[A-Za-z0-9+/]++={{0,2}})?+"""
#: From BEGIN through the next END before another BEGIN. Without END: headers, then
#: lines of base64 (runs of 16 or more also within a line, with a word after them).
PRIVATE_KEY = rf"""-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:(?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20[A-Z ]{{0,40}}PRIVATE\x20KEY-----|(?:{_HEADERS}{_BODY})?+)"""
ADDED = (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # Sought from the start of each run of its characters, so that a long run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]+)", span=1),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"://[^/\s:@]+:[^/\s:@]+@"),
)
RULES = BASE + ADDED

#: A query is None (no mandatory trigram), or a set of alternatives, each a set of trigrams that all must occur.
Query = frozenset | None
#: Literal sets and alternatives beyond this size count as unknown.
MOST = 64


def _trigrams(literal: bytes) -> frozenset:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def _either(queries: Iterable[Query]) -> Query:
    out: set = set()
    for q in queries:
        if q is None:
            return None
        out |= q
    out = {a for a in out if not any(b < a for b in out)}  # what another alternative implies
    return frozenset(out) if 0 < len(out) <= MOST else None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    product = _either([frozenset(x | y for x in a for y in b)])
    return min((a, b), key=len) if product is None else product  # either side alone is still mandatory


def _walk(items) -> tuple[set[bytes] | None, Query]:
    """Of a parsed sequence: its exact strings, if they are few, and its query."""
    running: set[bytes] | None = {b""}
    exact, query = True, None

    def flush() -> None:
        nonlocal running, query
        if running and all(len(s) >= 3 for s in running):
            query = _both(query, _either([frozenset([_trigrams(s)]) for s in running]))
        running = {b""}

    for op, arg in items:
        options: set[bytes] | None = None
        inner: Query = None
        if op is sre.LITERAL:
            options = {chr(arg).encode().lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            options = {chr(a).encode().lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            options, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(x is not None for x, _ in found):
                options = set().union(*(x for x, _ in found))
            inner = _either([q if q is not None else _of_exact(x) for x, q in found])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            some, inside = _walk(body)
            if (low, high) == (0, 1) and some is not None:
                options = some | {b""}
            elif low == high == 1:
                options, inner = some, inside
            elif low:
                inner = _both(inside, _of_exact(some))
        elif op is sre.AT:
            options = {b""}
        if options is not None and len(options) * len(running) <= MOST:
            running = {a + b for a in running for b in options}
        else:
            flush()
            exact = False
            query = _both(query, inner if inner is not None else _of_exact(options))
    if exact:
        return running, query
    flush()
    return None, query


def _of_exact(strings: set[bytes] | None) -> Query:
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _either([frozenset([_trigrams(s)]) for s in strings])


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean trigram query that every (lower-cased) match satisfies."""
    strings, query = _walk(sre_parser.parse(pattern, flags))
    return _both(query, _of_exact(strings))


class Index:
    """Postings of the wanted trigrams over one slice of texts."""

    def __init__(self, wanted: Sequence[bytes]):
        self.slots = {t: i + 1 for i, t in enumerate(sorted(set(wanted)))}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.slots.items():
            self.table[int.from_bytes(t, "big")] = i

    def postings(self, texts: Sequence[bytes]) -> dict[bytes, np.ndarray]:
        joined = np.frombuffer(b"\0\0".join([*texts, b""]), dtype=np.uint8)
        if joined.size < 3:
            return {t: np.array([], dtype=np.int64) for t in self.slots}
        code = joined[:-2].astype(np.uint32) << 16
        code |= joined[1:-1].astype(np.uint32) << 8
        code |= joined[2:]
        slot = self.table[code]
        at = np.flatnonzero(slot)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        doc, slot = np.searchsorted(starts, at, side="right") - 1, slot[at]
        pairs = np.unique(slot.astype(np.int64) * len(texts) + doc)
        slot, doc = pairs // len(texts), pairs % len(texts)
        cuts = np.searchsorted(slot, np.arange(1, len(self.slots) + 2))
        return {t: doc[cuts[i - 1] : cuts[i]] for t, i in self.slots.items()}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The documents of a slice that may match: all ``n`` without a query."""
    if query is None:
        return np.arange(n)
    out = np.array([], dtype=np.int64)
    for trigrams in query:
        lists = sorted((postings[t] for t in trigrams), key=len)
        found = lists[0]
        for other in lists[1:]:
            if not len(found):
                break
            found = np.intersect1d(found, other, assume_unique=True)
        out = np.union1d(out, found)
    return out.astype(np.int64)


def scanner(rules: Sequence[Rule] = RULES) -> Callable[[list[str]], list[list[tuple[int, int, int]]]]:
    """A function from texts to, for each, its (start, rule number, end) in order."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    index = Index([t for q in queries if q is not None for alternative in q for t in alternative])
    # A class repeated without a bound matches maximal runs, so a least length can stand in the expression.
    searched = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if r.least and re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else r.pattern, r.flags) for r in rules]

    def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        postings = index.postings([t.encode().lower() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, pattern) in enumerate(zip(rules, queries, searched, strict=True)):
            for i in candidates(query, postings, len(texts)):
                found[i] += [(m.start(rule.span), k, m.end(rule.span)) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in found:
            spans.sort()
        return found

    return scan


SCHEMA = "doc_id long, n_spans long, spans array<struct<kind: string, start: long, end: long>>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``doc_id, n_spans, spans`` of every document, by start and then rule order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in by_bytes(batches, 4 << 20):
            found = find(b.column(1).to_pylist())
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_spans", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(task, SCHEMA)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_digest(spans: Column) -> Column:
    kept = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in BASE]))
    return F.sha2(digest(kept), 256)


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str = "n_chars", rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs``, each secret in the text replaced by ``mask``
    (overlapping spans by one) and ``chars_col``, if there, counted anew. A null text stays null."""

    @F.pandas_udf("string")
    def hidden(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = scanner(rules)
        for texts in parts:
            out: list[str | None] = []
            for i in range(0, len(texts), 256):
                some = texts.iloc[i : i + 256].tolist()
                for text, spans in zip(some, find([t or "" for t in some]), strict=True):
                    if spans:
                        pieces, at = [], 0
                        for start, _, end in spans:
                            if start >= at:
                                pieces += [text[at:start], mask]
                            at = max(at, end)
                        text = "".join([*pieces, text[at:]])
                    out.append(text)
            yield pd.Series(out, dtype="object")

    changed = docs.withColumn(text_col, hidden(F.col(text_col).cast("string")))
    return changed.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else changed


__all__ = ["ADDED", "BASE", "RULES", "Rule", "base_digest", "digest", "redact", "scan", "scanner", "trigram_query"]
