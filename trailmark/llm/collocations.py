"""Phrases of two to five words whose parts occur together more often than apart.

Texts are cut into shards of about ``SHARD_BYTES`` of one language, each with a
table of its own word ids. A shard's n-grams are the intervals of its suffix
array, built by prefix doubling in numpy, in which neighbours have n words in
common; the counts of all shards are summed by key. A phrase can only be as
frequent as each part of it, so what is summed shrinks from step to step, and
nothing that counts is lost:

1. every shard's words, then its pairs of frequent words, then its triples of
   frequent pairs are summed under hashes (phrases of one hash only look more
   frequent together), and each shard learns which of its are frequent;
2. words and phrases of two to five words made of these are summed by their text.

The shards are written once, as a table, and shuffled once; what a shard learns
is joined to it by its number. Nothing is broadcast but what Spark finds small.
Sums travel packed, one row for a shard and a range of hashes; a range is some
``RANGE_WORDS`` words of the corpus, so their number grows with it and a task's
memory does not. A word or phrase counts once a shard, however often it occurs.

A candidate's score is that of its weakest cut, ``floor(1000 a n / (l r))`` with
a, l and r the counts of the phrase and of its two parts and n that of all words
of the language, in exact decimals (counts up to 10^13). Candidates that occur
only within a longer one are dropped.

Edge cases: null and empty texts have no words; a null language is ``und``;
repeated rows count each; ties are broken by text, in byte order; an empty table
gives no rows; other columns are ignored. A text much longer than a shard is
cut between pieces, so only a single piece can make a shard longer.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import by_bytes, cut, text_of

#: Bytes of text in a shard, and of those that a task holds for all its languages.
SHARD_BYTES, HELD_BYTES = 4 << 20, 16 << 20
#: Words of the corpus whose sums meet in one task.
RANGE_WORDS = 1 << 22
LONGEST = 5
#: Exact up to 17 digits of 1000 a and of n, l and r.
SCORE_SQL = "(1000 * CAST(a AS DECIMAL(14,0))) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(17,0)) * CAST(r AS DECIMAL(17,0)))"
#: Ends of pieces become 0xFF, which no text holds; a tab becomes a space.
_END = b"\xff"
_TO = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")


def ngrams(ids: np.ndarray, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of word ids (0 ends a piece): for each n, where each distinct n-gram occurs
    first in the suffix array, and how often it occurs."""
    ids = np.concatenate([ids, [0]]).astype(np.int64)
    n = len(ids)
    # Sort by 1, 2, 4, ... words, each time by the ranks of both halves.
    rank, width = ids, 1
    order = np.argsort(ids, kind="stable")
    while width < longest:
        key = rank * (int(rank.max()) + 1)
        key[: max(0, n - width)] += rank[width:]
        order = np.argsort(key, kind="stable")
        along = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(along[1:] != along[:-1])])
        width *= 2
    ends = np.flatnonzero(ids == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words until the piece ends
    padded = np.concatenate([ids, np.zeros(longest, dtype=np.int64)])
    common, alike = np.zeros(n - 1, dtype=np.int64), np.ones(n - 1, dtype=bool)
    for k in range(longest):
        alike &= padded[order[1:] + k] == padded[order[:-1] + k]
        common += alike
    common = np.minimum(common, room[order[1:]])
    for size in range(shortest, longest + 1):
        heads = np.flatnonzero(np.concatenate([[True], common < size]))
        times = np.diff(np.append(heads, n))
        first = order[heads]
        whole = room[first] >= size
        yield size, first[whole], times[whole]


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, of which the upper ones are nearly empty."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _rising(x: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return _planes(np.diff(x, prepend=0))


def _of_rising(planes: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(planes))


def _tidy(ids: np.ndarray) -> np.ndarray:
    """Without words that stand alone between ends, and with one end between pieces."""
    on = np.concatenate([[False], ids > 0, [False]])
    kept = on[1:-1] & (on[:-2] | on[2:])
    before = np.concatenate([[False], kept[:-1]])
    return np.where(kept, ids, 0)[kept | before]


def shards(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``shard, lang, n, words, ids``: compressed, words by falling count with spaces
    between them, and their numbers in the text from 1 on (0 ends a piece)."""
    schema = "shard long, lang string, n long, words binary, ids binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def made(lang: str) -> Iterator[pa.RecordBatch]:
            data, at = _END.join(held.pop(lang)), 0
            del size[lang]
            while at < len(data):
                end = data.find(_END, at + shard_bytes)
                part = data[at : len(data) if end < 0 else end]
                at += len(part) + 1
                number_of: dict[bytes, int] = defaultdict(count().__next__)
                number_of[_END]
                found = part.replace(_END, b" \xff ").split()
                ids = np.fromiter(map(number_of.__getitem__, found), np.int64, len(found))
                order = np.argsort(-np.bincount(ids, minlength=1)[1:], kind="stable")
                if not len(order):
                    continue
                named = list(number_of)[1:]
                place = np.zeros(len(order) + 1, dtype=np.int64)
                place[order + 1] = np.arange(1, len(order) + 1)
                words = zlib.compress(b" ".join([named[i] for i in order.tolist()]), 3)
                columns = [pa.array([next(number)]), pa.array([lang]), pa.array([int((ids > 0).sum())]), pa.array([words], pa.binary()), pa.array([zlib.compress(_planes(place[ids]), 3)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "n", "words", "ids"])

        for b in by_bytes(batches, 4 << 20):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode().lower().translate(_TO)
                held.setdefault(lang, []).append(raw)
                size[lang] = size.get(lang, 0) + len(raw) + 1
                if size[lang] >= shard_bytes:
                    yield from made(lang)
                elif sum(size.values()) >= HELD_BYTES:
                    yield from made(max(size, key=size.__getitem__))
        for lang in sorted(held):
            yield from made(lang)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text_of(docs, text_col).alias("text")).mapInArrow(task, schema)


class _Shard:
    """A shard's word ids and the keys of its phrases: a range and 32 bits of a hash."""

    def __init__(self, lang: str, words: bytes, ids: bytes, ranges: int):
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        named = zlib.decompress(words).split(b" ")
        self.ids, self.ranges = _of_planes(zlib.decompress(ids)), ranges
        self.words = np.array(["", *(w.decode() for w in named)], dtype=object)
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in (b"", *named)), np.uint64, len(named) + 1)

    def keys(self, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        h = self.hashes[ids[at]]
        for k in range(1, size):
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[ids[at + k]]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(32)) % np.uint64(self.ranges) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def frequent(self, kept: np.ndarray) -> np.ndarray:
        """Pieces without rare words."""
        number = np.arange(1, len(self.words))
        good = np.concatenate([[False], np.isin(self.keys(number, np.arange(len(number)), 1), kept)])
        return _tidy(np.where(good[self.ids], self.ids, 0))

    def linked(self, ids: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Pieces cut where a pair of words is rare."""
        pair = (ids[:-1] > 0) & (ids[1:] > 0)
        pair[pair] = np.isin(self.keys(ids, np.flatnonzero(pair), 2), kept)
        return _tidy(np.insert(ids, np.flatnonzero(~pair) + 1, 0))


def _kept(known: list[dict] | None) -> np.ndarray:
    """What a shard has learnt, as keys."""
    found = [_of_rising(k["low"]) | k["range"] << 32 for k in known or []]
    return np.concatenate([*found, np.zeros(0, dtype=np.int64)])


def _by_range(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range and the places of its keys, rising."""
    order = np.argsort(keys, kind="stable")
    ranges = keys[order] >> 32
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    if len(keys):
        for part in np.split(order, cuts):
            yield int(keys[part[0]] >> 32), part


def _counted(level: int, ranges: int):
    """Counts of a shard's phrases of ``level`` words: ``shard, range, low, times``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                shard = _Shard(row["lang"], row["words"], row["ids"], ranges)
                ids = shard.ids
                if level > 1:
                    ids = shard.frequent(_kept(row["kept1"]))
                if level > 2:
                    ids = shard.linked(ids, _kept(row["kept2"]))
                ((_, at, times),) = ngrams(ids, level, level)
                keys = shard.keys(ids, at, level)
                parts = list(_by_range(keys))
                low = [_rising(keys[p] & 0xFFFFFFFF) for _, p in parts]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(parts), pa.int64()), pa.array([r for r, _ in parts], pa.int64()), pa.array(low, pa.binary()), pa.array([_planes(times[p]) for _, p in parts], pa.binary())], names=["shard", "range", "low", "times"])

    return task


def _summed(least: int):
    """Of a range, each shard's keys that occur ``least`` times in all shards."""

    def task(rows: pa.Table) -> pa.Table:
        low, times = [_of_rising(x) for x in rows.column("low").to_pylist()], [_of_planes(x) for x in rows.column("times").to_pylist()]
        _, which = np.unique(np.concatenate(low), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(times))
        good = np.split(total[which] >= least, np.cumsum([len(x) for x in low])[:-1])
        kept = [_rising(x[g]) for x, g in zip(low, good, strict=True)]
        some = pa.array([bool(k) for k in kept])
        return pa.table([rows.column("shard"), rows.column("range"), pa.array(kept, pa.binary())], names=["shard", "range", "low"]).filter(some)

    return task


def _phrases(ranges: int):
    """Counts of a shard's frequent words and phrases: ``range, lang, phrases, times``;
    the phrases of a row are compressed, a line each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                shard = _Shard(row["lang"], row["words"], row["ids"], ranges)
                one, two, three = (_kept(row[f"kept{k}"]) for k in (1, 2, 3))
                number = np.arange(1, len(shard.words))
                keys = shard.keys(number, np.arange(len(number)), 1)
                good = np.isin(keys, one)
                found = [(keys[good], shard.words[1:][good].tolist(), np.bincount(shard.ids, minlength=len(shard.words))[1:][good])]
                ids = shard.linked(shard.frequent(one), two)
                triple = np.zeros(len(ids) + LONGEST, dtype=bool)
                start = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
                triple[start] = np.isin(shard.keys(ids, start, 3), three)
                for size, at, times in ngrams(ids, 2, LONGEST):
                    whole = np.ones(len(at), dtype=bool)
                    for k in range(size - 2):
                        whole &= triple[at + k]
                    at, times = at[whole], times[whole]
                    found.append((shard.keys(ids, at, size), [" ".join(x) for x in zip(*(shard.words[ids[at + k]] for k in range(size)), strict=True)], times))
                keys, times = (np.concatenate([f[k] for f in found]) for k in (0, 2))
                text = np.array([t for f in found for t in f[1]], dtype=object)
                parts = []
                for r, p in _by_range(keys):
                    p = p[np.argsort(text[p])]  # like beginnings follow one another
                    parts.append((r, zlib.compress("\n".join(text[p].tolist()).encode(), 3), _planes(times[p])))
                if parts:
                    ranges_of, lines, counts = zip(*parts, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ranges_of, pa.int64()), pa.array([row["lang"]] * len(parts)), pa.array(lines, pa.binary()), pa.array(counts, pa.binary())], names=["range", "lang", "phrases", "times"])

    return task


def _frequent(least: int):
    """Of a range, the phrases that occur ``least`` times: ``lang, phrase, size, f``."""

    def task(rows: pa.Table) -> pa.Table:
        lines = [zlib.decompress(x).decode().split("\n") for x in rows.column("phrases").to_pylist()]
        lang = rows.column("lang").combine_chunks().take(pa.array(np.repeat(np.arange(len(lines)), [len(x) for x in lines])))
        flat = pa.table([lang, pa.array([t for x in lines for t in x], pa.string()), pa.array(np.concatenate([_of_planes(x) for x in rows.column("times").to_pylist()]))], names=["lang", "phrase", "times"])
        total = flat.group_by(["lang", "phrase"]).aggregate([("times", "sum")]).rename_columns(["lang", "phrase", "f"])
        total = total.filter(pc.greater_equal(total.column("f"), least))
        size = pc.cast(pc.add(pc.count_substring(total.column("phrase"), " "), 1), pa.int32())
        return pa.table([total.column("lang"), total.column("phrase"), size, total.column("f")], names=["lang", "phrase", "size", "f"])

    return task


def frequent_phrases(cuts: DataFrame, least: int, range_words: int = RANGE_WORDS) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of one to five words that occur ``least`` times."""
    ranges = max(1, -(-(cuts.agg(F.sum("n")).first()[0] or 0) // range_words))
    own = cuts.select("shard", "lang", "words", "ids")
    for level in (1, 2, 3):
        counted = own.mapInArrow(_counted(level, ranges), "shard long, range long, low binary, times binary")
        kept = counted.groupBy("range").applyInArrow(_summed(least), "shard long, range long, low binary")
        # At most a row a range, and no more than the shard's own phrases.
        learnt = kept.groupBy("shard").agg(F.collect_list(F.struct("range", "low")).alias(f"kept{level}"))
        # A shard of rare words alone has nothing to add.
        own = own.join(learnt, "shard", "inner" if level == 1 else "left")
    found = own.mapInArrow(_phrases(ranges), "range long, lang string, phrases binary, times binary")
    return found.groupBy("range").applyInArrow(_frequent(least), "lang string, phrase string, size int, f long")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases."""
    cuts = cut(shards(docs, text_col=text_col, lang_col=lang_col, shard_bytes=shard_bytes))
    sizes = cuts.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = cut(frequent_phrases(cuts, least, range_words))
    candidates = phrases.filter("size >= 2").withColumn("words", F.split("phrase", " "))

    def part(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    # Candidates that lie within a longer one as often as they occur at all.
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: part(i, m)))))
    inner = candidates.filter("size >= 3").select("lang", places.alias("phrase"), F.col("f").alias("within")).groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("f") * 100))

    counted = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("times"))
    cuts_of = kept.select("lang", "phrase", "size", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts_of = cuts_of.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    left, right = (counted.withColumnsRenamed({"part": p, "times": t}) for p, t in (("first", "l"), ("rest", "r")))
    scored = cuts_of.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang").withColumn("score", F.expr(SCORE_SQL))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.*")

    # First within parts of a language, so that no task sorts a whole one.
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = weakest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = salted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, piece AS text
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
worded AS (SELECT lang, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(words[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM worded, range(1, 6) AS s(size) WHERE len(words) >= size)),
f AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size >= 2),
inside AS (
  SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, max(a) AS within
  FROM (SELECT lang, words, a, m, unnest(range(1, size - m + 2)) AS i FROM cand, range(2, 5) AS t(m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN inside USING (lang, phrase) WHERE within IS NULL OR 100 * within < 100 * a),
cuts AS (
  SELECT kept.lang, kept.phrase, a, k, x.f AS l, y.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM kept JOIN range(1, 5) AS c(k) ON k < size
  JOIN f AS x ON x.lang = kept.lang AND x.phrase = array_to_string(words[1:k], ' ')
  JOIN f AS y ON y.lang = kept.lang AND y.phrase = array_to_string(words[k + 1:], ' ')
  JOIN sizes ON sizes.lang = kept.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""
