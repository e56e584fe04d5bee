"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches ``num / den``. The join is exact: it loses no link, up to collisions of
64-bit hashes, and sets no cap.

1. Documents of equal sets form a class; from here on a class counts once.
2. Routing. A class is split into as many hash buckets as two linked sets of its
   size can differ in shingles, and some more: linked classes then agree in a
   whole bucket (as many as "some more", so near-empty buckets, which agree by
   chance, need not be sent unless a class has more of them than that). Of the
   classes that agree in a bucket one is the hub, and all of them join the hub's
   family. Both ends of a link are so in one family at least, and a family grows
   with its hub's own buckets, not through those of its members. Keys that very
   many classes hold get their hub beforehand and are dealt to many tasks.
   What shares a line or a passage is often in a family by chance: members that
   no bitmap of another member allows to link are dropped by a first traversal,
   before any set is sent.
3. Signature trees. A family's classes are the leaves of a tree whose nodes
   hold the OR of their token bitmaps and their range of sizes. A dual traversal
   drops pairs of nodes by sizes and by the greatest overlap that the bitmaps
   allow, and leaf pairs by their own bound; the rest are checked exactly. Pairs
   that links already connect are passed over, so that a group of thousands of
   near copies costs about its size, not its square, and emits a spanning set
   of links.
4. A family too large for a task is cut into chunks by size and hash. Every
   chunk joins itself and the family's pivots (the hub and the classes that share
   most buckets with it, hence the centres of groups of copies). What is not
   connected after that is joined chunk by chunk, on the bitmaps only: chunk
   pairs are the upper level of the tree, pruned by their size ranges, and only
   pairs of classes in different components whose bound allows a link are
   checked on the sets.
5. Components of the links give each class, and so each document, its id.

Edge cases: null and empty texts, and texts of white space, have no set, link
with nothing and are their own component; repeated rows are alike and get equal
values; a null id takes part, but never names a component; an empty table gives
no rows; other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.common import cut, slices, text_of
from trailmark.llm.shingles import U, fingerprint, mix, shingle_sets
from trailmark.operators.components import components

LOW = U(0xFFFFFFFF)
#: Chunks whose bitmaps meet in one task, and the bytes that they may hold.
WIDE, WIDE_BYTES = 8, 8_000_000
#: Tasks among which the classes of one component are dealt when it gets its name.
SALTS = 32
#: Keys that are counted at once, and the most keys that are told to all tasks (24 bytes each).
TALLIED, TOLD = 500_000, 200_000
#: Members of families up to which the hashes of their texts are told to all tasks (8 bytes each).
PICKED = 500_000


# ---------------------------------------------------------------- routing


@dataclass(frozen=True)
class Routing:
    """Size levels, and how many buckets each has, for one threshold."""

    num: int
    den: int
    low: np.ndarray  # least size of each level
    buckets: np.ndarray
    spare: np.ndarray

    @staticmethod
    def of(num: int, den: int, factor: float = 1.25, most: int = 1 << 31) -> Routing:
        low, buckets, spare, at = [1], [], [], 1
        while at < most:
            above = max(at + 1, math.ceil(at * factor))
            # The smaller set of a linked pair holds the overlap, and the two
            # differ in (1 - t) / t of the overlap at most.
            differ, extra = (above - 1) * (den - num) // num, 0
            if differ:
                for _ in range(6):
                    n = differ + 1 + extra
                    empty = n * math.exp(-at / n)
                    extra = math.ceil(empty + 2 * math.sqrt(empty))
            low.append(above)
            buckets.append(differ + 1 + extra)
            spare.append(extra)
            at = above
        return Routing(num, den, np.array(low), np.array(buckets), np.array(spare))

    def levels(self, n: int) -> list[int]:
        """The set's own level, and those below that can hold its smaller partner."""
        i = int(np.searchsorted(self.low, n, side="right")) - 1
        out = [i]
        while i and n * self.num <= (int(self.low[i]) - 1) * self.den:
            i -= 1
            out.append(i)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Signed 64-bit keys: linked unequal sets have one in common."""
        out = []
        for level in self.levels(len(shingles)) if len(shingles) else ():
            m, spare = int(self.buckets[level]), int(self.spare[level])
            if m == 1:
                continue  # only equal sets link here
            bucket = (mix(shingles + U(7919 * level + 13)) % U(m)).astype(np.int64)
            value = mix(shingles + U(104729 * level + 77))
            held = np.bincount(bucket, minlength=m)
            low = np.bincount(bucket, (value & LOW).astype(np.float64), m).astype(U)
            high = np.bincount(bucket, (value >> U(32)).astype(np.float64), m).astype(U)
            key = mix(low + mix(high + mix(np.arange(m, dtype=U) + U(1000003 * level + 1))))
            full = held > 0
            out.append(key[full] if m - int(full.sum()) < max(1, spare) else key)
        return np.concatenate(out).view(np.int64) if out else np.array([], dtype=np.int64)


# ---------------------------------------------------------------- signature trees


def bitmap_bits(n: int) -> int:
    """Bits of a bitmap for sets of ``n`` shingles: four to eight each, a power of two."""
    return max(128, 1 << (4 * max(1, n) - 1).bit_length())


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, dtype=U)
    at = mix(shingles + U(0x51ED2701)) & U(bits - 1)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer bits from rows of wider ones."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class SignatureTree:
    """Levels of nodes over sets: OR of bitmaps, size range, and the most shingles beyond one a bit."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, leaf: int = 16, fan: int = 4):
        self.order = np.lexsort((*[maps[:, i] for i in range(min(4, maps.shape[1]))], sizes))
        self.maps, self.sizes = maps[self.order], sizes[self.order]
        over = self.sizes - np.bitwise_count(self.maps).sum(axis=1)
        cuts = np.arange(0, len(sizes), leaf)
        self.leaf = leaf
        level = (np.bitwise_or.reduceat(self.maps, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts), np.maximum.reduceat(over, cuts))
        self.levels, self.fan = [level], fan
        while len(level[1]) > 1:
            cuts = np.arange(0, len(level[1]), fan)
            level = (np.bitwise_or.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)

    def items(self, node: int) -> slice:
        return slice(node * self.leaf, min(len(self.sizes), (node + 1) * self.leaf))


def leaf_pairs(a: SignatureTree, b: SignatureTree, num: int, den: int) -> Iterator[tuple[slice, slice]]:
    """Pairs of leaves that the dual traversal keeps; ``a is b`` is a self-join."""
    same = a is b
    height = max(len(a.levels), len(b.levels)) - 1
    pairs = np.zeros((1, 2), dtype=np.int64)
    for level in range(height, -1, -1):
        la, lb = a.levels[min(level, len(a.levels) - 1)], b.levels[min(level, len(b.levels) - 1)]
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        kept = []
        for i in range(0, len(pairs), 4096):
            p = pairs[i : i + 4096]
            x, y = p[:, 0], p[:, 1]
            sizes_fit = (la[2][x] * den >= lb[1][y] * num) & (lb[2][y] * den >= la[1][x] * num)
            p, x, y = p[sizes_fit], x[sizes_fit], y[sizes_fit]
            overlap = np.bitwise_count(la[0][x] & lb[0][y]).sum(axis=1) + np.minimum(la[3][x], lb[3][y])
            overlap = np.minimum(overlap, np.minimum(la[2][x], lb[2][y]))
            # Linked sets overlap in t / (1 + t) of their summed sizes at least.
            kept.append(p[overlap * (num + den) >= num * (la[1][x] + lb[1][y])])
        pairs = np.concatenate(kept) if kept else pairs[:0]
        if level:
            down = []
            below_a, below_b = level - 1 < len(a.levels) - 1, level - 1 < len(b.levels) - 1
            for i in range(a.fan if below_a else 1):
                for j in range(b.fan if below_b else 1):
                    down.append(np.stack([pairs[:, 0] * a.fan + i if below_a else pairs[:, 0], pairs[:, 1] * b.fan + j if below_b else pairs[:, 1]], axis=1))
            pairs = np.concatenate(down)
            na, nb = len(a.levels[min(level - 1, len(a.levels) - 1)][1]), len(b.levels[min(level - 1, len(b.levels) - 1)][1])
            pairs = pairs[(pairs[:, 0] < na) & (pairs[:, 1] < nb)]
    for x, y in pairs.tolist():
        yield a.items(x), b.items(y)


def possible(a: SignatureTree, x: slice, b: SignatureTree, y: slice, num: int, den: int) -> np.ndarray:
    """Of two leaves, which pairs of sets the bitmaps and sizes allow to link."""
    ma, mb, na, nb = a.maps[x][:, None, :], b.maps[y][None, :, :], a.sizes[x][:, None], b.sizes[y][None, :]
    most = np.minimum(na - np.bitwise_count(ma & ~mb).sum(axis=2), nb - np.bitwise_count(mb & ~ma).sum(axis=2))
    return (na * den >= nb * num) & (nb * den >= na * num) & (most * (num + den) >= num * (na + nb))


def bitmaps(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Rows of a column of bitmaps as a matrix, folded to the least width among them."""
    views = [np.frombuffer(column[int(i)].as_buffer(), dtype=U) for i in rows]
    width = min(len(v) for v in views)
    return np.stack([v if len(v) == width else fold(v[None, :], width)[0] for v in views])


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """The exact test on sorted distinct shingles."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(x) + len(y) - shared)


def tree_join(sets: list[np.ndarray], num: int, den: int, first: int = 0) -> list[tuple[int, int]]:
    """A spanning set of the links among sets, by position. The ``first`` sets
    (pivots) are joined with all before the others are with each other."""
    if len(sets) == 2:
        return [(0, 1)] if linked(sets[0], sets[1], num, den) else []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    bits = 2 * bitmap_bits(int(sizes.max()))
    maps = np.stack([bitmap(s, bits) for s in sets])
    root = np.arange(len(sets))
    out = []

    def run(left: np.ndarray, right: np.ndarray | None) -> None:
        a = SignatureTree(maps[left], sizes[left])
        b = a if right is None else SignatureTree(maps[right], sizes[right])
        at_a, at_b = left[a.order], (left if right is None else right)[b.order]
        for x, y in leaf_pairs(a, b, num, den):
            ra, rb = root[at_a[x]], root[at_b[y]]
            if ra.min() == ra.max() == rb.min() == rb.max():
                continue
            allowed = possible(a, x, b, y, num, den) & (ra[:, None] != rb[None, :])
            for i, j in np.argwhere(allowed).tolist():
                p, q = int(at_a[x][i]), int(at_b[y][j])
                if root[p] != root[q] and linked(sets[p], sets[q], num, den):
                    out.append((p, q))
                    root[root == root[q]] = root[p]

    everything = np.arange(len(sets))
    if 0 < first < len(sets):
        run(everything[:first], everything)
        everything = everything[first:]
    run(everything, None)
    return out


# ---------------------------------------------------------------- the join


@dataclass(frozen=True)
class Options:
    words: int = 5
    num: int = 80
    den: int = 100
    #: Classes and shingles of one task's chunk, and pivots of a size bucket.
    chunk: int = 512
    chunk_shingles: int = 2_000_000
    pivots: int = 32
    #: Rows of a key beyond which several tasks share it.
    hot: int = 20_000


class Tally:
    """Counts the classes by key, some half a million keys at a time."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, c: int) -> None:
        self.keys.append(keys)
        self.owners.append(np.full(len(keys), c, dtype=np.int64))
        self.held += len(keys)

    def flush(self) -> list[dict]:
        """``key, n, c`` of the keys seen more than once: how often, and one class that has it."""
        if not self.held:
            return []
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        self.keys, self.owners, self.held = [], [], 0
        found, at, n = np.unique(keys, return_index=True, return_counts=True)
        often = n > 1
        return [{"key": k, "n": m, "c": c} for k, m, c in zip(found[often].tolist(), n[often].tolist(), owners[at[often]].tolist(), strict=True)]


def classify(docs: DataFrame, options: Options) -> DataFrame:
    """``doc_id, t, n, c, bitmap`` of every row: hash of the text, size, class (0 of none) and bitmap of its set.

    Some rows also carry ``often``: the keys that several classes before them hold.
    """
    routing = Routing.of(options.num, options.den)
    names = ["doc_id", "t", "n", "c", "bitmap", "often"]
    counts = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("c", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, sent, columns = Tally(), set(), None

        def rows(often: list[dict]) -> pa.RecordBatch:
            told = pa.array([None] * (len(columns[0]) - 1) + [often or None], counts)
            return pa.RecordBatch.from_arrays([*columns, told], names=names)

        for b in slices(batches):
            if columns is not None:
                yield rows(tally.flush() if tally.held > TALLIED else [])
            sets = shingle_sets(b.column(2).to_pylist(), options.words)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            classes = [fingerprint(s) if len(s) else 0 for s in sets]
            maps = pa.array([bitmap(s, bitmap_bits(len(s))).tobytes() if len(s) else None for s in sets], pa.binary())
            columns = [b.column(0), b.column(1), sizes, pa.array([c or None for c in classes], pa.int64()), maps]
            for c, s in zip(classes, sets, strict=True):
                if c and c not in sent:
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(c)
                    tally.add(routing.keys(s), c)
        if columns is not None:
            yield rows(tally.flush())

    schema = "doc_id long, t long, n long, c long, bitmap binary, often array<struct<key:long,n:long,c:long>>"
    return docs.select("doc_id", "t", "text").mapInArrow(task, schema)


def routed(docs: DataFrame, options: Options) -> DataFrame:
    """``key, c``: what classes are routed by; a class once in each slice of rows."""
    routing = Routing.of(options.num, options.den)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in slices(batches):
            keys, owners = [], []
            for s in shingle_sets(b.column(0).to_pylist(), options.words):
                c = fingerprint(s) if len(s) else 0
                if c and c not in sent:
                    if len(sent) > 200_000:
                        sent.clear()
                    sent.add(c)
                    k = routing.keys(s)
                    keys.append(k)
                    owners.append(np.full(len(k), c, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "c"])

    return docs.select("text").mapInArrow(task, "key long, c long")


def hubs(rows: DataFrame, docs: DataFrame, options: Options) -> DataFrame:
    """``key, hub, c`` of every key that classes share: the hub is one class of the
    key, the others are ``c``.

    A key may be that of a third of all classes. Such keys are known from the
    counts beside ``rows``; their hub is told to all tasks, so their rows need not
    meet and are dealt by class. How often a key must be seen to count as one
    grows with the table, so that at most ``TOLD`` keys are told.
    """
    keys = routed(docs, options)
    often = rows.where("often is not null").select(F.inline("often")).groupBy("key").agg(F.sum("n").alias("n"), F.min("c").alias("told"))
    seen, most = often.agg(F.sum("n"), F.max("n")).first()
    least = max(options.hot, (seen or 0) // TOLD + 1)
    hot = often.where(F.col("n") > least)
    if (most or 0) <= least:
        by_key = Window.partitionBy("key").orderBy("c")
        return keys.withColumn("hub", F.first("c").over(by_key)).where("hub <> c")
    dealt = hot.select("key", "told", F.ceil(F.col("n") / least).cast("int").alias("parts"))
    keys = keys.join(F.broadcast(dealt), "key", "left").withColumn("part", F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))))
    by_part = Window.partitionBy("key", "part").orderBy("c")
    return keys.withColumn("hub", F.coalesce("told", F.first("c").over(by_part))).where("hub <> c").select("key", "hub", "c")


def _sets(rows: DataFrame, options: Options) -> DataFrame:
    """``c, places, shingles``: the classes of ``rows`` with their sets. Equal rows
    follow one another in a task; one is kept."""
    places = rows.schema["places"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in slices(batches):
            keep = []
            for i, c in enumerate(b.column(0).to_pylist()):
                if c != last:
                    keep.append(i)
                last = c
            b = b.take(pa.array(keep, pa.int32()))
            sets = shingle_sets(b.column(2).to_pylist(), options.words)
            arrays = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), arrays], names=["c", "places", "shingles"])

    return rows.select("c", "places", "text").mapInArrow(task, f"c long, places {places}, shingles array<long>")


def _positions(column) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b].view(U) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def partners(maps: np.ndarray, sizes: np.ndarray, num: int, den: int, known: np.ndarray) -> np.ndarray:
    """Which sets have another that bitmaps and sizes allow to link with them; the
    ``known`` ones do, and are not compared with each other."""
    tree = SignatureTree(maps, sizes)
    found = known[tree.order]
    for x, y in leaf_pairs(tree, tree, num, den):
        if not (found[x].all() and found[y].all()):
            allowed = possible(tree, x, tree, y, num, den)
            if x == y:
                np.fill_diagonal(allowed, False)
            found[x] |= allowed.any(axis=1)
            found[y] |= allowed.any(axis=0)
    out = np.empty_like(found)
    out[tree.order] = found
    return out


def partnered(members: DataFrame, options: Options) -> DataFrame:
    """The ``members`` of families that by their bitmaps may link with another one there.

    Most members are in a family by chance, as they share a line or a passage. A
    bitmap is a tenth of its set or less, so this is settled before sets are sent.
    Large families are cut into chunks. Among near copies nearly all members find
    one in their own chunk; each of the rest meets all chunks.
    """
    num, den = options.num, options.den
    members = cut(members)

    def chunks(n: str, octets: str):
        return F.ceil(F.greatest(F.col(n) / (8 * options.chunk), F.col(octets) / WIDE_BYTES)).cast("int")

    def dealt(parts: str):
        return F.pmod(F.xxhash64("c"), parts).cast("int")

    size = members.groupBy("family").agg(F.count("c").alias("n"), F.sum(F.octet_length("bitmap")).alias("bytes"))
    size = cut(size.where("n > 1").withColumn("chunks", chunks("n", "bytes")))
    small = F.col("chunks") == 1
    totals = size.agg(F.sum(F.when(small, F.col("n"))).alias("n"), F.sum(F.when(small, F.col("bytes"))).alias("bytes"), F.count_if(~small).alias("large")).first()
    heaps = max(1, math.ceil((totals["bytes"] or 0) / WIDE_BYTES), math.ceil((totals["n"] or 0) / (8 * options.chunk)))

    def task(heap: pa.Table) -> pa.Table:
        family, sizes = heap.column("family").to_numpy(), heap.column("n").to_numpy()
        maps, found = heap.column("bitmap").combine_chunks(), heap.column("found").to_numpy().copy()
        order = np.argsort(family, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            if len(some) > 1 and not found[some].all():
                found[some] = partners(bitmaps(maps, some), sizes[some], num, den, found[some])
        return heap.set_column(heap.schema.get_field_index("found"), "found", pa.array(found)).drop(["heap"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields) + ", found boolean"

    def searched(heaped: DataFrame) -> DataFrame:
        return heaped.select("heap", *members.columns, "found").groupBy("heap").applyInArrow(task, schema)

    placed = members.join(size.select("family", "chunks"), "family").withColumn("found", F.lit(False))
    # Small families share a heap.
    kept = searched(placed.where("chunks = 1").withColumn("heap", F.pmod(F.xxhash64("family"), F.lit(heaps)))).where("found").drop("found")
    if not totals["large"]:
        return kept
    near = cut(searched(placed.where("chunks > 1").withColumn("heap", F.xxhash64("family", dealt("chunks")))))
    kept = kept.unionByName(near.where("found").drop("found"))
    # The members not found yet fill the first chunks of a family, the others those
    # after them. Each chunk meets the first ones, each pair of chunks in a heap.
    octets = F.octet_length("bitmap")
    counts = near.groupBy("family").agg(
        F.count_if(~F.col("found")).alias("rest"), F.sum(F.when(~F.col("found"), octets)).alias("rest_bytes"),
        F.count_if("found").alias("others"), F.sum(F.when(F.col("found"), octets)).alias("other_bytes"),
    )
    counts = cut(counts.where("rest > 0").select("family", chunks("rest", "rest_bytes").alias("firsts"), chunks("others", "other_bytes").alias("lasts")))
    if counts.isEmpty():
        return kept
    open_ = near.join(counts, "family")
    own = F.when(F.col("found"), F.col("firsts") + dealt("lasts")).otherwise(dealt("firsts"))
    met = F.when(F.col("found"), F.col("firsts")).otherwise(F.col("firsts") + F.col("lasts"))
    meets = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    late = searched(meets.withColumn("heap", F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other"))))
    # Those found before come out as found again; the others of these are new.
    late = late.where("found").join(near.where("not found").select("family", "c"), ["family", "c"], "left_semi")
    return kept.unionByName(late.drop("found").dropDuplicates(["family", "c"]))


def class_links(docs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """The rows' classes (``classify``), and a spanning set ``a, b`` of links between classes."""
    num, den = options.num, options.den
    rows = cut(classify(docs, options))
    # One class of a key is its hub. Two classes that share a key are both
    # in the family of that key's hub, so families cover all pairs to compare.
    edges = cut(hubs(rows, docs, options).groupBy("hub", "c").agg(F.count("key").alias("weight")))
    own = edges.groupBy("hub").agg(F.sum("weight").alias("weight")).select("hub", F.col("hub").alias("c"), "weight")
    reps = rows.where("n > 0").groupBy("c").agg(F.min(F.struct("doc_id", "t", "n", "bitmap")).alias("r"))
    # Size buckets of a ratio of den / num: partners are in the same or the next one.
    bucket = F.floor(F.log(F.col("r.n").cast("double")) / math.log(den / num)).cast("int")
    members = edges.unionByName(own).join(reps, "c")
    members = cut(partnered(members.select("c", F.col("hub").alias("family"), "weight", "r.*", bucket.alias("bucket")), options), edges)
    # By bucket first, combined before the shuffle, so a large family is a few rows.
    held = members.groupBy("family", "bucket").agg(F.count("c").alias("n"), F.sum("n").alias("s"))
    size = held.groupBy("family").agg(F.sum("n").alias("members"), F.sum("s").alias("shingles"))
    size = size.withColumn("large", (F.col("members") > options.chunk) | (F.col("shingles") > options.chunk_shingles) & (F.col("members") > 2))
    light = ~F.col("large")
    totals = size.agg(F.sum(F.when(light, F.col("shingles"))).alias("s"), F.sum(F.when(light, F.col("members"))).alias("m"), F.count_if("large").alias("large"), F.sum("members").alias("all")).first()
    heaps = max(1, math.ceil((totals["s"] or 0) / options.chunk_shingles), math.ceil((totals["m"] or 0) / (4 * options.chunk)))
    parts = held.join(size.where("large").select("family"), "family")
    chunks = F.ceil(F.greatest(F.col("n") / options.chunk, F.col("s") / options.chunk_shingles)).cast("int")
    parts = parts.select("family", "bucket", chunks.alias("chunks"))
    some_large = bool(totals["large"])
    if some_large:
        parts = cut(parts)
    placed = members.join(parts, ["family", "bucket"], "left") if some_large else members.withColumn("chunks", F.lit(None).cast("int"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("c"), "chunks").cast("int"))
    # A class is in as many families as its keys have hubs. One text of each
    # class, by its row's id and text hash.
    place = F.struct("family", "bucket", "chunk")
    homes = placed.groupBy("c", "doc_id", "t").agg(F.collect_list(place).alias("places"))
    if (totals["all"] or 0) <= PICKED:
        # So few that every task can know them: only their texts are shuffled.
        docs = docs.join(F.broadcast(homes.select("t").distinct()), "t", "left_semi")
    texts = docs.alias("d").join(homes.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.t") == F.col("m.t")))
    sets = cut(_sets(texts.select("m.c", "m.places", "d.text"), options))
    at_home = sets.select("c", F.explode("places").alias("place"), "shingles").select("c", "place.*", "shingles")

    columns = ["c", "family", "shingles"]
    heap = F.when(F.col("chunk").isNotNull(), F.xxhash64("family", "bucket", "chunk")).otherwise(F.pmod(F.xxhash64("family"), F.lit(heaps)))
    heaped = at_home.select(heap.alias("heap"), F.lit(False).alias("pivot"), *columns)
    if some_large:
        best = Window.partitionBy("family", "bucket").orderBy(F.desc("weight"), "c")
        named = placed.where("chunk is not null").withColumn("place", F.row_number().over(best)).where(F.col("place") <= options.pivots)
        near = named.select("c", "family", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
        sent = near.join(parts, ["family", "bucket"]).select("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "family", "bucket")
        sent = sent.select("c", F.xxhash64("family", "bucket", "chunk").alias("heap"), F.lit(True).alias("pivot"), "family")
        heaped = heaped.unionByName(sent.join(sets.select("c", "shingles"), "c"))

    def join_heap(heap: pa.Table) -> pa.Table:
        family, c, pivot, shingles = heap.column("family").to_numpy(), heap.column("c").to_numpy(), heap.column("pivot").to_numpy(zero_copy_only=False), _positions(heap.column("shingles"))
        order = np.lexsort((c, ~pivot, family))
        found = []
        for some in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
            # A class may come as a pivot too, and a text in several equal rows: once each.
            _, once = np.unique(c[some], return_index=True)
            some = some[np.sort(once)]
            if len(some) > 1:
                pairs = tree_join([shingles[i] for i in some], num, den, int(pivot[some].sum()))
                found += [(int(c[some[i]]), int(c[some[j]])) for i, j in pairs]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = cut(heaped.groupBy("heap").applyInArrow(join_heap, "a long, b long"))
    if not some_large:
        return rows, links
    return rows, links.unionByName(_across(placed.where("chunk is not null"), sets.select("c", "shingles"), links, options))


def _across(members: DataFrame, sets: DataFrame, links: DataFrame, options: Options) -> DataFrame:
    """Links between chunks of large families whose ends are not yet connected:
    ``members`` are the classes of such families with their bitmaps."""
    num, den = options.num, options.den
    labels = components(links).select(F.col("node").alias("c"), F.col("label").alias("label"))
    # Bitmaps are an eighth of the sets or so, hence several chunks fit where one
    # did, and each goes to fewer pairs; how many, follows from the sizes in a
    # bucket (two bytes a shingle at most). A wide chunk is joined with itself as well.
    heaviest = 2 * options.chunk * F.pow(F.lit(den / num), F.col("bucket") + 1)
    width = F.greatest(F.lit(1), F.least(F.lit(WIDE), F.floor(WIDE_BYTES / heaviest)))
    wide = F.floor(F.col("chunk") / width).cast("int").alias("wide")
    known = members.join(labels, "c", "left").select("c", "n", "family", "bucket", wide, "bitmap", F.coalesce("label", "c").alias("label"))
    known = cut(known)
    nodes = cut(known.groupBy("family", "bucket", "wide").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("label"), (F.min("label") == F.max("label")).alias("one")))
    x, y = nodes.alias("x"), nodes.alias("y")
    after = (F.col("y.bucket") == F.col("x.bucket") + 1) | (F.col("y.bucket") == F.col("x.bucket")) & (F.col("y.wide") >= F.col("x.wide"))
    open_ = ~(F.col("x.one") & F.col("y.one") & (F.col("x.label") == F.col("y.label"))) & (F.col("x.high") * den >= F.col("y.low") * num)
    pairs = x.join(y, F.col("x.family").eqNullSafe(F.col("y.family")) & after & open_)
    pairs = cut(pairs.select(F.col("x.family").alias("family"), F.struct("x.bucket", "x.wide").alias("l"), F.struct("y.bucket", "y.wide").alias("r")).withColumn("pair", F.xxhash64("family", "l.bucket", "l.wide", "r.bucket", "r.wide")))

    def side(name: str) -> DataFrame:
        at = pairs.select("pair", "family", f"{name}.bucket", f"{name}.wide")
        # Names of its own for each side: both come from the same table.
        return known.join(at, ["family", "bucket", "wide"]).select(*(F.col(x).alias(f"{name}_{x}") for x in ("pair", "c", "n", "label", "bitmap")))

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            both = pa.concat_tables([left.rename_columns(right.column_names), right]).combine_chunks()
            maps = bitmaps(both.column(4).combine_chunks(), np.arange(len(both)))

            def tree(t: pa.Table, maps: np.ndarray) -> tuple[SignatureTree, np.ndarray, np.ndarray]:
                s = SignatureTree(maps, t.column(2).to_numpy())
                return s, t.column(1).to_numpy()[s.order], t.column(3).to_numpy()[s.order]

            (a, ca, la), (b, cb, lb) = tree(left, maps[: len(left)]), tree(right, maps[len(left) :])
            for p, q in leaf_pairs(a, b, num, den):
                i, j = np.nonzero(possible(a, p, b, q, num, den) & (la[p][:, None] != lb[q][None, :]))
                found.append((ca[p][i], cb[q][j]))
        ends = [np.concatenate([f[i] for f in found]) if found else np.array([], dtype=np.int64) for i in (0, 1)]
        return pa.table([pa.array(x, pa.int64()) for x in ends], names=["a", "b"])

    maybe = side("l").groupBy("l_pair").cogroup(side("r").groupBy("r_pair")).applyInArrow(candidates, "a long, b long")
    maybe = maybe.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    once = sets.dropDuplicates(["c"])
    checked = maybe.join(once.withColumnsRenamed({"c": "a", "shingles": "sa"}), "a").join(once.withColumnsRenamed({"c": "b", "shingles": "sb"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = [linked(s, t, num, den) for s, t in zip(_positions(pa.chunked_array([b.column(2)])), _positions(pa.chunked_array([b.column(3)])), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return cut(checked.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, options: Options) -> DataFrame:
    """``doc_id, t, n, label, component_id`` of every row, ``t`` a hash of its text, ``label`` its group's."""
    text = text_of(docs, text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows, links = class_links(keyed, options)
    labels = components(links).withColumnRenamed("node", "c")
    classes = cut(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first")).join(labels, "c", "left"))
    # Only classes with links have a label. A label may be that of a third of all
    # classes, so each label's name is dealt to as many tasks as there are salts.
    joined = classes.where("label is not null")
    named = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    # Rows that repeat a label compress well, which a broadcast would not stay.
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    salted = joined.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int")).join(named, ["label", "salt"])
    alone = classes.where("label is null").select("c", F.col("c").alias("label"), F.col("first").alias("component_id"))
    by_class = cut(salted.select("c", "label", "component_id").unionByName(alone), classes)
    # Rows without words have no class, and need not meet in a task.
    named = rows.where("c is not null").join(by_class, "c").select("doc_id", "t", "n", "label", "component_id")
    return named.unionByName(rows.where("c is null").select("doc_id", "t", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id")))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the size of its set and
    the smallest id that links reach from it, its own included."""
    return _grouped(docs, id_col, text_col, options or Options()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns, but of each group of linked rows
    the one of the smallest id; of several rows with that id, one of the smallest
    hash of the text. Groups that are not linked each keep a row, though their
    smallest ids be the same.

    Rows without words are in no group and all stay, and so do rows of unlike
    texts in a group in which no row has an id.
    """
    found = cut(_grouped(docs, id_col, text_col, options or Options()).where("n > 0"))
    dropped = found.where("component_id is not null and doc_id is distinct from component_id").select("doc_id", "t").distinct()
    first = found.where("doc_id = component_id")
    tied = first.groupBy("label").agg(F.min("t").alias("least"), F.max("t").alias("most")).where("least < most").select("label", "least")
    repeated = found.groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t")
    there = {r[0] for r in tied.select(F.lit("tied")).limit(1).union(repeated.select(F.lit("repeated")).limit(1)).collect()}
    if "tied" in there:
        dropped = dropped.unionByName(first.join(tied, "label").where("t > least").select("doc_id", "t").distinct())
    marked = docs.withColumns({"__id": F.col(id_col).cast("long"), "__t": F.xxhash64(text_of(docs, text_col))})

    def match(keys: DataFrame):
        return F.col("__id").eqNullSafe(keys["doc_id"]) & (F.col("__t") == keys["t"])

    kept = marked.join(dropped, match(dropped), "left_anti")
    if "repeated" in there:
        once = kept.join(repeated, match(repeated), "left_semi").dropDuplicates(["__id", "__t"])
        kept = kept.join(repeated, match(repeated), "left_anti").unionByName(once)
    return kept.drop("__id", "__t")


def oracle_sql(words: int, num: int, den: int) -> str:
    """DuckDB SQL of ``join`` over ``documents``."""
    parts = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(words))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {parts}))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""
