"""Approximate nearest neighbours by learned partitions.

On a bounded sample of the vectors a neighbour graph is built and cut into
balanced parts: a start by recursive halving, then size-bounded label moves
that follow the edges. A small network learns from a vector the parts in which
its neighbours lie. Every vector is stored in its most probable part; a query
goes to the most probable parts (so many as reached ``recall`` on sampled
queries) and all vectors stored there are reranked by the exact cosine.

In Spark: a map gives each vector its part, parts are split into chunks of
bounded size by hash, probes of queries are split likewise, and a cogrouped
function compares a chunk of vectors with a chunk of queries. So neither a hot
part nor copies of one vector make a hot task. The best of each chunk meet in a
window by query that drops all but ``k`` before its shuffle.

Edge cases: vectors that are null, zero, of another length than the most
common one, or with null or non-finite components take no part; rows of one id
are candidates once per query (by their best score) and never their own query's;
a query id in several rows is the query of its smallest vector; fewer than
``k`` candidates are all returned; an empty table gives no rows; other columns
are ignored. Equal vectors get equal scores, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.common import cut


#: Parts of the smallest tables; a sample of no more than two vectors a part is one part.
MIN_PARTS = 4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """For each unit row its ``k`` nearest other rows, by blocks."""
    out = []
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A partition of the neighbour graph whose parts hold ``slack`` times their share at most."""
    label = np.zeros(len(x), dtype=np.int64)
    stack = [(np.arange(len(x)), 0, parts)]
    while stack:  # halves along the direction of greatest spread
        rows, first, n = stack.pop()
        if n == 1 or not len(rows):
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.svd(centred[:2048], full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(x.shape[1])
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = n // 2
        at = len(rows) * left // n
        stack += [(order[:at], first, left), (order[at:], first + left, n - left)]
    # Edges both ways, as a list of neighbours for each vertex.
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.searchsorted(a, np.arange(len(x) + 1))
    sizes, limit = np.bincount(label, minlength=parts), int(np.ceil(len(x) / parts * slack - 1e-9))
    for _ in range(rounds):
        moved = 0
        for v in range(len(x)):
            votes = np.bincount(label[b[cuts[v] : cuts[v + 1]]], minlength=parts)
            now = label[v]
            votes[(sizes >= limit) & (np.arange(parts) != now)] = -1
            best = int(votes.argmax())
            if votes[best] > votes[now]:
                label[v], moved = best, moved + 1
                sizes[now] -= 1
                sizes[best] += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """One hidden layer from a unit vector to part probabilities, and how many parts to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @staticmethod
    def fit(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, batch: int = 128, rate: float = 0.003) -> Router:
        """Cross-entropy against the shares ``target``, Adam steps, fixed seed."""
        rng = np.random.default_rng(7)
        d, p = x.shape[1], target.shape[1]
        par = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
        par[0] *= np.sqrt(d)  # components of unit vectors are small
        m, v, t = [np.zeros_like(q) for q in par], [np.zeros_like(q) for q in par], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                h = np.maximum(x[rows] @ par[0] + par[1], 0)
                z = h @ par[2] + par[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                e = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                back = (e @ par[2].T) * (h > 0)
                grads = [x[rows].T @ back, back.sum(0), h.T @ e, e.sum(0)]
                t += 1
                for q, g, a, b in zip(par, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return Router(*par)


def train(sample: np.ndarray, *, parts: int, k: int = 10, recall: float = 0.95) -> Router:
    """Partition the sample's graph, learn the router and choose how many parts to probe."""
    x = unit(sample)
    if parts <= 1 or len(x) <= 2 * parts:
        d = x.shape[1] if len(x) else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbours(x, min(k, len(x) - 1))
    label = balanced_parts(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), near.shape[1] / 2)
    for column in near.T:
        np.add.at(target, (np.arange(len(x)), label[column]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    # Learn from nine tenths; the rest are queries that say how many parts are needed.
    asked = np.arange(len(x)) % 10 == 0
    router = Router.fit(x[~asked], target[~asked])
    z = router.logits(x)
    stored = z.argmax(axis=1)
    place = np.argsort(np.argsort(-z[asked], axis=1, kind="stable"), axis=1)  # of each part among a query's probes
    hit = np.take_along_axis(place, stored[near[asked][:, :5]], axis=1)
    reached = [(hit < n).mean() for n in range(1, parts + 1)]
    router.probes = next((n for n, r in enumerate(reached, 1) if r >= recall), parts)
    return router


def usable(v: Column) -> Column:
    """Not null, not empty, finite in every component and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, fit_rows: int = 4_096, rows_per_part: int = 1_500, max_parts: int = 1_024, chunk_rows: int = 8_192, recall: float = 0.99) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found.

    ``is_query`` is a condition on the columns of ``vectors``. The sample is
    ``fit_rows`` rows of smallest hash, or 16 a part if that is more; a part is
    planned to hold ``rows_per_part`` vectors, with ``MIN_PARTS`` to ``max_parts``
    parts. Beyond ``max_parts * rows_per_part`` vectors parts grow with the table.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    d, n = lengths["d"], lengths["count"]
    rows = rows.where(F.size("v") == d)
    parts = min(max_parts, max(MIN_PARTS, n // rows_per_part))
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(fit_rows, 16 * parts))
    sample = np.unique(np.array([r["v"] for r in sample.collect()], dtype=float).reshape(-1, d), axis=0)
    router = train(sample, parts=int(parts), recall=recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = router.logits(unit(_matrix(b.column("v")))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], names=["vec_id", "v", "asked", "part"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = router.logits(unit(_matrix(b.column("q"))))
                best = np.argsort(-z, axis=1, kind="stable")[:, : router.probes].astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, probes], names=["query_id", "q", "probes"])

    # Copies of a row say nothing new; without them one id cannot fill a chunk.
    rows = rows.groupBy("vec_id", "v").agg(F.max("asked").alias("asked"))
    index = cut(rows.mapInArrow(place, "vec_id long, v array<double>, asked boolean, part int"))
    queries = cut(index.where("asked").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")).mapInArrow(probe, "query_id long, q array<double>, probes array<int>").select("query_id", "q", F.explode("probes").alias("part")))
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    asked = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}
    chunks = {p: (-(-n // chunk_rows), -(-asked[p] // chunk_rows)) for p, n in held.items() if p in asked}
    if not chunks:
        return empty
    # Both tables hold one row a part, at most ``max_parts``.
    plan = F.broadcast(spark.createDataFrame([(p, *c) for p, c in chunks.items()], "part int, v_chunks int, q_chunks int"))
    left = index.join(plan, "part").select("part", F.pmod(F.xxhash64("vec_id"), "v_chunks").cast("int").alias("vc"), F.explode(F.sequence(F.lit(0), F.col("q_chunks") - 1)).alias("qc"), "vec_id", "v")
    right = queries.join(plan, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("v_chunks") - 1)).alias("vc"), F.pmod(F.xxhash64("query_id"), "q_chunks").cast("int").alias("qc"), "query_id", "q")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(a) or not len(b):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, x = a.column("vec_id").to_numpy(), unit(_matrix(a.column("v")))
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        firsts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # all rows of an id are in this chunk
        out: list[tuple] = []
        for i in range(0, len(b), 512):
            some = b.slice(i, 512)
            asked_ids, y = some.column("query_id").to_numpy(), unit(_matrix(some.column("q")))
            s = y @ x.T
            s[asked_ids[:, None] == ids[None, :]] = -np.inf
            best = np.maximum.reduceat(s, firsts, axis=1)  # of each id; the cut counts ids, not rows
            m = min(k, len(firsts))
            for row, (query, vector) in enumerate(zip(asked_ids, y, strict=True)):
                least = np.partition(best[row], len(firsts) - m)[len(firsts) - m]
                near = np.flatnonzero((s[row] >= least - 1e-9) & (s[row] > -np.inf))
                exact = (x[near] * vector).sum(axis=1)  # in one order of summation, wherever the vector stands
                taken: set[int] = set()
                for j in np.lexsort((ids[near], -exact)):
                    if len(taken) < k and int(ids[near[j]]) not in taken:
                        taken.add(int(ids[near[j]]))
                        out.append((int(query), int(ids[near[j]]), float(exact[j])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    keys = ("part", "vc", "qc")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
