"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target of words. A source above its own size is taken whole
as often as its target holds it; of the rest, a part is taken once more: the
documents whose hash lies below the source's threshold. The threshold comes
from nested histograms: words are summed by source and by the leading digit of
the hash, a running sum over the digits finds the one in which the budget ends,
and only the documents of that boundary digit are summed again, by their next
digit, until one hash value is left. No documents are sorted and each level's
sums are combined before the shuffle, so a hot source is no hot task.

The per-source table (name, size, target) passes through the driver; sources
are a dimension of the corpus, and more than ``max_sources`` are an error. It
is broadcast below ``broadcast_sources`` rows and joined by shuffle beyond.

Edge cases: a null text has size 0; a null source is a source of its own, in
the last place; of rows alike in id and text at the threshold as many are taken
as come nearest to the target (which of them, is not fixed); documents of size 0
are taken 0 words; an empty table gives no rows; other columns are ignored.
Reruns agree, whatever the partitions, for the hash is of id and text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from trailmark.llm.common import cut, text_of, word_count

#: Hexadecimal digits of the hash, and how many of them one level of histograms resolves.
HASH_DIGITS, LEVEL_DIGITS = 15, 3
#: Tasks among which rows alike at a threshold are dealt.
TIE_TASKS = 64


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Targets: ``share`` of all words by weight, none above ``most`` times its
    source; what is above goes to the others by weight until none is above."""
    targets = [0.0] * len(sizes)
    budget, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        part = {i: budget * weights[i] / total for i in free}
        over = [i for i in free if part[i] > most * sizes[i]]
        if not over:
            for i in free:
                targets[i] = part[i]
            break
        for i in over:
            targets[i] = most * sizes[i]
            budget -= targets[i]
        free = [i for i in free if i not in set(over)]
    return targets


def _hash(id_col: str, text_col: str):
    """60 bits, alike in every SQL engine that has md5."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.substring(F.md5(key), 1, HASH_DIGITS)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, max_sources: int = 1_000_000, broadcast_sources: int = 20_000) -> DataFrame:
    """``doc_id, size, source, source_size, target, times, taken`` of all documents.

    ``weights`` repeat over the sources in the order of their names' code points,
    null last. ``times`` says how often the document is taken (at most ``most``,
    rounded up), ``taken`` is ``times * size``. A source's taken words differ
    from its target by half of one document at most, of the one at the threshold.
    """
    base, plan = _plan(docs, id_col, text_col, source_col, weights, share, most, max_sources)
    few = plan.count() <= broadcast_sources
    joined = base.join(F.broadcast(plan) if few else plan.hint("shuffle_merge"), base["source"].eqNullSafe(plan["name"]))
    columns = [F.col(c).alias(f"__{c}") for c in ("h", "name", "whole", "threshold", "ties")]
    counted = _times(joined.select("doc_id", "size", "source", "source_size", "target", *columns), plan)
    return counted.select("doc_id", "size", "source", "source_size", "target", F.col("__times").alias("times"), (F.col("__times") * F.col("size")).alias("taken"))


def _times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with ``__h`` and the plan's columns) and ``__times``, how often each is taken.

    Where a source's budget ends within rows of one hash, ``ties`` of these are
    taken once more. They are numbered in ``TIE_TASKS`` groups and by offsets.
    """
    below = F.when((F.col("__h") < F.col("__threshold")) | (F.col("__h") == F.col("__threshold")) & F.col("__ties").isNull(), 1).otherwise(0)
    times = F.col("__whole") + below
    if plan.where("ties is not null").isEmpty():
        return rows.withColumn("__times", times)
    at_edge = F.coalesce((F.col("__h") == F.col("__threshold")) & F.col("__ties").isNotNull(), F.lit(False))
    tied = cut(rows.where(at_edge).withColumn("__group", F.monotonically_increasing_id() % TIE_TASKS))
    sizes = tied.groupBy("__name", "__group").count().withColumnsRenamed({"__name": "__n", "__group": "__g"})
    offset = Window.partitionBy("__n").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__n", "__g", F.coalesce(F.sum("count").over(offset), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__name", "__group").orderBy("__h"))
    numbered = tied.withColumn("__place", place).join(sizes, F.col("__name").eqNullSafe(F.col("__n")) & (F.col("__group") == F.col("__g")))
    taken = F.when(F.col("__place") + F.col("__before") <= F.col("__ties"), 1).otherwise(0)
    return rows.where(~at_edge).withColumn("__times", times).unionByName(numbered.withColumn("__times", F.col("__whole") + taken).select(*rows.columns, "__times"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, max_sources: int = 1_000_000, broadcast_sources: int = 20_000) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it.

    The hash is computed on the row itself, so rows need no key to be found again.
    """
    _, plan = _plan(docs, id_col, text_col, source_col, weights, share, most, max_sources)
    few = plan.count() <= broadcast_sources
    side = plan.select(*(F.col(c).alias(f"__{c}") for c in ("name", "whole", "threshold", "ties")))
    joined = docs.withColumn("__h", _hash(id_col, text_col)).join(F.broadcast(side) if few else side.hint("shuffle_merge"), F.col(source_col).cast("string").eqNullSafe(F.col("__name")))
    copies = _times(joined, plan).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int"))))
    return copies.select(*docs.columns)


def _plan(docs, id_col, text_col, source_col, weights, share, most, max_sources) -> tuple[DataFrame, DataFrame]:
    """The documents' compact table, and per source its size, target, whole copies and threshold."""
    spark = docs.sparkSession
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(docs, text_col)).alias("size"), _hash(id_col, text_col).alias("h")))
    sources = base.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sources))], share, most)
    rows = []
    for r, size, target in zip(sources, sizes, targets, strict=True):
        whole = int(target // size) if size else 0
        rows.append((r["source"], size, float(target), whole, float(target - whole * size)))
    fields = [("name", StringType()), ("source_size", LongType()), ("target", DoubleType()), ("whole", LongType()), ("extra", DoubleType())]
    plan = spark.createDataFrame(rows, StructType([StructField(n, t) for n, t in fields]))
    found = thresholds(base, {r[0]: r[4] for r in rows})
    marks = spark.createDataFrame([(r[0], *found.get(r[0], (None, None))) for r in rows], StructType([StructField("n", StringType()), StructField("threshold", StringType()), StructField("ties", LongType())]))
    return base, plan.join(marks, plan["name"].eqNullSafe(marks["n"])).drop("n", "extra")


def thresholds(base: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, tuple[str, int | None]]:
    """For each source the greatest hash to take, so that the words of all hashes
    up to it come nearest to its budget, and how many rows of that hash (none:
    all); absent where nothing is to be taken."""
    spark = base.sparkSession
    schema = StructType([StructField("name", StringType()), StructField("prefix", StringType()), StructField("left", DoubleType())])
    out: dict[str | None, tuple[str, int | None]] = {}
    state = {n: ("", b) for n, b in budgets.items() if b > 0}
    digits = 0
    while state and digits < HASH_DIGITS:
        digits += LEVEL_DIGITS
        now = spark.createDataFrame([(n, p, b) for n, (p, b) in state.items()], schema)
        inside = base.join(F.broadcast(now) if len(state) <= 20_000 else now, base["source"].eqNullSafe(now["name"]) & F.col("h").startswith(F.col("prefix")))
        sums = inside.groupBy("name", F.substring("h", 1, digits).alias("part")).agg(F.sum("size").alias("words"), F.count("h").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("left").alias("left"))
        # Running sums in two steps, first over the parts' leading digits and then
        # within these, so no task orders all parts of a source.
        sums = sums.withColumn("head", F.substring("part", 1, digits - 1))
        heads = sums.groupBy(F.col("name").alias("n"), F.col("head").alias("h1")).agg(F.sum("words").alias("w"), F.max("high").alias("top"))
        order = Window.partitionBy("n").orderBy("h1")
        heads = heads.select("n", "h1", (F.sum("w").over(order) - F.col("w")).alias("ahead"), F.lag("top").over(order).alias("top"))
        inner = Window.partitionBy("name", "head").orderBy("part")
        run = sums.join(heads, F.col("name").eqNullSafe(F.col("n")) & (F.col("head") == F.col("h1")))
        run = run.withColumn("upto", F.col("ahead") + F.sum("words").over(inner)).withColumn("before", F.col("upto") - F.col("words"))
        # The part in which the budget ends, and the greatest hash before it.
        run = run.withColumn("previous", F.coalesce(F.lag("high").over(inner), "top"))
        edge = run.where((F.col("before") < F.col("left")) & (F.col("upto") >= F.col("left"))).groupBy("name").agg(F.min(F.struct("part", "before", "words", "rows", "low", "high", "previous")).alias("e"))
        following = {}
        for r in edge.collect():
            n, e = r["name"], r["e"]
            left = state[n][1] - e["before"]
            if e["previous"] is not None:
                out[n] = e["previous"], None
            if e["low"] == e["high"]:
                # Rows of one hash are alike, so all of one size.
                taken = min(e["rows"], int(left * e["rows"] / e["words"] + 0.5))
                if taken:
                    out[n] = e["high"], None if taken == e["rows"] else taken
            else:
                following[n] = (e["part"], left)
        state = following
    return out


ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM base GROUP BY source),
-- In order of 2 * size / weight, the sources up to some place stop at twice their size.
capped AS (
  SELECT *, coalesce(sum(2.0 * source_size) OVER before, 0) AS caps,
    sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    1.5 * sum(source_size) OVER () AS budget
  FROM sources WINDOW before AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((budget - caps) / free, 2.0 * source_size / weight) AS rate FROM capped WHERE (budget - caps) / free * weight <= 2.0 * source_size),
targets AS (
  SELECT source, source_size, least(weight * rate, 2.0 * source_size) AS target FROM sources, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
summed AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS upto, sum(b.size) OVER (PARTITION BY b.source, b.h) AS tied,
    row_number() OVER (PARTITION BY b.source, b.h) AS place
  FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (whole + CASE WHEN extra > 0 AND 2 * (upto - tied + place * size) - size <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
