"""Joins, ordered comparisons and summaries over matches, tracks and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.schemas import keyed

#: The identity of whatever belongs to none.
UNKNOWN = 880


def matched(detections: DataFrame, matches: DataFrame, *keys: str) -> DataFrame:
    """Detections that have a match (once each, however many matches there are)."""
    return detections.join(matches.select(*keys), list(keys), "left_semi")


def unmatched(detections: DataFrame, matches: DataFrame, *keys: str) -> DataFrame:
    return detections.join(matches.select(*keys), list(keys), "left_anti")


def local_of(detections: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("frame_idx", "det_id"), local: str = "local_track_id") -> DataFrame:
    """Detections with the local track that took them; others are dropped."""
    return detections.join(matches.select(*keys, local), list(keys))


def global_of(rows: DataFrame, mapping: DataFrame, keys: tuple[str, ...] = ("epoch_id", "local_track_id"), identity: str = "global_track_id") -> DataFrame:
    """Rows with their identity; tracks outside the mapping are dropped."""
    return rows.join(mapping.select(*keys, identity), list(keys))


def known_or(rows: DataFrame, identity: str = "global_track_id", unknown: int = UNKNOWN) -> DataFrame:
    return rows.withColumn(identity, F.coalesce(F.col(identity), F.lit(unknown).cast("bigint")))


def merged(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Two maps as one; the second's entries win."""
    both = first.select(key, value, F.lit(0).alias("__rank")).unionByName(second.select(key, value, F.lit(1).alias("__rank")))
    return both.groupBy(key).agg(F.max_by(value, "__rank").alias(value))


def last_per_frame(rows: DataFrame, by: Column, keys: tuple[str, ...] = ("global_track_id", "frame_idx"), value: str = "event_id") -> DataFrame:
    """Of several rows of an identity in a frame the last in the order ``by``."""
    return rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.max_by(value, by).alias(value))


def change(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """``change``: the value less that of the row before."""
    return rows.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def absent_after(rows: DataFrame, key: str = "global_track_id", frame: str = "frame_idx") -> DataFrame:
    """``key, last_frame``: frames after which a matched track is missing and later comes again."""
    seen = rows.select(key, frame).distinct()
    after = seen.withColumn("__next", F.lead(frame).over(Window.partitionBy(key).orderBy(frame)))
    return after.where(F.col("__next") != F.col(frame) + 1).select(key, F.col(frame).alias("last_frame"))


def top_by_hits(hits: DataFrame, by: list[str], key: str, most: int = 4) -> DataFrame:
    """The ``most`` tracks of most hits in each group, ties to the smaller id."""
    order = Window.partitionBy(*by).orderBy(F.desc("hits"), key)
    return hits.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most).drop("__place")


def candidate_budget(states: DataFrame, most: int = 4, start: int = 9, step: int = 9, calm: int = 7) -> DataFrame:
    """``epoch_id, frame_idx, missed_top, used, budget``: how many extra detections a
    frame, and the next one, may keep.

    A frame that misses one of the ``most`` tracks of most hits of the frame before
    adds ``step`` to the budget, any other sets it to ``calm``; an epoch's first
    frame, which has no track to miss, uses ``start``. ``states`` has a row a track and frame, with ``hits`` after the frame
    and ``matched``; repeated rows count once, a null ``matched`` is a miss.
    """
    epoch = keyed(states, by=("epoch_id",))
    frame = [*epoch, "frame_idx"]
    order = Window.partitionBy(*epoch).orderBy("frame_idx")
    each = states.groupBy(*frame, "local_track_id").agg(F.max("hits").alias("hits"), F.max(F.coalesce("matched", F.lit(False))).alias("matched"))
    frames = each.select(*frame).distinct().withColumn("next", F.lead("frame_idx").over(order))
    due = top_by_hits(each, frame, "local_track_id", most).join(frames, frame).where("next is not null")
    due = due.select(*epoch, F.col("next").alias("frame_idx"), "local_track_id")
    missed = due.join(each.where("matched"), [*frame, "local_track_id"], "left_anti").select(*frame).distinct()
    marked = frames.drop("next").join(missed.withColumn("missed_top", F.lit(True)), frame, "left")
    marked = marked.withColumn("missed_top", F.coalesce("missed_top", F.lit(False)))
    # Each calm frame begins a run; in a run the budget grows with every miss.
    run = F.sum((~F.col("missed_top")).cast("int")).over(order)
    marked = marked.withColumn("__run", run)
    misses = F.sum(F.col("missed_top").cast("int")).over(Window.partitionBy(*epoch, "__run").orderBy("frame_idx"))
    marked = marked.withColumn("budget", (calm + step * misses).cast("long")).drop("__run")
    return marked.withColumn("used", F.coalesce(F.lag("budget").over(order), F.lit(start).cast("long")))


def lifetimes(rows: DataFrame, key: str = "global_track_id", frame: str = "frame_idx", gap: int = 10) -> DataFrame:
    """``key, life, first_frame, last_frame, n_frames``: more than ``gap`` frames without a sight end a life."""
    w = Window.partitionBy(key).orderBy(frame)
    seen = rows.where(F.col(key).isNotNull()).select(key, frame).distinct()
    starts = F.when(F.col(frame) - F.lag(frame).over(w) <= gap, 0).otherwise(1)
    lives = seen.withColumn("__starts", starts).withColumn("life", F.sum("__starts").over(w).cast("bigint"))
    return lives.groupBy(key, "life").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("n_frames"))


def attempts(rows: DataFrame, by: str, score: str, candidate: str, limit: float) -> DataFrame:
    """Per group: attempts, those above the limit, and the candidate of the least score."""
    best = F.min_by(candidate, F.struct(score, candidate)).alias("best")
    return rows.groupBy(by).agg(F.count("*").alias("attempts"), F.count_if(F.col(score) > limit).alias("rejected"), best)


def weighted_mean(rows: DataFrame, by: str, loss: str, weight: str, out: str = "loss") -> DataFrame:
    total = F.greatest(F.sum(F.col(weight).cast("double")), F.lit(1e-12))
    return rows.groupBy(by).agg((F.sum(F.col(loss) * F.col(weight)) / total).alias(out))


def cost_summary(costs: DataFrame, track: str = "track", detection: str = "detection", cost: str = "cost") -> DataFrame:
    """Of a cost matrix as rows: each track's best detection, its cost, the mean and how many there are."""
    best = F.min(F.struct(cost, detection)).alias("b")
    rows = costs.groupBy(track).agg(best, F.avg(cost).alias("mean_cost"), F.count("*").alias("n_pairs"))
    return rows.select(track, F.col(f"b.{detection}").alias("best_detection"), F.col(f"b.{cost}").alias("best_cost"), "mean_cost", "n_pairs")


def same_group(groups: DataFrame, member: int, column: str = "group") -> DataFrame:
    """All that stand in a group with ``member``, itself left out."""
    return groups.where(F.array_contains(column, member)).select(F.explode(column).alias("member")).where(F.col("member") != member).distinct()


def segment_lengths(rows: DataFrame, key: str = "global_track_id", frame: str = "frame_idx") -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(frame).alias("n_frames"), F.count("*").alias("n_rows"))
