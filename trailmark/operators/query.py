"""A lazy, read-only query API over an observations table."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.vectors import visible_points
from trailmark.operators.segments import AmbiguousObservationError, Observation, Segment, SegmentCollection, as_id
from trailmark.schemas import META, OBSERVATIONS
from trailmark.sources.results import scan


def as_list(value) -> list | None:
    """None stays None; list, tuple, set and array are read through; all else is one
    value. Numbers and texts of numbers become whole numbers."""
    if value is None:
        return None
    return [as_id(v) for v in value] if isinstance(value, list | tuple | set | frozenset | np.ndarray) else [as_id(value)]


class View:
    """A filtered table. Every method gives a new view; nothing runs before rows are asked for."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> View:
        return cls(scan(spark, path))

    def _where(self, condition) -> View:
        return View(self.df.where(condition))

    def global_id(self, value) -> View:
        return self._where(F.col("global_track_id") == as_id(value))

    def global_ids(self, values) -> View:
        return self._where(F.col("global_track_id").isin(as_list(values)))

    def epoch(self, value) -> View:
        return self._where(F.col("epoch_id") == value)

    def epochs(self, values) -> View:
        return self._where(F.col("epoch_id").isin(as_list(values)))

    def local_track(self, local_id: int, epoch_id: int) -> View:
        """Local ids are unique within an epoch only, so both are needed."""
        return self._where((F.col("local_track_id") == local_id) & (F.col("epoch_id") == epoch_id))

    def at_frame(self, frame: int) -> View:
        return self._where(F.col("frame_idx") == frame)

    def matched_only(self) -> View:
        return self._where(F.coalesce("is_matched", F.lit(False)))

    def confirmed_only(self) -> View:
        return self._where(F.coalesce("confirmed", F.lit(False)))

    def with_keypoints(self) -> View:
        return self._where(F.col("keypoints").isNotNull())

    def unassigned(self) -> View:
        return self._where(F.col("global_track_id").isNull())

    def select(self, *, global_ids=None, epochs=None, local_tracks=None, frames: tuple[int, int] | None = None, matched: bool | None = None, confirmed: bool | None = None) -> View:
        """All given filters at once; scalars and lists are both accepted."""
        out = self
        for column, values in (("global_track_id", global_ids), ("epoch_id", epochs), ("local_track_id", local_tracks)):
            if values is not None:
                out = out._where(F.col(column).isin(as_list(values)))
        if frames is not None:
            out = out.between(*frames)
        for column, value in (("is_matched", matched), ("confirmed", confirmed)):
            if value is not None:
                out = out._where(F.col(column) == value)
        return out

    def between(self, first: int, last: int) -> View:
        """Frames ``first`` to ``last``, both included."""
        if last < first:
            raise ValueError("the last frame is before the first")
        return self._where(F.col("frame_idx").between(first, last))

    def focus_ids(self, most: int = 2) -> list[int]:
        """Up to ``most`` distinct identities of the view."""
        rows = self.df.where("global_track_id is not null").select("global_track_id").distinct().limit(most).collect()
        return sorted(r[0] for r in rows)

    def frames(self, first: int, last: int) -> View:
        """As ``between``; a view of one identity drops rows without one."""
        out = self.between(first, last)
        return out._where("global_track_id is not null") if len(self.focus_ids()) == 1 else out

    def frame(self, frame: int):
        """The one row of a frame, or an error that says why there is none."""
        at = self.at_frame(frame).df
        rows = at.limit(2).collect()
        if not rows:
            raise LookupError(f"no observation at frame {frame}")
        if len(rows) > 1:
            if at.where(~F.col("global_track_id").eqNullSafe(F.lit(rows[0]["global_track_id"]))).isEmpty():
                raise AmbiguousObservationError(rows[0]["global_track_id"], frame, at.limit(1000).toPandas())
            raise ValueError(f"several identities at frame {frame}; filter by one first")
        return rows[0]

    def observation(self, frame: int) -> Observation:
        """The frame's row as an object."""
        row = self.frame(frame)
        return Observation(int(frame), as_id(row["global_track_id"]), row.asDict())

    def window(self, start: int, length: int) -> DataFrame:
        """Exactly ``length`` rows for each identity, padded where it was not seen:
        ``frame_mask`` says whether there is an observation, ``detection_mask``
        whether it is matched and has keypoints."""
        if length <= 0:
            raise ValueError("the length must be positive")
        if not self.focus_ids(1):
            raise ValueError("a window needs an identity; filter by one or several")
        inside = View(self.df.where(F.col("frame_idx").between(start, start + length - 1)))
        twice = inside.ambiguous().first()
        if twice:
            gid, frame = twice["global_track_id"], twice["frame_idx"]
            raise AmbiguousObservationError(gid, frame, inside.global_id(gid).at_frame(frame).df.limit(1000).toPandas())
        return windows(self.df, [start], length).drop("window_start")

    def segment(self, start: int | None = None, length: int | None = None, most: int = 100) -> Segment | SegmentCollection:
        """The view's identity, or its identities (at most ``most``), as objects on
        the driver: over the frames that were seen, or padded to a window."""
        if length is not None and length <= 0:
            raise ValueError("the length must be positive")
        ids = self.focus_ids(most + 1)
        if not ids:
            raise ValueError("a segment needs an identity; filter by one or several")
        if len(ids) > most:
            raise ValueError(f"more than {most} identities; filter first")
        axis = None if length is None else range(int(start or 0), int(start or 0) + length)
        rows = self.df.where("global_track_id is not null")
        rows = (rows if axis is None else rows.where(F.col("frame_idx").between(axis[0], axis[-1]))).toPandas()
        found = {i: Segment(i, rows[rows["global_track_id"] == i], axis) for i in ids}
        return found[ids[0]] if len(ids) == 1 else SegmentCollection(found)

    def sliding_windows(self, first: int, last: int, stride: int, length: int) -> DataFrame:
        return windows(self.df, range(first, last - length + 2, stride), length)

    def local_tracks(self) -> DataFrame:
        """One row a fragment: its frames, its observations and how many are matched."""
        return (
            self.df.where("global_track_id is not null")
            .groupBy("global_track_id", "epoch_id", "local_track_id")
            .agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n_observations"), F.count_if("is_matched").alias("n_matched"))
        )

    def segments(self, most: int = 10_000) -> dict[int, View]:
        """A view of each identity; more than ``most`` are an error."""
        ids = self.available("global_track_id").limit(most + 1).collect()
        if len(ids) > most:
            raise ValueError(f"more than {most} identities; filter first")
        return {r[0]: self.global_id(r[0]) for r in ids}

    def available(self, column: str) -> DataFrame:
        return self.df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)

    def sample_per_global(self, n: int, seed: int = 0, matched: bool = False) -> DataFrame:
        """At most ``n`` rows of each identity, without replacement, alike in reruns."""
        rows = (self.matched_only() if matched else self).df.where("global_track_id is not null")
        # md5 of the row's place: a hash that other engines have too.
        key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("global_track_id", "epoch_id", "local_track_id", "frame_idx")))
        order = Window.partitionBy("global_track_id").orderBy(F.md5(key), "epoch_id", "local_track_id", "frame_idx")
        return rows.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= n).drop("__place").orderBy("global_track_id")

    def ambiguous_rows(self) -> DataFrame:
        """The rows of identities with several in a frame."""
        return self.df.join(self.ambiguous().select("global_track_id", "frame_idx"), ["global_track_id", "frame_idx"], "left_semi")

    def ambiguous(self) -> DataFrame:
        """Identities with several rows in a frame."""
        return self.df.where("global_track_id is not null").groupBy("global_track_id", "frame_idx").agg(F.count("*").alias("n_rows")).where("n_rows > 1")

    def meta(self) -> DataFrame:
        """The tracking columns (null where the table lacks one) and how many points are visible."""
        columns = [F.col(c) if c in self.df.columns else F.lit(None).cast(OBSERVATIONS[c].dataType).alias(c) for c in META]
        seen = F.coalesce(visible_points(F.col("kp_conf")), F.lit(0)) if "kp_conf" in self.df.columns else F.lit(0)
        return self.df.select(*columns, seen.alias("n_visible_keypoints"))

    def states(self) -> DataFrame:
        """The rows with ``has_keypoints`` and ``has_detection`` (matched, with keypoints)."""
        points = F.col("keypoints").isNotNull()
        return self.df.withColumns({"has_keypoints": points, "has_detection": F.coalesce(F.col("is_matched") & points, F.lit(False))})

    def to_pandas(self):
        return self.df.toPandas()

    def __len__(self) -> int:
        return self.df.count()


def windows(df: DataFrame, starts: Iterable[int], length: int) -> DataFrame:
    """For each identity and start a dense axis of ``length`` frames, left-joined to the observations."""
    starts = list(starts)
    ids = df.where("global_track_id is not null").select("global_track_id").distinct()
    if not starts:
        return df.limit(0).withColumns({"window_start": F.lit(0).cast("bigint"), "frame_mask": F.lit(False)})
    axis = ids.withColumn("window_start", F.explode(F.array(*(F.lit(s).cast("bigint") for s in starts)))).withColumn("frame_idx", F.explode(F.sequence(F.col("window_start"), F.col("window_start") + length - 1)))
    seen = df.where(F.col("frame_idx").between(min(starts), max(starts) + length - 1)).withColumn("__seen", F.lit(True))
    out = axis.join(seen, ["global_track_id", "frame_idx"], "left").withColumn("frame_mask", F.col("__seen").isNotNull()).drop("__seen")
    if {"is_matched", "keypoints"} <= set(df.columns):
        out = out.withColumn("detection_mask", F.coalesce(F.col("is_matched") & F.col("keypoints").isNotNull(), F.lit(False)))
    return out


def window_counts(df: DataFrame, first: int, last: int, stride: int, length: int) -> DataFrame:
    """``global_track_id, window_start, n_seen, n_frames`` of ``windows`` that start at
    ``first`` and every ``stride`` through ``last``, without a row for each frame of
    a window: an observation counts in the windows that hold it."""
    starts = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"), F.lit(stride).cast("bigint"))
    rows = df.where("global_track_id is not null").select("global_track_id", "frame_idx")
    every = rows.select("global_track_id").distinct().select("global_track_id", F.explode(starts).alias("window_start"), F.lit(0).cast("bigint").alias("n"))
    # The numbers of the first and the last window that hold a frame.
    low = F.greatest(F.lit(0), F.ceil((F.col("frame_idx") - first - length + 1) / stride)).cast("bigint")
    high = F.least(F.lit((last - first) // stride), F.floor((F.col("frame_idx") - first) / stride)).cast("bigint")
    held = rows.select("global_track_id", low.alias("low"), high.alias("high")).where("low <= high")
    held = held.select("global_track_id", F.explode(F.sequence("low", "high")).alias("k"))
    held = held.select("global_track_id", (F.col("k") * stride + first).cast("bigint").alias("window_start"), F.lit(1).cast("bigint").alias("n"))
    return every.unionByName(held).groupBy("global_track_id", "window_start").agg(F.sum("n").alias("n_seen")).withColumn("n_frames", F.lit(length).cast("bigint"))
