"""Where tracks are: boxes and centres of track states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions import geometry as G
from trailmark.operators.detections import BOX, box_columns, box_of
from trailmark.schemas import keyed


def state_geometry(states: DataFrame, prepared: DataFrame, width: Column | int, height: Column | int, joints: int = 5, least: float = 0.05) -> DataFrame:
    """``states`` with the box and the centre of each track in each of its frames.

    The box is that of the matched detection within the image; without one (no
    match, or no box of an extent there), that around the last good keypoints of
    the track, this frame's included. Good are those of a matched detection with
    ``joints`` points of a confidence of ``least``, or, where states have a column
    ``pose_updated``, of those that it marks. A track's first frame, in which
    nothing is matched and nothing missed yet, takes the keypoints of the detection at its centre. The
    centre is the state's own, else the last matched detection's.

    One join by frame and detection, then one ordered pass over each track, which
    holds a row of it at a time. Tracks that never saw anything have nulls; so
    have rows before the first sight. Repeated detections are an error elsewhere
    (``export.build_observations``); here they repeat rows.
    """
    width, height = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    frame = keyed(states, prepared)
    track = [c for c in (*frame[:-1], "epoch_id", "local_track_id")]
    has_center = {"center_x", "center_y"} <= set(prepared.columns)
    box = box_of() if set(BOX) <= set(prepared.columns) else F.col("bbox") if "bbox" in prepared.columns else F.lit(None).cast("array<double>")
    points = F.col("keypoints").cast("array<array<double>>")
    conf = G.confidences(points, F.col("kp_conf").cast("array<double>"))
    sure = F.size(F.filter(conf, lambda c: F.coalesce(c >= least, F.lit(False))))
    given = F.when(F.coalesce(F.forall(box, G.finite), F.lit(False)), G.clip_to_image(box, width, height))
    seen = prepared.select(
        *frame, F.col("det_id").cast("bigint").alias("det_id"), given.alias("__box"), G.keypoint_box(points, conf, least, width, height).alias("__points_box"),
        F.coalesce(sure >= joints, F.lit(False)).alias("__enough"), *((F.col(c).cast("double") if has_center else F.lit(None).cast("double")).alias(f"__{c}") for c in ("center_x", "center_y")),
    )
    rows = states.drop(*BOX)
    own = {c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double") for c in ("center_x", "center_y")}
    matched = F.coalesce(F.col("det_id") >= 0, F.lit(False))
    joined = rows.withColumns(own).join(seen, [*frame, "det_id"], "left")
    good = F.coalesce(F.col("pose_updated"), F.lit(False)) & matched if "pose_updated" in rows.columns else matched & F.coalesce("__enough", F.lit(False))
    # A struct, so that good keypoints without an extent hide the ones before.
    joined = joined.withColumn("__good", F.when(good, F.struct(F.col("__points_box").alias("b"))))
    if has_center and {"center_x", "center_y", "time_since_update"} <= set(states.columns):
        born = rows.where(~matched & (F.col("time_since_update") == 0) & F.col("center_x").isNotNull()).select(*frame, "epoch_id", "local_track_id", F.col("center_x").cast("double").alias("__center_x"), F.col("center_y").cast("double").alias("__center_y"))
        born = born.join(seen, [*frame, "__center_x", "__center_y"]).groupBy(*frame, "epoch_id", "local_track_id").agg(F.min_by(F.struct(F.col("__points_box").alias("b")), "det_id").alias("__born"))
        joined = joined.join(born, [*frame, "epoch_id", "local_track_id"], "left").withColumn("__good", F.coalesce("__good", "__born")).drop("__born")
    before = Window.partitionBy(*track).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.col("__good"), ignorenulls=True).over(before)
    center = F.last(F.when(matched & F.col("__center_x").isNotNull(), F.struct("__center_x", "__center_y")), ignorenulls=True).over(before)
    out = joined.withColumns({"__kept": kept, "__center": center})
    whole = F.coalesce(F.when(matched, F.col("__box")), F.col("__kept.b"))
    out = out.withColumn("__whole", whole.cast("array<double>"))
    out = out.withColumns({c: F.coalesce(c, F.col(f"__center.__{c}")) for c in ("center_x", "center_y")})
    names = [c for c in out.columns if not c.startswith("__")]
    return out.select(*names, *box_columns(F.col("__whole")))
