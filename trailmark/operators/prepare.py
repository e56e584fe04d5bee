"""From the people found in a frame to detections that the tracker takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import geometry as G
from trailmark.functions import vectors as V
from trailmark.operators import detections as D
from trailmark.operators import export, skeleton
from trailmark.schemas import keyed

#: Shipped values: weights of the parts of an appearance vector.
WEIGHTS = {"body": 1.0, "left_glove": 0.5, "right_glove": 0.5, "shorts": 0.75}
PARTS = ("left_glove", "right_glove", "shorts")


def people(found: DataFrame, width: Column | int, height: Column | int, top: int = 3, extras: int = 9, least: float = 0.05) -> DataFrame:
    """The people of each frame that are kept (the first ``top`` and the nearest
    ``extras``), with centre, box and the boxes of gloves and shorts to crop.

    ``found``: ``frame_idx, det_id, keypoints, kp_conf`` (and ``video``). What cannot
    be placed is null.
    """
    width, height = (F.lit(x) if isinstance(x, int) else x for x in (width, height))
    points, conf = F.col("keypoints"), F.col("kp_conf")
    posed = found.withColumn("__c", G.torso_center(G.posed(points, conf, least)))
    placed = D.top_with_nearest(posed.withColumns({"center_x": F.col("__c")[0], "center_y": F.col("__c")[1]}).drop("__c"), top, extras)
    box = G.keypoint_box(points, conf, least, width, height).cast("array<double>")
    return placed.withColumns({
        "bbox": box, "bbox_for_intersection": box,
        "left_glove_box": G.glove_box(points, conf, G.L_ELBOW, G.L_WRIST, width, height, least), "right_glove_box": G.glove_box(points, conf, G.R_ELBOW, G.R_WRIST, width, height, least),
        "shorts_box": G.shorts_box(points, conf, width, height, least),
    })


def assemble(kept: DataFrame, body_width: int, part_width: int = 32, threshold: float = 0.0, diagonal: float = 1.0, thickness: int = 7, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Prepared detections: ``people`` with what their crops gave (``body_features``,
    ``left_glove_features``, ``right_glove_features``, ``shorts_features``; a column
    that is not there counts as missing), their overlaps and one appearance vector.

    Adds ``overlap_relations`` (skeletons that overlap by more than ``threshold``),
    ``max_overlap_iou, max_overlap_det_idx, min_center_dist_norm,
    center_dist_norm_det_idx, is_overlapping``, the centre-distance risk, ``e_app``
    with its valid mask and coverage. Without a body vector there is no ``e_app``.
    """
    keys = keyed(kept, by=("frame_idx", "det_id"))
    pairs = skeleton.skeleton_pairs(kept, thickness)
    close = pairs.where(F.col("iou") > threshold)
    out = D.attach(kept, export.overlap_extrema(pairs)).join(export.relations(close, kept), keys, "left")
    out = out.join(D.center_risk(kept, diagonal), keys, "left")
    have = set(kept.columns)
    given = {n: F.col(f"{n}_features").cast("array<double>") if f"{n}_features" in have else F.lit(None).cast("array<double>") for n in ("body", *PARTS)}
    parts = [(given["body"], weights["body"], body_width), *((given[n], weights[n], part_width) for n in PARTS)]
    vector, coverage = V.fuse(parts)
    return out.withColumns({"e_app": vector, "e_app_valid_mask": V.fuse_mask(parts), "e_app_coverage": coverage})
