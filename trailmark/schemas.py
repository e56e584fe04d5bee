"""Tables of the engine as explicit Spark types, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

_KINDS = {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType(), "array<double>": ArrayType(DoubleType()), "array<array<double>>": ArrayType(ArrayType(DoubleType()))}


def _table(columns: str) -> StructType:
    """From a list of names and types; unlike DDL parsing it needs no running session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


_BOX = "bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"

FRAMES = _table("video string, frame_idx bigint, frame_path string, g double, reset_mode boolean, has_detections boolean")
RAW_DETECTIONS = _table(f"video string, frame_idx bigint, frame_path string, det_id bigint, keypoints array<array<double>>, kp_conf array<double>, confidence double, {_BOX}, crop_shard_id bigint, crop_index bigint")
LOCAL_TRACKS = _table("video string, frame_idx bigint, epoch_id bigint, local_track_id bigint, det_id bigint")
TRACK_STATES = _table(f"video string, frame_idx bigint, epoch_id bigint, local_track_id bigint, det_id bigint, is_matched boolean, confirmed boolean, hits bigint, age bigint, time_since_update bigint, {_BOX}, center_x double, center_y double")
LOCAL_TO_GLOBAL = _table("video string, epoch_id bigint, local_track_id bigint, global_track_id bigint")
OBSERVATIONS = _table(
    "video string, frame_idx bigint, epoch_id bigint, local_track_id bigint, global_track_id bigint, det_id bigint, is_matched boolean, confirmed boolean, hits bigint, age bigint, time_since_update bigint, "
    f"{_BOX}, center_x double, center_y double, keypoints array<array<double>>, kp_conf array<double>, is_overlapping boolean, max_overlap_iou double, min_center_dist_norm double, center_dist_norm_det_idx bigint, "
    "has_body_features boolean, has_left_glove_features boolean, has_right_glove_features boolean, has_shorts_features boolean, has_e_app boolean, e_app_coverage double"
)
#: Tracking columns of an observation, without geometry and payload.
META = ("frame_idx", "epoch_id", "local_track_id", "global_track_id", "det_id", "is_matched", "confirmed", "hits", "age", "time_since_update", "is_overlapping", "max_overlap_iou", "min_center_dist_norm", "center_dist_norm_det_idx", "has_body_features", "has_left_glove_features", "has_right_glove_features", "has_shorts_features", "has_e_app", "e_app_coverage")
#: What the query API needs at least.
REQUIRED = ("frame_idx", "epoch_id", "local_track_id", "global_track_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "keypoints", "kp_conf", "is_matched", "confirmed")


def validate(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``df`` itself, or a ValueError that names the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def keyed(*tables: DataFrame, by: tuple[str, ...] = ("frame_idx",)) -> list[str]:
    """What rows of the tables are told apart by: ``by``, within their video where
    the tables have one. A table that lacks it beside others that do not is an
    error: its frames would meet those of every video."""
    have = ["video" in t.columns for t in tables]
    if any(have) and not all(have):
        raise ValueError("only some of the tables have a video")
    return ["video", *by] if all(have) else [*by]
