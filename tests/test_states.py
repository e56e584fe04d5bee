import numpy as np
import pytest

from trailmark.operators import export, states
from trailmark.operators.identity import build_mapping
from trailmark.operators.query import View
from trailmark.operators.tracking import track

POINTS = [[10.0 + 2 * k, 20.0 + 3 * k] for k in range(25)]


def moved(dx, n=25):
    return [[x + dx, y] for x, y in POINTS[:n]]


def test_boxes_follow_matches_and_then_good_keypoints(spark):
    rows = [(1, 0), (2, 1), (3, -1), (4, 2), (5, -1), (6, 3), (7, 4)]
    tracked = spark.createDataFrame([(f, 1, 7, d) for f, d in rows], "frame_idx long, epoch_id long, local_track_id long, det_id long")
    prepared = spark.createDataFrame(
        [
            (1, 0, [-5.0, 2.9, 40.0, 60.0], moved(0), [0.9] * 25, 5.0, 6.0),  # clipped
            (2, 1, None, moved(1), [0.9] * 25, 7.0, 8.0),  # no box: its own keypoints
            (4, 2, [50.0, 0.0, 50.0, 5.0], moved(30), [0.9] * 4 + [0.0] * 21, 9.0, 10.0),  # no extent, too few points
            (6, 3, None, [[5.0, 5.0]] * 25, [0.9] * 25, None, None),  # good, without extent
            (7, 4, None, None, None, 11.0, 12.0),
        ],
        "frame_idx long, det_id long, bbox array<double>, keypoints array<array<double>>, kp_conf array<double>, center_x double, center_y double",
    )
    got = {r["frame_idx"]: r for r in states.state_geometry(tracked, prepared, 100, 100).collect()}
    box = lambda f: [got[f][c] for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")]
    around = [11.0, 20.0, 59.0, 92.0]
    assert box(1) == [0.0, 2.0, 40.0, 60.0]
    assert box(2) == box(3) == box(4) == box(5) == around
    assert box(6) == box(7) == [None] * 4
    assert [got[f]["center_x"] for f in (1, 2, 3, 4, 5, 6, 7)] == [5.0, 7.0, 7.0, 9.0, 9.0, 9.0, 11.0]
    marked = tracked.selectExpr("*", "frame_idx = 1 AS pose_updated")
    got = {r["frame_idx"]: r for r in states.state_geometry(marked, prepared, 100, 100).collect()}
    assert box(3) == [10.0, 20.0, 58.0, 92.0]
    assert states.state_geometry(tracked.limit(0), prepared, 100, 100).count() == 0


def test_from_detections_to_boxes_in_two_videos(spark):
    """Both videos have the same frames, detections and epochs."""
    rows = []
    for video, x in (("a", 50.0), ("b", 300.0)):
        for frame in range(1, 13):
            if frame != 8:
                for det, y in ((0, 40.0), (1, 200.0)):
                    points = [[x + k % 5, y + k] for k in range(25)]
                    rows.append((video, 1 + frame // 7, frame, det, x + 2.0, y + 12.0, [x, y, x + 4.0, y + 24.0], points, [0.9] * 25, [1.0, 0.0] if det else [0.0, 1.0]))
            else:
                rows.append((video, 1 + frame // 7, frame, None, None, None, None, None, None, None))
    seen = spark.createDataFrame(rows, "video string, epoch_id long, frame_idx long, det_id long, center_x double, center_y double, bbox array<double>, keypoints array<array<double>>, kp_conf array<double>, e_app array<double>")
    prepared = seen.where("det_id is not null").drop("epoch_id")
    tracked = states.state_geometry(track(seen), prepared, 640, 480)
    nodes = spark.createDataFrame([(v, e, t, [1.0, 0.1 * e] if t == 1 else [0.1 * e, 1.0]) for v in "ab" for e in (1, 2) for t in (1, 2)], "video string, epoch_id long, local_track_id long, mean array<double>")
    mapping, rest = build_mapping(nodes, least=2)
    assert rest.count() == 0 and mapping.count() == 8
    rows = export.build_observations(tracked, prepared, mapping).collect()
    assert {r["video"] for r in rows} == {"a", "b"} and all(r["global_track_id"] in (1, 2) for r in rows)
    for r in rows:
        x = 50.0 if r["video"] == "a" else 300.0
        assert (r["bbox_x1"], r["bbox_x2"]) == (x, x + 4.0), r  # births, matches and the frame without detections
        assert r["bbox_y1"] in (40.0, 200.0) and r["center_x"] == x + 2.0
    view = View(spark.createDataFrame([r for r in rows if r["video"] == "b"], export.build_observations(tracked, prepared, mapping).schema))
    boxes = view.global_id(1).segment(start=2, length=10).bbox
    assert np.asarray(boxes)[:, 0] == pytest.approx(300.0)


def test_overlaps_by_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for video in "ab":
        for frame in range(4):
            for det in range(40):
                x, y = rng.random(2) * 300
                w, h = rng.random(2) * (200 if det == 0 else 40)
                rows.append((video, frame, det, float(x), float(y), float(x + w), float(y + h)))
    rows += [("a", 9, 1, 0.0, 0.0, 10.0, 10.0), ("a", 9, 2, 0.0, 0.0, 10.0, 10.0), ("a", 9, 3, 10.0, 0.0, 20.0, 10.0), ("a", 9, 4, 5.0, 5.0, 5.0, 9.0), ("a", 9, 5, None, 0.0, 1.0, 1.0), ("a", 9, 6, float("nan"), 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "video string, frame_idx long, det_id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    key = lambda r: (r["video"], r["frame_idx"], r["det_id"], r["other_id"])
    got = {key(r): (r["iou"], r["center_dist_norm"]) for r in export.meeting_pairs(df).collect()}
    want = {key(r): (r["iou"], r["center_dist_norm"]) for r in export.overlaps(df.where("bbox_x1 = bbox_x1 AND NOT isnan(bbox_x1)")).where("iou > 0").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert ("a", 9, 1, 2) in got and not any(4 <= k[2] <= 6 for k in got if k[:2] == ("a", 9))
    listed = {(r["video"], r["frame_idx"], r["det_id"]): r["overlap_relations"] for r in export.relations(export.meeting_pairs(df), df).collect()}
    assert len(listed) == len(rows) and listed["a", 9, 4] == []
    assert all([x["iou"] for x in v] == sorted((x["iou"] for x in v), reverse=True) for v in listed.values())
    assert {(*k, x["det_idx"]) for k, v in listed.items() for x in v} == set(want)
