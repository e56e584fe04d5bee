import numpy as np
import pytest
from pyspark.sql import functions as F
from tests import brute_skeleton

from trailmark.functions import geometry as G
from trailmark.operators import identity, overlap, prepare


def body(x, y):
    """A standing figure: 25 joints around a torso."""
    rng = np.random.default_rng(1)
    points = np.stack([x + rng.random(25) * 30, y + np.linspace(0, 80, 25)], axis=1)
    return points.tolist()


def test_from_people_to_prepared_detections(spark):
    places = {"a": [(50, 40), (55, 42), (400, 60), (60, 300), (410, 300)], "b": [(50, 40)]}
    rows = [(v, 1, k, body(*p), [0.9] * 25) for v, some in places.items() for k, p in enumerate(some)] + [("b", 1, 1, None, None)]
    found = spark.createDataFrame(rows, "video string, frame_idx long, det_id long, keypoints array<array<double>>, kp_conf array<double>")
    kept = prepare.people(found, 640, 480, top=3, extras=1)
    assert {(r["video"], r["det_id"]) for r in kept.collect()} == {("a", 0), ("a", 1), ("a", 2), ("a", 4), ("b", 0), ("b", 1)}  # of 3 and 4 the nearer to one of the first
    crops = kept.withColumns({"body_features": F.when(F.col("det_id") < 2, F.array(F.lit(3.0), F.lit(4.0))), "shorts_features": F.array(F.lit(0.0), F.lit(2.0))})
    got = {(r["video"], r["det_id"]): r for r in prepare.assemble(crops, 2, 2, diagonal=800.0).collect()}
    assert len(got) == 6
    one, two = (brute_skeleton.person(body(*p), [0.9] * 25, got["a", k]["bbox"]) for k, p in enumerate(places["a"][:2]))
    want = brute_skeleton.skeleton_overlap(one, two)[0]
    first = got["a", 0]
    assert [(r["det_idx"], r["iou"]) for r in first["overlap_relations"]] == [(1, pytest.approx(want))]
    assert (first["max_overlap_iou"], first["max_overlap_det_idx"], first["is_overlapping"]) == (pytest.approx(want), 1, True)
    assert first["center_dist_overlap_risk"] and not got["a", 2]["center_dist_overlap_risk"]
    assert got["a", 2]["overlap_relations"] == [] and not got["a", 2]["is_overlapping"] and got["b", 0]["overlap_relations"] == []
    total = 1 + 0.5 + 0.5 + 0.75
    vector = np.array([0.6, 0.8, 0, 0, 0, 0, 0, 0.75])
    assert first["e_app"] == pytest.approx((vector / np.linalg.norm(vector)).tolist()) and first["e_app_coverage"] == pytest.approx(1.75 / total)
    assert first["e_app_valid_mask"] == [True, True, False, False, False, False, True, True]
    assert got["a", 2]["e_app"] is None and got["a", 2]["e_app_valid_mask"] is None and got["a", 2]["e_app_coverage"] == 0
    assert first["bbox"] == [float(int(v)) for v in (*np.min(body(50, 40), axis=0), *np.max(body(50, 40), axis=0))]
    assert got["b", 1]["bbox"] is None and got["b", 1]["center_x"] is None
    assert prepare.assemble(crops.limit(0), 2, 2).count() == 0


def test_all_reasons_of_overlaps(spark):
    holders = spark.createDataFrame([(1, 1, 10, True), (1, 2, 20, True), (1, 3, 30, False), (1, 5, 50, None), (2, 1, 10, True)], "frame_idx long, det_id long, local_track_id long, stable boolean")
    rows = [(1, 1, 2, 0.0035, 0.5), (1, 1, 3, 0.0035, 0.5), (1, 1, 4, 0.9, 0.5), (1, 2, 1, 0.0075, 1.3), (1, 3, 1, 0.0079, 0.1), (1, 4, 1, 0.9, 0.5)]
    relations = spark.createDataFrame(rows, "frame_idx long, det_id long, other_id long, iou double, center_dist_norm double")
    judged = {(r["det_id"], r["other_id"]): (r["threshold"], r["zone"], r["reason"], r["risky"]) for r in overlap.judge_relations(relations, holders).collect()}
    other = "other_track_pending_or_unmatched_default_only"
    assert judged == {
        (1, 2): (0.003, "near", "stable_pair_adaptive", True), (1, 3): (0.008, "default", other, False), (1, 4): (0.008, "default", other, True),
        (2, 1): (0.008, "default", "stable_pair_default_far", False), (3, 1): (0.008, "default", "current_track_pending_default_only", False),
    }
    got = {(r["frame_idx"], r["det_id"]): r for r in overlap.evaluate(relations, holders).collect()}
    assert (got[1, 1]["reason"], got[1, 1]["risky"], got[1, 1]["max_risky_iou"], got[1, 1]["overlap_has_stable_track"], got[1, 1]["adaptive"]) == (other, [4, 2], 0.9, True, False)
    assert (got[1, 2]["has_overlap"], got[1, 2]["adaptive"], got[1, 2]["risky"]) == (False, True, [])
    assert got[1, 5]["reason"] == got[2, 1]["reason"] == "no_overlap_relations_default_only" and len(got) == 5


def test_lists(spark):
    df = spark.createDataFrame([([1.0, 0.0, None, float("nan")], [[1.0, 2.0, 0.5], [3.0, 4.0, 0.1]]), (None, [[1.0]]), ([], None)], "b array<double>, p array<array<double>>")
    assert [tuple(r) for r in df.select(G.bool_list(F.col("b")), G.pair_list(F.col("p"))).collect()] == [([True, False, False, True], [[1.0, 2.0], [3.0, 4.0]]), (None, None), ([], None)]


def test_only_confirmed_fragments_get_vectors(spark):
    history = spark.createDataFrame([(1, t, [1.0, float(t)]) for t in (1, 2) for _ in range(6)], "epoch_id long, local_track_id long, v array<double>")
    states = spark.createDataFrame([(1, 1, False), (1, 1, True), (1, 2, False), (1, 2, None)], "epoch_id long, local_track_id long, confirmed boolean")
    assert [r["local_track_id"] for r in identity.eligible_vectors(history, states, "v").collect()] == [1]
    assert identity.eligible_vectors(history, states, "v", confirmed_only=False).count() == 2
