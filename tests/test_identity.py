import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute_skeleton
from trailmark.operators import export, identity, matches, skeleton
from trailmark.operators.cliques import merge_cliques
from trailmark.operators.tracking import track, track_log


def brute_cliques(edges):
    known, groups = {(i, j) for i, j, _ in edges}, {n: {n} for e in edges for n in e[:2]}
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = groups[i], groups[j]
        if a is not b and all((min(x, y), max(x, y)) in known for x in a for y in b):
            merged = a | b
            for n in merged:
                groups[n] = merged
    return {n: min(g) for n, g in groups.items()}


def some_edges(seed, n=40, share=0.25):
    rng = random.Random(seed)
    return [(i, j, round(rng.random(), 1)) for i in range(n) for j in range(i + 1, n) if rng.random() < share]


def test_identities_are_numbered_by_size_and_strength(spark):
    edges = some_edges(7) + [(100, 101, 0.9), (100, 102, 0.8), (101, 102, 0.7), (200, 201, 0.99)]
    df = spark.createDataFrame(edges, "i long, j long, sim double")
    got = {r["node"]: r["global_track_id"] for r in identity.identities(merge_cliques(df)[0], df).collect()}
    first = brute_cliques(edges)
    groups = {}
    for n, f in first.items():
        groups.setdefault(f, []).append(n)
    strength = {f: np.mean([s for i, j, s in edges if first[i] == first[j] == f]) for f in groups}
    ranked = sorted((f for f, g in groups.items() if len(g) >= 3), key=lambda f: (-len(groups[f]), -round(strength[f], 9), f))
    assert got == {n: k + 1 for k, f in enumerate(ranked) for n in groups[f]} and 200 not in got


def test_numbered_over_many_ranges(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(7))).repartition(8)
    got = [r["place"] for r in identity.numbered(df, [F.desc("v"), F.asc("id")], "place").orderBy(F.desc("v"), "id").collect()]
    assert got == list(range(1, 1001))
    assert identity.numbered(df.limit(0), [F.asc("id")], "place").count() == 0


def test_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 4, rng.normal(size=6 if i % 9 else 4).tolist(), f"g{i % 3}") for i in range(90)] + [(90, 0, [0.0] * 6, "g0"), (91, 0, None, "g1")]
    df = spark.createDataFrame(rows, "node long, epoch_id long, mean array<double>, grp string")

    def sim(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
        return float(np.dot(a, b) / n) if n > 1e-8 else 0.0

    pairs = {(a[0], b[0]): sim(a[2], b[2]) for a in rows for b in rows if a[0] < b[0] and a[2] is not None and b[2] is not None}
    for block in (7, 2048):
        got = {(r["i"], r["j"]): r["sim"] for r in identity.candidate_edges(df, 0.2, block=block).collect()}
        assert got == pytest.approx({k: s for k, s in pairs.items() if s >= 0.2})
        apart = {(r["i"], r["j"]) for r in identity.candidate_edges(df, 0.2, same_epoch=False, block=block).collect()}
        assert apart == {(i, j) for (i, j), s in pairs.items() if s >= 0.2 and (i % 4 if i < 90 else 0) != (j % 4 if j < 90 else 0)}
        grouped = {(r["i"], r["j"]) for r in identity.candidate_edges(df, -2.0, block=block, group_col="grp").collect()}
        assert grouped == {(i, j) for i, j in pairs if rows[i][3] == rows[j][3]}
        counts = {r["reason"]: r["n"] for r in identity.rejection_counts(df, 0.2, block=block).collect()}
        assert sum(counts.values()) == len(pairs) and counts["below_threshold"] == sum(s < 0.2 for s in pairs.values())


def test_mean_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=3).tolist()) for k in ("a", "b") for _ in range(40)] + [("c", [1.0, 0.0])] * 5 + [("c", [1.0])] + [("d", [1.0])] * 4 + [("e", None)] * 9 + [("f", [0.0, 0.0])] * 6
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(5)
    got = {r["k"]: (r["n"], r["mean"]) for r in identity.mean_vectors(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b"}  # unlike lengths, too few, none, no direction
    for k in got:
        m = np.mean([v for x, v in rows if x == k], axis=0)
        assert got[k][0] == 40 and got[k][1] == pytest.approx(m / np.linalg.norm(m))


def test_public_entry(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(6)
    rows = [(e, t, (centres[t % 3] + rng.normal(size=6) * 0.05).tolist()) for e in range(1, 5) for t in (1, 2, 3)] + [(9, 1, centres[5].tolist())]
    nodes = spark.createDataFrame(rows, "epoch_id long, local_track_id long, mean array<double>")
    mapping, rest = identity.build_mapping(nodes)
    found = {(r["epoch_id"], r["local_track_id"]): r["global_track_id"] for r in mapping.collect()}
    assert len(found) == 12 and all(len({found[e, t] for e in range(1, 5)}) == 1 for t in (1, 2, 3)) and set(found.values()) == {1, 2, 3}
    assert [tuple(r) for r in rest.collect()] == [(9, 1, "alone")]
    mapping, rest = identity.build_mapping(nodes.limit(0))
    assert mapping.count() == rest.count() == 0


# ------------------------------------------------------------------ overlap in a frame


def test_extrema_against_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for f in range(30):
        for i in range(int(rng.integers(0, 9))):
            x, y, w, h = rng.integers(0, 30, 4)
            rows.append((f, i, float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, "frame_idx long, det_id long, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    want = {(r["frame_idx"], r["det_id"]): tuple(r)[2:4] for r in export.overlap_extrema(export.overlaps(df)).collect()}
    for block in (3, 256):
        got = {(r["frame_idx"], r["det_id"]): tuple(r)[2:4] for r in skeleton.frame_extrema(df, block=block).collect()}
        assert set(got) == set(want) and all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)
    assert skeleton.frame_extrema(df.limit(0)).count() == 0


def test_capsule_mask_pixel_by_pixel():
    points, sure = np.array([[5.0, 9.0], [22.0, 14.0], [40.0, 3.0]]), [True, True, False]
    mask = brute_skeleton.capsules(points, sure, (24, 30), (0.0, 0.0), bones=((0, 1), (1, 2)))
    for y in range(24):
        for x in range(30):
            t = min(1, max(0, ((x - 5) * 17 + (y - 9) * 5) / (17 * 17 + 5 * 5)))
            assert mask[y, x] == (((x - 5 - 17 * t) ** 2 + (y - 9 - 5 * t) ** 2) <= 3.5**2)
    assert brute_skeleton.mask_iou(mask, mask) == 1 and brute_skeleton.mask_iou(mask, mask[:5]) == 0 and brute_skeleton.mask_iou(None, mask) == 0
    assert brute_skeleton.mask_iou(mask, np.zeros_like(mask)) == 0 and brute_skeleton.mask_iou(~mask & mask, ~mask & mask) == 0


def test_skeleton_pairs(spark):
    body = np.stack([np.arange(25) * 3 % 40, np.arange(25) * 7 % 90], axis=1).astype(float)
    conf = [1.0] * 25
    rows = [(1, 0, body.tolist(), conf), (1, 1, body.tolist(), conf), (1, 2, (body + 500).tolist(), conf), (1, 3, None, None), (2, 0, body.tolist(), conf), (3, 0, body.tolist(), conf), (3, 1, (body + [2, 0]).tolist(), conf)]
    df = spark.createDataFrame(rows, "frame_idx long, det_id long, keypoints array<array<double>>, kp_conf array<double>")
    got = {(r["frame_idx"], r["det_id"], r["other_id"]): r for r in skeleton.skeleton_pairs(df).collect()}
    assert len(got) == 12 + 2 and got[1, 0, 1]["iou"] == 1 and got[1, 0, 1]["center_dist_norm"] == 0
    assert got[1, 0, 2]["iou"] == 0 and got[1, 0, 3]["iou"] == 0 and got[1, 0, 3]["center_dist_norm"] == float("inf")
    near = got[3, 0, 1]
    assert 0.3 < near["skeleton_iou"] < 1 and near["iou"] == pytest.approx(0.35 * near["skeleton_iou"] + 0.65 * near["core_skeleton_iou"]) and near["iou"] == got[3, 1, 0]["iou"]


def test_many_skeletons_are_drawn_at_once_and_by_strips(monkeypatch):
    """Pairs in bulk, and large ones by strips of rows, against drawing pixel by pixel."""
    rng = np.random.default_rng(4)
    x, y = rng.random((2, 40, 2, 25)) * rng.choice([5, 70, 300], size=(40, 1, 1))
    for c in (x, y):
        c[3] = np.round(c[3])
    x[5], y[6, 0, 3:9] = x[5, 0, 0], 7.5
    x[rng.random(x.shape) < 0.2] = np.nan
    x[7, 1] = np.nan  # nothing to draw
    low, high = (np.stack([f(f(c, axis=2), axis=1) for c in (x, y)]) for f in (np.nanmin, np.nanmax))
    w, h = np.ceil(high - low + 42).astype(int)
    want = []
    for k in range(40):
        masks = [[brute_skeleton.capsules(np.stack([x[k, s], y[k, s]], axis=1), np.isfinite(x[k, s]), (h[k], w[k]), tuple(low[:, k] - 21), bones) for s in (0, 1)] for bones in (skeleton.FULL, skeleton.TRUNK)]
        want.append([brute_skeleton.mask_iou(*m) for m in masks])
    for most in (1 << 19, 5000, 100):
        monkeypatch.setattr(skeleton, "SPANS", most)
        assert skeleton.drawn_overlap(x, y, *(low - 21), w, h, 7) == pytest.approx(np.array(want), abs=1e-12)
    monkeypatch.undo()
    many = [np.tile(c[[1, 2]], (500, 1, 1)) for c in (x, y)]
    began = time.perf_counter()
    skeleton.drawn_overlap(*many, *(np.tile(c[[1, 2]], 500) for c in (low[0] - 21, low[1] - 21, w, h)), 7)
    assert time.perf_counter() - began < 15  # as rows of a plan some 20 ms a pair


def test_spans_count_the_pixels_of_drawn_skeletons(spark):
    rng = np.random.default_rng(9)
    rows = []
    for frame in range(12):
        for det in range(4):
            points = rng.random((25, 2)) * rng.choice([8, 60, 150]) + rng.random(2) * 80
            if det == 2:
                points = np.round(points)  # bones along axes, of no length, on halves
                points[5:9, 0] = points[5, 0] + 0.5
                points[9:12, 1] = points[9, 1]
                points[12] = points[13]
            points[rng.integers(25)] = np.nan
            conf = None if det == 3 and frame % 3 == 0 else rng.choice([0.01, 0.9], size=25).tolist()
            box = [float(v) for v in (*points[0], *(points[0] + 30))] if det == 1 and np.isfinite(points[0]).all() else None
            rows.append((frame, det, points.tolist(), conf, box))
    df = spark.createDataFrame([*rows, (50, 0, None, None, None), (50, 1, rows[0][2], [0.9] * 25, None)], "frame_idx long, det_id long, keypoints array<array<double>>, kp_conf array<double>, bbox array<double>")
    for thickness in (7, 1):
        got = {(r["frame_idx"], r["det_id"], r["other_id"]): r for r in skeleton.skeleton_pairs(df, thickness).collect()}
        assert len(got) == 12 * 12 + 2
        for frame in range(12):
            people = [brute_skeleton.person(p, c, b) for f, _, p, c, b in rows if f == frame]
            for i in range(4):
                for j in range(i + 1, 4):
                    want = brute_skeleton.skeleton_overlap(people[i], people[j], thickness=thickness)
                    r, s = got[frame, i, j], got[frame, j, i]
                    assert (r["iou"], r["skeleton_iou"], r["core_skeleton_iou"]) == pytest.approx(want, abs=1e-12)
                    assert (s["iou"], s["center_dist_norm"]) == (r["iou"], r["center_dist_norm"])


# ------------------------------------------------------------------ the fold's log


def test_log_of_matched_pairs(spark):
    rows = [("v", 1, f, d, 100.0 * d + f, 0.0) for f in range(10) for d in (0, 3)]
    df = spark.createDataFrame(rows, "video string, epoch_id bigint, frame_idx bigint, det_id bigint, center_x double, center_y double")
    log, states = track_log(df).collect(), track(df).where("is_matched").collect()
    assert {(r["frame_idx"], r["local_track_id"], r["det_id"]) for r in log} == {(r["frame_idx"], r["local_track_id"], r["det_id"]) for r in states}
    assert all(r["update_motion"] and r["app_mode"] == "missing" and r["update_cost"] == pytest.approx(3 * r["d_motion"] + r["d_pose"] + 2 * r["d_app"]) for r in log)


def test_candidate_budget(spark):
    def frame(f, *hits, seen):
        return [(1, f, t, h, t in seen) for t, h in enumerate(hits)]

    # Of five tracks the last has the fewest hits, so missing it costs nothing.
    rows = [*frame(0, 1, 1, 1, 1, 0, seen={0, 1, 2, 3}), *frame(1, 1, 2, 2, 2, 0, seen={1, 2, 3}), *frame(2, 1, 3, 3, 3, 0, seen={1, 2, 3})]
    rows += [*frame(3, 2, 4, 4, 4, 0, seen={0, 1, 2, 3}), *frame(4, 3, 5, 5, 5, 0, seen={0, 1, 2, 3})[:4], *frame(5, 3, 6, 6, 6, 1, seen={1, 2, 3, 4})]
    rows += [rows[0], (2, 7, 0, 1, None), (2, 9, 0, 1, None)]
    states = spark.createDataFrame(rows, "epoch_id long, frame_idx long, local_track_id long, hits long, matched boolean")
    got = [(r["epoch_id"], r["frame_idx"], r["missed_top"], r["used"], r["budget"]) for r in matches.candidate_budget(states).orderBy("epoch_id", "frame_idx").collect()]
    assert got == [(1, 0, False, 9, 7), (1, 1, True, 7, 16), (1, 2, True, 16, 25), (1, 3, False, 25, 7), (1, 4, False, 7, 7), (1, 5, True, 7, 16), (2, 7, False, 9, 7), (2, 9, True, 7, 16)]
    assert matches.candidate_budget(states.limit(0)).count() == 0
