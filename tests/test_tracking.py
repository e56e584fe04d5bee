import time

import numpy as np
import pytest

from trailmark.operators import tracking
from trailmark.operators.tracking import Motion, Params, Seen, Track, Tracker, decide_appearance, deferred_match, pose_similarity, risky_overlaps, track
from trailmark.streaming.tracking import track_stream

SCHEMA = "video string, epoch_id bigint, frame_idx bigint, det_id bigint, center_x double, center_y double"


def rows(video="v", epoch=1, first=1, n=12):
    out = []
    for f in range(first, first + n):
        out.append((video, epoch, f, 0, 100.0 + 2 * f, 50.0))
        if f % 5:
            out.append((video, epoch, f, 1, 600.0 - 2 * f, 300.0))
    return out


def test_two_tracks_keep_their_ids(spark):
    got = track(spark.createDataFrame(rows() + rows(epoch=2, first=13), SCHEMA)).collect()
    for epoch in (1, 2):
        mine = [r for r in got if r["epoch_id"] == epoch]
        assert {r["local_track_id"] for r in mine} == {1, 2}
        matched = {(r["frame_idx"], r["det_id"]): r["local_track_id"] for r in mine if r["is_matched"]}
        assert len({t for (f, d), t in matched.items() if d == 0}) == len({t for (f, d), t in matched.items() if d == 1}) == 1
        first = [r for r in mine if r["frame_idx"] == min(x["frame_idx"] for x in mine)]
        assert all(not r["is_matched"] and r["det_id"] == -1 and r["hits"] == 1 for r in first)  # newborn
        for f in {r["frame_idx"] for r in mine}:
            dets = [r["det_id"] for r in mine if r["frame_idx"] == f and r["is_matched"]]
            assert len(dets) == len(set(dets))


def test_death_after_misses():
    tracker = Tracker(Params(max_age=2))
    tracker.step([Seen(0, 10.0, 10.0)])
    assert [len(tracker.step([])) for _ in range(3)] == [1, 1, 0]


def test_motion_equals_matrices():
    p, m = Params(), Motion(10.0, 20.0, a=1000.0, c=1000.0)
    f = np.array([[1, p.dt], [0, 1]])
    q = p.process * np.array([[p.dt**4 / 4, p.dt**3 / 2], [p.dt**3 / 2, p.dt**2]])
    x, cov = np.array([10.0, 0.0]), np.eye(2) * 1000.0
    for z in (12.0, 13.0, 19.0, 18.0):
        m.predict(p)
        m.update(z, 20.0, p)
        x, cov = f @ x, f @ cov @ f.T + q
        gain = cov[:, 0] / (cov[0, 0] + p.measure)
        x, cov = x + gain * (z - x[0]), cov - np.outer(gain, cov[0])
    assert np.allclose([m.x, m.vx, m.a, m.b, m.c], [*x, cov[0, 0], cov[0, 1], cov[1, 1]])


def test_deferred_match_resolves_conflicts():
    cost = np.array([[0.0, 1.0], [0.0, 5.0], [0.5, 2.0]])
    got = deferred_match(cost, np.ones((3, 2), dtype=bool), lambda d, rivals: [1.0 if t == 0 else 0.0 for t in rivals], 4.1)
    # 1 takes detection 0 by conflict cost; of the losers 0 and 2, 2 has the lower conflict cost at detection 1.
    assert got == {1: 0, 2: 1}


def test_pose_similarity_sees_swapped_sides():
    points = np.random.default_rng(0).normal(size=(25, 2))
    swapped = points.copy()
    for i, j in ((2, 5), (3, 6), (9, 12), (10, 13)):
        swapped[[i, j]] = swapped[[j, i]]
    conf = np.ones(25)
    assert pose_similarity(points, conf, swapped, conf, 0.05) > 0.999
    assert pose_similarity(points, conf * 0, points, conf, 0.05) == 0.0


def test_stream_equals_batch(spark, tmp_path):
    whole = rows(n=12) + rows(epoch=2, first=13, n=6)
    for i in range(3):
        part = [r for r in whole if (r[2] - 1) // 6 == i]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = track_stream(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: tuple(r)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(key, track(spark.createDataFrame(whole, SCHEMA)).collect()))


WIDE = SCHEMA + ", keypoints array<array<double>>, kp_conf array<double>, e_app array<double>, e_app_valid_mask array<boolean>, e_app_coverage double"
POSE = [[float(i % 5) * 20, float(i // 5) * 30] for i in range(25)]


def second_match(spark, *later, first=(POSE, [1.0, 0.0, 0.0, 0.0], [True] * 4, 1.0)):
    """Whether the one detection of frame 2 is matched to the track of frame 1, for each of ``later``."""
    data = [(str(i), 1, f, 0, 100.0 + f, 50.0, (r := first if f == 1 else row)[0], [1.0] * 25, *r[1:]) for i, row in enumerate(later) for f in (1, 2)]
    got = track(spark.createDataFrame(data, WIDE)).where("frame_idx = 2 and local_track_id = 1").collect()
    return [r["is_matched"] for r in sorted(got, key=lambda r: int(r["video"]))]


def test_gates_on_rows_with_keypoints_vectors_and_masks(spark):
    same, other, valid = [1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 3.0, 3.0], [True] * 4
    got = second_match(
        spark,
        (POSE, same, valid, 1.0),
        (POSE, None, None, 0.0),  # appearance missing costs 0.58 against 0.12
        (None, same, valid, 1.0),  # pose missing costs 0.5 against 0.4
        (POSE, other, valid, 1.0),
        (POSE, other, [True, True, False, False], 1.0),  # only valid components are compared
        (POSE, other, [False] * 4, 1.0),  # an empty mask counts for nothing
        (POSE, same, valid, None),
    )
    assert got == [True, False, False, False, True, False, True]


def test_births_weigh_pose_and_appearance():
    a, b, pose = np.array([1.0, 0.0]), np.array([-1.0, 0.0]), np.array(POSE)
    far = pose + 500
    for left, right, seen in (((pose, a), (pose, b), (pose, a)), ((pose, a), (far, a), (pose, a))):
        tracker = Tracker(Params(easy_births=0))
        tracker.step([Seen(0, 0.0, 0.0, left[0], None, left[1]), Seen(1, 40.0, 0.0, right[0], None, right[1])])
        tracker.step([Seen(0, 22.0, 0.0, seen[0], None, seen[1])])  # nearer to the right one
        assert [c.seen.x for c in tracker.pending] == [40.0] and len(tracker.tracks) == 1
    tracker = Tracker(Params(easy_births=0, birth_score=0.05))
    tracker.step([Seen(0, 0.0, 0.0)])
    tracker.step([Seen(0, 0.0, 0.0)])  # both missing: 0.08
    assert not tracker.tracks and len(tracker.pending) == 2


def test_few_keypoints_make_no_memory():
    def pose(n):
        out = np.array(POSE)
        out[[i for i in (1, 2, 3, 5, 6, 8, 9, 10, 12, 13)][n:]] = np.nan
        return out

    for n, kept in ((6, False), (7, True)):
        tracker = Tracker(Params(easy_births=0))
        for _ in range(2):
            tracker.step([Seen(0, 0.0, 0.0, pose(n), np.ones(25), np.ones(3))])
        assert (tracker.tracks[0].vector is not None) == kept
    for n, kept in ((4, False), (5, True)):
        tracker = Tracker()
        for k in (10, n):
            tracker.step([Seen(0, 0.0, 0.0, pose(k), np.ones(25), np.ones(3))])
        assert bool(np.isnan(tracker.tracks[0].points).any()) == kept


# ------------------------------------------------------------------ gates of a matched track, by hand


def seen(x, vector=None, points=True, det=0, **more):
    body = np.stack([np.linspace(0, 50, 25), np.linspace(0, 90, 25)], axis=1) + x if points else None
    return Seen(det, float(x), 0.0, body, np.ones(25) if points else None, vector, posed=points, dressed=vector is not None, **more)


def grown(frames=8, **more):
    """One track, seen at the same place; easy start gives it its vector at once."""
    t = Tracker(Params(easy_births=1))
    for _ in range(frames):
        t.step([seen(0, np.array([1.0, 0.0]), **more)])
    return t


def test_overlap_is_a_weak_motion_update():
    free, held = grown(), grown()
    before = free.tracks[0].motion.x
    free.step([seen(20, np.array([1.0, 0.0]))])
    held.step([seen(20, np.array([1.0, 0.0]), risky=(9,))])
    assert free.tracks[0].hits == held.tracks[0].hits == 9
    assert held.tracks[0].motion.x - before == pytest.approx(0.25 * (free.tracks[0].motion.x - before))
    assert free.tracks[0].points[0, 0] == 20 and held.tracks[0].points[0, 0] == 0  # the pose stays


def test_a_freeze_blocks_the_vector_only():
    t = grown()
    t.tracks[0].frozen = {99: 5}
    t.step([seen(5, np.array([0.99, 0.1]))])
    assert t.tracks[0].points[0, 0] == 5 and t.tracks[0].vector.tolist() == [1.0, 0.0] and t.tracks[0].stale == 1


def test_beyond_the_motion_gate_nothing_changes():
    t = grown()
    p, track = Params(), t.tracks[0]
    track.motion.predict(p)
    var = track.motion.a + p.measure
    x = track.motion.x + (0.085 * p.chi2 * var) ** 0.5  # between the update's 0.08 and the match's 0.09
    t = grown()
    t.step([seen(x, np.array([1.0, 0.0]))])
    assert t.tracks[0].hits == 8 and t.tracks[0].missed == 1 and t.tracks[0].center == (0.0, 0.0) and t.tracks[0].stale == 1


def angled(cost):
    """A unit vector at this appearance cost from (1, 0)."""
    c = 1 - 2 * cost
    return np.array([c, (1 - c * c) ** 0.5])


def test_recovery_after_three_agreeing_vectors():
    t = grown()
    far = angled(0.1)
    for k in (1, 2):
        t.step([seen(0, far)])
        assert len(t.tracks[0].buffer) == k and t.tracks[0].vector.tolist() == [1.0, 0.0] and t.tracks[0].stale == k
    t.step([seen(0, far)])
    want = 0.97 * np.array([1.0, 0.0]) + 0.03 * far
    assert t.tracks[0].vector == pytest.approx(want / np.linalg.norm(want)) and t.tracks[0].stale == 0 and not t.tracks[0].buffer


def test_reasons_and_clearing_of_the_buffer():
    p = Params(appearance=1.0)
    for appearance, more, overlapped, frozen, reason, kept in (
        (0.05, {}, False, {}, "strict", 1), (0.1, {}, True, {}, "overlap", 0), (0.1, {}, False, {1: 2}, "freeze", 0), (0.2, {}, False, {}, "hard", 0),
        (0.1, {"coverage": 0.5}, False, {}, "unsafe", 0), (0.15, {}, False, {}, "above", 1), (0.1, {}, False, {}, "buffer", 2), (0.05, {"none": True}, False, {}, "missing", 1),
    ):
        track = Track(1, None, vector=np.array([1.0, 0.0]), frozen=frozen, buffer=[np.array([1.0, 0.0])])
        s = seen(0, None if more.pop("none", False) else angled(appearance), **more)
        assert decide_appearance(track, s, 0.0, 0.0, appearance, overlapped, p) == reason and len(track.buffer) == kept
    # After many matched frames without an update the reach is the hard limit.
    late = Track(1, None, vector=np.array([1.0, 0.0]), stale=100)
    assert decide_appearance(late, seen(0, angled(0.17)), 0.0, 0.0, 0.17, False, p) == "buffer"


def test_overlap_thresholds_by_zone():
    p, a, b = Params(), Track(1, None, sub=True), Track(2, None, confirmed=True)
    young = Track(3, None)

    def risky(overlap, away, track, other):
        return risky_overlaps(seen(0, overlaps=((7, overlap, away),)), track, {7: other} if other else {}, p) == (7,)

    for away, limit in ((0.5, 0.003), (0.8, 0.005), (1.1, 0.007), (1.5, 0.008)):
        assert risky(limit + 1e-4, away, a, b) and not risky(limit, away, a, b)
    for pair in ((a, young), (young, b), (a, None), (None, b)):  # not both stable: the default
        assert not risky(0.0079, 0.1, *pair) and risky(0.0081, 0.1, *pair)
    assert risky_overlaps(seen(0, risky=(4,)), a, {}, p) == (4,)


def test_unknown_coverage_is_no_perfect_match(spark):
    rows = [("v", 1, f, 0, 0.0, 0.0, [1.0, 0.0] if f < 6 else [-1.0, 0.0], None) for f in range(8)]
    found = track(spark.createDataFrame(rows, "video string, epoch_id bigint, frame_idx bigint, det_id bigint, center_x double, center_y double, e_app array<double>, e_app_coverage double"))
    last = found.where("frame_idx = 7").collect()
    assert not any(r["is_matched"] and r["local_track_id"] == 1 for r in last)  # opposite vectors never match


def test_candidates_go_on_as_by_a_sorted_list_of_all_pairs(monkeypatch):
    """Scores of all pairs, in order, against kinds that are settled band by band."""
    rng, p = np.random.default_rng(3), Params()

    def score(c, s):
        motion = c.motion.distance(s.x, s.y, p) / p.birth_chi2
        if motion > p.birth_motion:
            return None
        total = motion + tracking.pose_penalty(c.seen, s, p)
        if c.vector is None or s.vector is None:
            total += p.birth_appearance_missing
        elif (1 - tracking._cosine(c.vector, s.vector)) / 2 > p.birth_appearance_limit:
            total += p.birth_appearance_bad
        return total + (p.birth_near_existing if c.kind == "near" else 0.0)

    for most, step, body in ((1 << 18, 1, False), (50, 1, False), (50, 40, False), (1, 0.01, False), (200, 1, True)):
        monkeypatch.setattr(tracking, "AT_ONCE", most)
        place = lambda n: np.round(rng.exponential(300, (n, 2)) / step) * step  # noqa: B023, E731
        see = lambda k, x, y: seen(x, angled(0.9 * (k % 7) / 7) if k % 3 else None, points=bool(k % 5), det=k) if body else Seen(k, x, y)  # noqa: B023, E731
        t = Tracker(p)
        t.pending = [tracking.Pending(Motion(x, y, a=1000.0 + 500 * (k % 2)), "near" if k % 4 == 0 else "normal", 2, s := see(k, x, y), s.vector) for k, (x, y) in enumerate(place(120))]
        rest = [see(k, x, y) for k, (x, y) in enumerate(place(150))]
        want: list = []
        for _, i, j in sorted((v, i, j) for i, c in enumerate(t.pending) for j, s in enumerate(rest) if (v := score(c, s)) is not None):
            if all(i != a and j != b for a, b in want):
                want.append((i, j))
        assert len(want) > 20 and t._continued(rest) == want


def test_large_frames_compare_no_pair_of_rows_in_python():
    rng, tracker = np.random.default_rng(0), Tracker()
    began = time.perf_counter()
    for _ in range(4):
        tracker.step([Seen(k, float(x), 0.0) for k, x in enumerate(rng.exponential(500, 5000))])
    assert time.perf_counter() - began < 40  # 25 million pairs a frame took minutes
