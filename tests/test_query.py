import json

import numpy as np
import pytest

from trailmark.operators import export
from trailmark.operators.components import components
from trailmark.operators.query import View, as_list
from trailmark.operators.segments import AmbiguousObservationError, Observation
from trailmark.schemas import META, OBSERVATIONS, validate
from trailmark.sources import jobs, results


@pytest.fixture(scope="module")
def obs(spark):
    def row(frame, epoch, local, gid, matched=True, points=True, confirmed=True):
        return {"frame_idx": frame, "epoch_id": epoch, "local_track_id": local, "global_track_id": gid, "det_id": 0, "is_matched": matched, "confirmed": confirmed, "bbox_x1": 0.0, "bbox_y1": 0.0, "bbox_x2": 1.0, "bbox_y2": 1.0, "keypoints": [[0.0, 0.0]] * 25 if points else None, "kp_conf": [1.0] * 25 if points else None}

    rows = [row(f, 1, 1, 10) for f in (1, 2, 3)] + [row(4, 1, 1, 10, matched=False, points=False)] + [row(f, 2, 1, 10) for f in (8, 9)]
    rows += [row(f, 1, 2, 20) for f in (2, 3)] + [row(3, 1, 3, None)] + [row(9, 3, 5, 20), row(9, 3, 6, 20)]
    return View(spark.createDataFrame([tuple(r.get(f.name) for f in OBSERVATIONS) for r in rows], OBSERVATIONS))


def test_filters(obs):
    assert len(obs.global_id(10)) == 6
    assert len(obs.global_ids([10, 20]).matched_only()) == 9
    assert len(obs.global_ids(10).epoch(2)) == 2
    assert len(obs.local_track(1, 1)) == 4
    assert len(obs.unassigned()) == 1
    assert len(obs.with_keypoints()) == 10
    assert len(obs.select(global_ids=10, epochs=[1], frames=(2, 4), matched=True)) == 2


def test_range_errors(obs):
    with pytest.raises(ValueError):
        obs.between(3, 2)
    with pytest.raises(ValueError):
        obs.window(0, 0)


def test_frame_lookup(obs):
    assert obs.global_id(10).frame(2)["epoch_id"] == 1
    with pytest.raises(LookupError):
        obs.global_id(10).frame(100)
    with pytest.raises(AmbiguousObservationError):
        obs.global_id(20).frame(9)
    with pytest.raises(ValueError):
        obs.frame(2)


def test_one_identity_drops_null_rows(obs):
    assert len(obs.local_track(3, 1).frames(1, 5)) == 1
    assert len(obs.epoch(1).frames(1, 5)) == 7


def test_padded_window(obs):
    rows = {r["frame_idx"]: r for r in obs.global_id(10).window(3, 4).collect()}
    assert sorted(rows) == [3, 4, 5, 6]
    assert [rows[f]["frame_mask"] for f in (3, 4, 5, 6)] == [True, True, False, False]
    assert [rows[f]["detection_mask"] for f in (3, 4, 5, 6)] == [True, False, False, False]


def test_fragments_and_samples(obs):
    found = {(r[0], r[1], r[2]): (r["start_frame"], r["end_frame"], r["n_observations"], r["n_matched"]) for r in obs.local_tracks().collect()}
    assert found[10, 1, 1] == (1, 4, 4, 3)
    rows = obs.sample_per_global(2, seed=1).collect()
    assert len(rows) == 4 and rows == obs.sample_per_global(2, seed=1).collect()
    assert [(r[0], r[1], r[2]) for r in obs.ambiguous().collect()] == [(20, 9, 2)]


def test_validation(spark):
    with pytest.raises(ValueError, match="keypoints"):
        validate(spark.range(1).withColumnRenamed("id", "frame_idx"))
    assert as_list("ab") == ["ab"] and as_list((1, 2)) == [1, 2] and as_list(None) is None


def test_export(spark):
    states = spark.createDataFrame([(1, 1, 1, 0), (2, 1, 1, -1), (2, 1, 2, 1)], "frame_idx bigint, epoch_id bigint, local_track_id bigint, det_id bigint")
    prepared = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.25)], "frame_idx bigint, det_id bigint, max_overlap_iou double")
    mapping = spark.createDataFrame([(1, 1, 7)], "epoch_id bigint, local_track_id bigint, global_track_id bigint")
    rows = export.build_observations(states, prepared, mapping, ordered=True).collect()
    assert [(r["global_track_id"], r["frame_idx"], r["det_id"], r["max_overlap_iou"]) for r in rows] == [(7, 1, 0, 0.5), (7, 2, None, None), (None, 2, 1, 0.25)]
    for twice, other in ((prepared.union(prepared), mapping), (prepared, mapping.union(mapping))):
        with pytest.raises(Exception, match="repeated key"):
            export.build_observations(states, twice, other).collect()
    with pytest.raises(ValueError, match="video"):
        export.build_observations(states.selectExpr("'a' AS video", "*"), prepared, mapping)


def test_sources(spark, tmp_path, obs):
    path = str(tmp_path / "chunks")
    results.write_buckets(obs.df, path, frames=4)
    assert results.read_frames(spark, path, 2, 3, ["frame_idx"], frames=4).count() == 5
    obs.df.write.parquet(str(tmp_path / "dataset" / "observations.parquet"))
    assert len(View.open(spark, str(tmp_path))) == len(obs)
    with pytest.raises(FileNotFoundError):
        results.scan(spark, str(tmp_path / "none"))


def test_people_layouts(spark):
    text = json.dumps([
        {"pose_keypoints_2d": [1, 2, 0.5, 3, 4, 0.01]},
        {"pose_keypoints_2d": [1, 2], "keypoints": [[1, 2]]},  # the first layout is malformed, so the person goes
        {"keypoints": [[5, 6], [7, 8]]},
        {"pose": [[1, 1, 0.0]]},  # no sure point
        {"pose_2d": {"x": [1], "y": [2], "conf": [0.5]}},
        {"pose_2d": {"x": [1, 2], "y": [2], "conf": [0.5]}},
        {},
    ])
    rows = [r.asDict() for r in results.parse_people(spark.createDataFrame([(text, 3)], "people_json string, frame_idx int")).orderBy("det_id").collect()]
    assert [(r["frame_idx"], r["det_id"]) for r in rows] == [(3, 0), (3, 1), (3, 2)]
    assert rows[0]["keypoints"][0] == [1, 2] and np.isnan(rows[0]["keypoints"][1]).all() and rows[0]["kp_conf"] == [0.5, 0.01]
    assert (rows[0]["center_x"], rows[0]["center_y"]) == (1, 2)
    assert rows[1]["keypoints"] == [[5, 6], [7, 8]] and rows[1]["kp_conf"] == [1, 1] and rows[1]["center_x"] == 7  # joint 1 is the neck
    assert rows[2]["keypoints"] == [[1, 2]]


def test_chunks_of_several_schemas(spark, tmp_path):
    folder = str(tmp_path / "c")
    (tmp_path / "c").mkdir()
    for name, columns in (("obs_0_9", "id as frame_idx, 1 as epoch_id"), ("obs_10_19", "cast(id + 10 as int) as frame_idx, 'x' as other"), ("obs_20_29", "id + 20 as frame_idx, 1 as epoch_id")):
        spark.range(10).selectExpr(*columns.split(", ")).toPandas().to_parquet(f"{folder}/{name}.parquet")
    got = results.read_chunks(spark, folder)
    assert got.schema == OBSERVATIONS and sorted(r["frame_idx"] for r in got.collect()) == list(range(30))
    assert got.where("epoch_id = 1").count() == 20 and results.read_chunks(spark, str(tmp_path / "none")).count() == 0
    spark.range(1).toPandas().to_parquet(f"{folder}/stray.parquet")
    with pytest.raises(ValueError, match="stray"):
        results.read_chunks(spark, folder)


def test_images_in_order(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        results.images(spark, str(tmp_path))
    for n in ("b.png", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    rows = results.images(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r["place"], bytes(r["content"])) for r in rows] == [(1, b"a.jpg"), (2, b"b.png")]


def test_job_restarts_where_it_stopped(spark, tmp_path):
    folder, ran, fail = str(tmp_path / "job"), [], [True]

    def stage(name, add):
        def run(s, df):
            ran.append(name)
            if name == "b" and fail[0]:
                raise RuntimeError("stopped")
            return df.withColumn("frame_idx", df["frame_idx"] + add)

        return jobs.Stage(name, run, f"stages.{name}.on")

    stages, source = [stage("a", 1), stage("b", 10), stage("c", 100)], spark.range(3).withColumnRenamed("id", "frame_idx")
    config = {"stages": {"c": {"on": False}}}
    with pytest.raises(RuntimeError):
        jobs.run(spark, source, stages, folder, config, {"files": 1})
    fail[0] = False
    out = jobs.run(spark, source, stages, folder, config, {"files": 1})
    assert ran == ["a", "b", "b"] and sorted(r[0] for r in out.collect()) == [11, 12, 13]
    assert results.read_json(spark, f"{folder}/b.json") == {"status": "completed", "rows": 3, "last_frame": 13}
    with pytest.raises(ValueError, match="another input"):
        jobs.run(spark, source, stages, folder, config, {"files": 2})
    assert jobs.option({"a": {"b": 0}}, "a.b", 5) == 0 and jobs.option({"a": {"b": 0}}, "a.b.c", 5) == 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_text("x")
    listing = spark.read.format("binaryFile").load(str(tmp_path / "f"))
    first = jobs.fingerprint(listing)
    (tmp_path / "f" / "x").write_text("xy")
    assert first == jobs.fingerprint(listing) or first["bytes"] == 1
    assert jobs.fingerprint(spark.read.format("binaryFile").load(str(tmp_path / "f"))) != first


def test_segment_objects(spark, obs):
    s = obs.global_id("10").segment(3, 4)
    assert s.global_id == 10 and s.frames.tolist() == [3, 4, 5, 6] and len(s) == 4
    assert s.observation_mask.tolist() == [True, True, False, False] and s.detection_mask.tolist() == [True, False, False, False]
    assert s.keypoints_mask.tolist() == [True, False, False, False]
    assert s.kps.shape == (4, 25, 3) and np.isnan(s.kps[2, :, :2]).all() and (s.kps[2, :, 2] == 0).all()
    assert s.bbox[0].tolist() == [0, 0, 1, 1] and np.isnan(s.bbox[3]).all()
    assert s.meta["n_visible_keypoints"].tolist() == [25, 0, 0, 0] and s.meta["epoch_id"].iloc[0] == 1 and s.meta["epoch_id"].isna().iloc[3]
    assert list(s.meta.columns) == [*META, "n_visible_keypoints"] and s.data.frames.tolist() == s.frames.tolist()
    whole = obs.global_id(10).segment()
    assert whole.frames.tolist() == [1, 2, 3, 4, 8, 9] and all(o.is_observed for o in whole)
    both = obs.select(global_ids=np.array([10, 20]), frames=(1, 3)).segment(1, 3)
    assert both.global_ids == [10, 20] and "20" in both and both[20].observation_mask.tolist() == [False, True, True]
    o = obs.global_id(10).observation(2)
    assert o.has_detection and o.bbox.width == 1 and np.asarray(o.bbox).tolist() == [0, 0, 1, 1]
    for broken in ({"keypoints": [[0.0, 0.0]] * 24}, {"kp_conf": [1.0] * 3}, {"keypoints": [[0.0]] * 25}):
        with pytest.raises(ValueError, match="24|3|25"):
            Observation(1, 1, broken).kps


def test_ambiguous_rows_are_named(spark, obs):
    with pytest.raises(AmbiguousObservationError) as e:
        obs.global_id(20).frame(9)
    assert (e.value.global_track_id, e.value.frame_idx, len(e.value.rows)) == (20, 9, 2)
    with pytest.raises(AmbiguousObservationError):
        obs.global_id(20).window(8, 3)
    with pytest.raises(AmbiguousObservationError):
        obs.global_id(20).segment(8, 3).kps  # noqa: B018
    assert obs.global_id(20).window(2, 3).count() == 3  # the doubled frame lies outside
    assert obs.ambiguous_rows().count() == 2
    for ask in (lambda: obs.unassigned().window(0, 3), lambda: obs.unassigned().segment(0, 3)):
        with pytest.raises(ValueError, match="identity"):
            ask()


def test_states_and_meta(obs):
    assert obs.states().where("has_detection").count() == 10 and obs.states().where("not has_keypoints").count() == 1
    assert obs.meta().columns == [*META, "n_visible_keypoints"]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5), (30, 31), (31, 32), (32, 33), (33, 34)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long"), one_task).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 30: 30, 31: 30, 32: 30, 33: 30, 34: 30}
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def pair_folder(root, a, b, labels):
    for kind, names in (("A", a), ("B", b)):
        (root / kind).mkdir(parents=True)
        for n in names:
            (root / kind / n).write_text("x")
    (root / "Label").mkdir()
    for n, text in labels.items():
        (root / "Label" / n).write_text(text)
    return str(root)


def test_pair_files(spark, tmp_path):
    good = pair_folder(tmp_path / "good", ["1_x__w_280.jpg", "2_y.jpg"], ["1_z__w_280.png", "2_q.jpg", "9_alone.jpg"], {"1.txt": "1.0\n", "2__w_050.txt": "0"})
    rows = results.pairs(spark, good).orderBy("pair_id").collect()
    assert [(r["pair_id"], r["label"], r["sample_weight"]) for r in rows] == [("1", 1, 2.8), ("2", 0, 1.0)]
    for name, a, b, labels, says in (
        ("no_b", ["1.jpg", "2.jpg"], ["1.jpg"], {"1.txt": "1", "2.txt": "0"}, "pair 2"),
        ("no_label", ["1.jpg"], ["1.jpg"], {"3.txt": "1"}, "pair 1"),
        ("label", ["1.jpg"], ["1.jpg"], {"1.txt": "7"}, "7"),
        ("text", ["1.jpg"], ["1.jpg"], {"1.txt": "yes"}, "yes"),
        ("weights", ["1__w_100.jpg"], ["1__w_200.jpg"], {"1.txt": "1"}, "weights"),
        ("number", ["x.jpg"], ["1.jpg"], {"1.txt": "1"}, "no pair number"),
    ):
        with pytest.raises(ValueError, match=says):
            results.pairs(spark, pair_folder(tmp_path / name, a, b, labels))
