import pytest
from pyspark.sql import functions as F

from trailmark.schemas import OBSERVATIONS
from trailmark.sources import chunks, jobs, results
from trailmark.streaming import series, sink


def test_chunks_outside_the_frames_are_not_opened(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    for i, columns in enumerate(("id as frame_idx, 1 as epoch_id", "cast(id + 10 as int) as frame_idx, 'x' as other", "id + 20 as frame_idx, cast(1 as double) as epoch_id")):
        spark.range(10).selectExpr(*columns.split(", ")).toPandas().to_parquet(folder / f"obs_{10 * i:06}_{10 * i + 9:06}.parquet")
    whole = chunks.read(spark, str(folder))
    assert whole.schema == OBSERVATIONS and sorted(r["frame_idx"] for r in whole.collect()) == list(range(30))
    assert whole.where("epoch_id = 1").count() == 20
    # A file that cannot be opened: only reads that need it fail.
    (folder / "obs_000030_000039.parquet").write_bytes(b"no parquet")
    (folder / "old_000000_000009.parquet").write_bytes(b"no parquet")
    part = chunks.read(spark, str(folder), "obs")
    assert sorted(r[0] for r in part.where("frame_idx between 5 and 12").select("frame_idx").collect()) == list(range(5, 13))
    assert part.where("frame_idx = 21").count() == 1 and part.where("frame_idx in (3, 28)").count() == 2
    assert part.where("frame_idx < 30 and frame_idx > 27").count() == 2 and part.where("frame_idx > 100").count() == 0
    with pytest.raises(Exception):
        part.where("frame_idx >= 30").count()
    assert chunks.read(spark, str(tmp_path / "none")).count() == 0
    (folder / "stray.parquet").write_bytes(b"")
    with pytest.raises(Exception, match="stray"):
        chunks.read(spark, str(folder)).count()


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    """A crash after a batch's files and before its manifest, an empty batch, and a second run."""
    folder = str(tmp_path / "out")
    kind = spark.range(1).selectExpr("id as frame_idx").schema
    assert sink.read_batches(spark, folder, kind).count() == 0
    sink.write_batch(spark.range(0, 5).selectExpr("id as frame_idx"), 0, folder)
    spark.range(5, 9).selectExpr("id as frame_idx").write.parquet(f"{folder}/batch_id=1")  # and no manifest
    assert sink.read_batches(spark, folder, kind).count() == 5
    for _ in range(2):
        assert sink.write_batch(spark.range(5, 10).selectExpr("id as frame_idx"), 1, folder) == {"rows": 5, "first_frame": 5, "last_frame": 9}
    sink.write_batch(spark.range(0).selectExpr("id as frame_idx"), 2, folder)
    assert sorted(r["frame_idx"] for r in sink.read_batches(spark, folder, kind).collect()) == list(range(10))
    assert [tuple(r) for r in sink.manifests(spark, folder).orderBy("batch").collect()] == [(0, 5, 0, 4), (1, 5, 5, 9), (2, 0, None, None)]


def test_a_killed_stream_goes_on_without_doubles(spark, tmp_path):
    source, folder, kept = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    for i in range(4):
        spark.range(10 * i, 10 * i + 10, 1, 1).selectExpr("id as frame_idx").write.mode("append").parquet(source)
    stream = spark.readStream.schema("frame_idx long").option("maxFilesPerTrigger", 1).parquet(source)
    fail = [True]

    def write(df, batch):
        counts = sink.write_batch(df, batch, folder)
        if batch == 2 and fail[0]:  # the batch is whole, but the stream does not know
            raise RuntimeError("killed")
        return counts

    def go():
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        go()
    fail[0] = False
    go()
    got = sink.read_batches(spark, folder, stream.schema)
    assert sorted(r["frame_idx"] for r in got.collect()) == list(range(40)) and sink.manifests(spark, folder).count() == 4


def test_series_resume_at_any_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(v, f, (f // 3) % 2 == 1, None if f == 7 else (f * 13 % 10) / 10) for v in "ab" for f in range(1, 13)]
    schema = "video string, frame_idx long, reset boolean, value double"
    for i in range(4):
        spark.createDataFrame([r for r in rows if (r[1] - 1) // 3 == i], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    key = lambda r: (r["video"], r["frame_idx"], r["epoch_id"], r["was_reset"], round(r["g"], 12))

    def run(parts, name, carried=None):
        out = str(tmp_path / name)
        places = str(tmp_path / "in") + "/{" + ",".join(map(str, parts)) + "}"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(places)
        found = series.series_stream(stream, 0.3, carried=carried)
        found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}.ckpt").trigger(availableNow=True).start().awaitTermination(180)
        return spark.read.parquet(out)

    want = []
    for v in "ab":
        epoch, was, g = 1, False, 1.0
        for _, f, reset, value in (r for r in rows if r[0] == v):
            epoch, was = epoch + (reset and not was), reset
            g = g if value is None else 0.7 * g + 0.3 * value
            want.append((v, f, epoch, reset, round(g, 12)))
    try:
        assert sorted(map(key, run((0, 1, 2, 3), "whole").collect())) == want
        first = run((0, 1), "first")
        rest = run((1, 2, 3), "rest", series.states(first))  # one batch comes again
        assert sorted(map(key, first.unionByName(rest).collect())) == want
        with pytest.raises(ValueError, match="mode"):
            run((2, 3), "other", series.states(first).withColumn("mode", F.lit("series-0")))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_options_from_a_file(spark, tmp_path):
    path = str(tmp_path / "o.json")
    results.write_text(spark, path, '{"tracking": {"dt": 1, "on": false}, "path": null}')
    defaults = {"tracking": {"dt": 0.5, "on": True, "n": 3}, "path": "x"}
    assert jobs.options(spark, path, defaults) == {"tracking": {"dt": 1.0, "on": False, "n": 3}, "path": None}
    assert jobs.option(jobs.options(spark, path), "tracking.dt") == 1
    for text, what in (('{"tracking": {"n": "3"}}', "tracking.n"), ('{"trackin": {}}', "trackin"), ('{"tracking": {"on": 1}}', "tracking.on")):
        results.write_bytes(spark, path, text.encode())
        with pytest.raises(ValueError, match=what):
            jobs.options(spark, path, defaults)
    with pytest.raises(FileNotFoundError):
        jobs.options(spark, str(tmp_path / "none.json"))
