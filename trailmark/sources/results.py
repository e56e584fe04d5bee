"""Scans and sinks of result tables."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from trailmark.functions.geometry import pair_number, pair_weight, torso_center
from trailmark.schemas import OBSERVATIONS, validate


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A results table: a Parquet path, or a folder that holds
    ``dataset/observations.parquet`` or ``observations.parquet``."""
    for place in ([path] if path.endswith(".parquet") else [f"{path}/dataset/observations.parquet", f"{path}/observations.parquet"]):
        fs, where = _fs(spark, place)
        if fs.exists(where):
            return validate(spark.read.parquet(place))
    raise FileNotFoundError(f"no observations under {path}")


def write_buckets(df: DataFrame, path: str, frames: int = 500) -> None:
    """A chunked table: partitioned by ranges of frames, for pruned reads."""
    df.withColumn("frame_bucket", F.floor(F.col("frame_idx") / frames)).repartition("frame_bucket").write.partitionBy("frame_bucket").mode("overwrite").parquet(path)


def read_frames(spark: SparkSession, path: str, low: int, high: int, columns: list[str] | None = None, frames: int = 500) -> DataFrame:
    """Frames ``low`` to ``high`` of a chunked table; other buckets are not opened."""
    df = spark.read.parquet(path).where(F.col("frame_bucket").between(low // frames, high // frames) & F.col("frame_idx").between(low, high)).drop("frame_bucket")
    return df.select(*columns) if columns else df


def parse_chunk(name: str) -> tuple[str, int, int]:
    """Prefix, first and last frame of a chunk file named ``prefix_first_last.parquet``."""
    m = re.fullmatch(r"(.+)_(\d+)_(\d+)\.parquet", name)
    if not m:
        raise ValueError(f"not a chunk name: {name}")
    return m[1], int(m[2]), int(m[3])


def read_chunks(spark: SparkSession, folder: str, schema: StructType = OBSERVATIONS) -> DataFrame:
    """All chunk files of a folder as one table of a fixed schema; chunks that
    lack columns or hold them in other types are cast, an empty folder is an empty table.

    Files are read in groups of one schema, so the plan grows with the schemas,
    not with the chunks. A file whose name is not a chunk's is a ValueError.
    """
    fs, where = _fs(spark, folder)
    files = [s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().endswith(".parquet")] if fs.exists(where) else []
    for f in files:
        parse_chunk(f.rsplit("/", 1)[1])
    groups: dict[str, list[str]] = {}
    if files:
        # Footers are read by tasks; the driver gets one row a file.
        shapes = spark.sparkContext.parallelize(files, max(1, min(len(files), 256))).map(_shape).collect() if len(files) > 1 else [(files[0], "")]
        for f, shape in shapes:
            groups.setdefault(shape, []).append(f)
    out = spark.createDataFrame([], schema)
    for some in groups.values():
        part = spark.read.parquet(*some)
        out = out.unionByName(part.select(*(F.col(c.name).cast(c.dataType).alias(c.name) if c.name in part.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in schema)))
    return out


def _shape(path: str) -> tuple[str, str]:
    """A Parquet file and its schema as text, read from its footer alone."""
    import pyarrow.fs
    import pyarrow.parquet

    place = path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:/") else path
    fs, inner = pyarrow.fs.FileSystem.from_uri(place)
    return path, str(pyarrow.parquet.read_schema(inner, filesystem=fs).remove_metadata())


IMAGES = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}"


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under a folder with their bytes and, as ``place``, their rank by
    path; the ranking moves paths only. No image is a FileNotFoundError."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGES).load(path)
    if files.isEmpty():
        raise FileNotFoundError(f"no images under {path}")
    from trailmark.operators.identity import numbered

    return files.join(numbered(files.select("path"), [F.asc("path")], "place"), "path")


PERSON = "struct<pose_keypoints_2d: array<double>, keypoints: array<array<double>>, pose: array<array<double>>, pose_2d: struct<x: array<double>, y: array<double>, conf: array<double>>>"


def parse_people(df: DataFrame, json_col: str = "people_json", least: float = 0.05) -> DataFrame:
    """One row a detected person, from any of four layouts: ``keypoints`` (NaN where
    the confidence is under ``least``), ``kp_conf`` and the torso's centre.

    The first layout that is there counts: malformed, it drops the person. People
    with no sure point are dropped; ``det_id`` numbers those that are left.
    """

    def triples(a):
        return F.transform(a, lambda p: F.array(p[0], p[1], F.coalesce(F.try_element_at(p, F.lit(3)), F.lit(1.0))))

    person = df.withColumn("__frame", F.monotonically_increasing_id()).select("*", F.posexplode(F.from_json(json_col, f"array<{PERSON}>")).alias("__place", "p"))
    flat, x, y, c = F.col("p.pose_keypoints_2d"), F.col("p.pose_2d.x"), F.col("p.pose_2d.y"), F.col("p.pose_2d.conf")
    n = (F.size(flat) / 3).cast("int")
    rows = F.when((F.size(flat) % 3 == 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * 3 + 1, F.lit(3))))
    listed = lambda v: F.when((F.size(v) > 0) & F.forall(v, lambda p: F.size(p) >= 2), triples(v))
    xy = F.when((F.size(x) > 0) & (F.size(x) == F.size(y)) & (F.size(x) == F.size(c)), F.transform(F.arrays_zip(x.alias("x"), y.alias("y"), c.alias("c")), lambda t: F.array(t["x"], t["y"], t["c"])))
    points = F.when(flat.isNotNull(), rows).when(F.col("p.keypoints").isNotNull(), listed(F.col("p.keypoints"))).when(F.col("p.pose").isNotNull(), listed(F.col("p.pose"))).otherwise(xy)
    sure = person.withColumn("t", points).where(F.exists("t", lambda t: F.coalesce(t[2] >= least, F.lit(False))))
    kp = F.transform("t", lambda t: F.when(F.coalesce(t[2] >= least, F.lit(False)), F.array(t[0], t[1])).otherwise(F.array(F.lit(float("nan")), F.lit(float("nan")))))
    out = sure.withColumns({"keypoints": kp, "kp_conf": F.transform("t", lambda t: t[2]), "det_id": (F.row_number().over(Window.partitionBy("__frame").orderBy("__place")) - 1).cast("bigint")})
    out = out.withColumn("__c", torso_center(F.col("keypoints")))
    return out.select(*[c for c in df.columns if c != json_col], "det_id", "keypoints", "kp_conf", F.col("__c")[0].alias("center_x"), F.col("__c")[1].alias("center_y"))


def write_manifest(spark: SparkSession, path: str, **values) -> None:
    """A small JSON file; see ``write_bytes``."""
    write_bytes(spark, path, json.dumps(values, sort_keys=True).encode())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file. It is written beside its place and put there by a rename that
    replaces an earlier one, so a reader sees the one or the other."""
    jvm = spark.sparkContext._jvm
    fs, where = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(content))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(where), options)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A manifest's values; None where there is none."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """``pair_id, a_path, b_path, label, sample_weight`` of a training folder.

    Files of ``A``, ``B`` and ``Label`` belong together by the number that starts
    their names; images may end in ``__w_NNN``, a weight in hundredths. Errors: a
    name without a number, an A file without its B or label, a label that is not
    0 or 1, images of one pair with unlike weights, no pair at all.
    """

    def listed(kind: str, glob: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root}/{kind}")
        named = files.withColumn("__name", F.element_at(F.split("path", "/"), -1)).withColumn("pair_id", pair_number(F.col("__name")))
        bad = named.where("pair_id is null").select("__name").first()
        if bad:
            raise ValueError(f"{kind}: no pair number in {bad[0]}")
        return named

    a, b, labels = listed("A", IMAGES), listed("B", IMAGES), listed("Label", "*.{txt,TXT}")
    a = a.select("pair_id", F.col("path").alias("a_path"), pair_weight(F.col("__name")).alias("sample_weight"))
    b = b.select("pair_id", F.col("path").alias("b_path"), pair_weight(F.col("__name")).alias("__b"))
    number = F.trim(F.decode("content", "UTF-8"))
    labels = labels.select("pair_id", number.alias("__text"), number.try_cast("double").cast("int").alias("label"))
    for name, other in (("B", b), ("Label", labels)):
        missing = a.join(other, "pair_id", "left_anti").first()
        if missing:
            raise ValueError(f"pair {missing['pair_id']} has no file in {name}")
    out = a.join(b, "pair_id").join(labels, "pair_id")
    wrong = out.where("label is null or label not in (0, 1)").select("pair_id", "__text").first()
    if wrong:
        raise ValueError(f"pair {wrong['pair_id']}: the label is {wrong['__text']!r}, not 0 or 1")
    unlike = out.where(F.abs(F.col("sample_weight") - F.col("__b")) > 1e-8).select("pair_id", "sample_weight", "__b").first()
    if unlike:
        raise ValueError(f"pair {unlike['pair_id']}: weights {unlike['sample_weight']} and {unlike['__b']}")
    if out.isEmpty():
        raise ValueError(f"no pairs under {root}")
    return out.select("pair_id", "a_path", "b_path", "label", "sample_weight")


def write_edges(edges: DataFrame, path: str) -> None:
    """A similarity graph as a table of its edges, by first node."""
    edges.select("i", "j", "sim").sortWithinPartitions("i", "j").write.mode("overwrite").parquet(path)
