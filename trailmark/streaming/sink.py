"""A batch sink that may be replayed, with a manifest of every batch.

Each batch is a folder of its own number. A batch that is run again, after a
crash between its files and its manifest or by a restart from a checkpoint,
replaces itself; readers take batches that have a manifest and see neither half
of one. Rows and frames are counted while they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from trailmark.sources.results import _fs, read_json, write_manifest


def write_counted(df: DataFrame, path: str) -> dict:
    """Write a table, replacing what is there; its ``rows`` and ``first_frame`` and
    ``last_frame`` (without frames, none), observed in the same pass."""
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("rows")]
    if "frame_idx" in df.columns:
        measures += [F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame")]
    df.observe(seen, *measures).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def write_batch(df: DataFrame, batch: int, folder: str) -> dict:
    """Batch number ``batch`` of ``folder`` with its manifest, also where it is empty."""
    counts = write_counted(df, f"{folder}/batch_id={batch}")
    write_manifest(df.sparkSession, f"{folder}/_manifests/{batch}.json", batch=batch, **counts)
    return counts


def chunk_sink(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """The stream's writer; ``start()`` it. ``folder`` and ``checkpoint`` belong together."""
    return stream.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, folder)).option("checkpointLocation", checkpoint)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """``batch, rows, first_frame, last_frame`` of every whole batch."""
    schema = "batch long, rows long, first_frame long, last_frame long"
    fs, where = _fs(spark, f"{folder}/_manifests")
    return spark.read.schema(schema).json(f"{folder}/_manifests/*.json") if fs.exists(where) else spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows of all whole batches, with their ``batch_id``."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return spark.createDataFrame([], StructType([*schema.fields]).add("batch_id", "long"))
    whole = manifests(spark, folder).select(F.col("batch").alias("batch_id"))
    rows = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/batch_id=*")
    return rows.withColumn("batch_id", F.col("batch_id").cast("long")).join(F.broadcast(whole), "batch_id", "left_semi")


__all__ = ["chunk_sink", "manifests", "read_batches", "read_json", "write_batch", "write_counted"]
