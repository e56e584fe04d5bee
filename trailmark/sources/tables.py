"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It lies in the cluster's ``spark.checkpoint.dir``. Only in local mode, where
    driver and executors are one process, may a temporary folder stand in for it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, *replaced: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This drops the lineage, survives lost executors and, unlike ``checkpoint()``,
    gives the planner the real size (a checkpointed plan keeps its estimate, and
    estimates of joins in a loop multiply without bound). ``replaced`` are earlier
    results of this function that are no longer needed; their files go at once,
    all others when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    for old in replaced:
        gone = jvm.org.apache.hadoop.fs.Path(old._cut_path)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out
