"""Folders of chunk files as a data source that reads no file it does not need.

A chunk's name tells its frames: ``prefix_first_last.parquet``. Filters on
``frame_idx`` are pushed to the source, which leaves out files whose range they
exclude before any is opened; each file that is left is a task's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from trailmark.schemas import OBSERVATIONS


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Chunk(ds.InputPartition):
    path: str
    first: int
    last: int


class ChunkReader(ds.DataSourceReader):
    def __init__(self, folder: str, prefix: str | None, schema: StructType):
        self.folder, self.prefix, self.schema = folder, prefix, schema
        self.low, self.high = -math.inf, math.inf

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Narrows the range of frames; Spark applies all filters to the rows as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_idx",):
                if isinstance(f, ds.EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, ds.In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value))
                elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, ds.GreaterThan))
                elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, ds.LessThan))
            yield f

    def partitions(self) -> list[Chunk]:
        fs, folder = _place(self.folder)
        found = []
        for f in fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(".parquet"):
                m = re.fullmatch(r"(.+)_(\d+)_(\d+)\.parquet", f.base_name)
                if m is None:
                    raise ValueError(f"not a chunk name: {f.base_name}")
                if self.prefix in (None, m[1]):
                    found.append(Chunk(f.path, int(m[2]), int(m[3])))
        chosen = [c for c in found if c.last >= self.low and c.first <= self.high]
        # Without a partition Spark would read one that is None.
        return sorted(chosen, key=lambda c: (c.first, c.path)) or [Chunk("", 0, -1)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not chunk.path:
            return
        wanted = to_arrow_schema(self.schema)
        fs, _ = _place(self.folder)
        with fs.open_input_file(chunk.path) as source:
            file = pyarrow.parquet.ParquetFile(source)
            have = set(file.schema_arrow.names)
            for batch in file.iter_batches(10_000, columns=[n for n in wanted.names if n in have]):
                # Chunks that lack columns, or hold them in other types, are cast.
                columns = [batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class ChunkSource(ds.DataSource):
    """Options: ``path``, the folder, and ``prefix`` of the files to read (all, without)."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> StructType:
        return OBSERVATIONS

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options["path"], self.options.get("prefix"), schema)


def read(spark: SparkSession, folder: str, prefix: str | None = None, schema: StructType = OBSERVATIONS) -> DataFrame:
    """The chunk files of a folder as one table of ``schema``. An empty or missing
    folder is an empty table, a file of another kind of name a ValueError."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
    reader = spark.read.format("chunks").schema(schema)
    return (reader.option("prefix", prefix) if prefix is not None else reader).load(folder)
