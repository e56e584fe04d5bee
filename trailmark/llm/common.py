"""Shared helpers of the llm operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trailmark.sources.tables import cut, shared_dir

#: The code points that end a word in the word-counting contracts.
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller zero-copy batches, so that few long texts are held decoded at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = 1 << 20, column: int = 1, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Zero-copy batches of at most ``most`` bytes of a text column, or of one row."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        upto, at = size.cumsum(), 0
        while at < b.num_rows:
            done = upto[at - 1] if at else 0
            end = min(max(at + 1, int(upto.searchsorted(done + most, side="right"))), at + rows, b.num_rows)
            yield b.slice(at, end - at)
            at = end


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on an Arrow batch of this session has at most ``rows`` rows.

    A batch of texts is held several times, by the executor and by its Python
    workers; Spark's 10,000 texts are tens of megabytes each time.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def tidy() -> None:
    """Memory that earlier tasks of this Python worker used goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_of(df: DataFrame, name: str = "text"):
    """The text column as a string that is never null (null counts as empty)."""
    return F.coalesce(F.col(name).cast(StringType()), F.lit(""))


def word_count(text):
    """Number of maximal runs of bytes outside U+0020 and U+0009..U+000D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["WORD", "by_bytes", "cut", "shared_dir", "slices", "small_batches", "table", "text_of", "tidy", "word_count"]
