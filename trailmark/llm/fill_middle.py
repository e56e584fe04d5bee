"""Fill-in-the-middle transformation by SQL inside the tasks.

Each task opens an embedded SQL engine, registers a slice of its Arrow batch as
a view and asks for the transformed rows as Arrow; no row passes through Python.
A text is cut into its code points, a hash of its id sets two cuts and the form:
plain, or prefix, suffix, middle (psm), or suffix, prefix, middle (spm), each
part after its mark.

It is a map; nothing shuffles. A slice has at most ``SLICE`` bytes of text, or
one row: a task needs some sixty bytes for each code point of its longest text.
``restore`` undoes it in column expressions: a text that holds a mark stays
plain, and no mark can arise where parts meet, so the marks of an output are
its own.

Edge cases: null and empty texts are plain and empty; texts that hold a mark are
plain; a null id hashes as no digits; repeated rows (and rows with equal ids)
are transformed alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import by_bytes, text_of

#: Bytes of text that the SQL engine gets at a time.
SLICE = 1 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Options:
    """Marks, the salt before the id in the hash, and of a hundred: texts that are
    transformed, and of these the ones in the order suffix, prefix, middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    salt: str = "1:"
    transformed: int = 90
    suffix_first: int = 20

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(options: Options) -> str:
    """The task's SQL over the view ``batch`` (doc_id, text)."""
    p, s, m = map(_quoted, options.marks)
    draw = [f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4)]
    return f"""
WITH hashed AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS units,
    sha256({_quoted(options.salt)} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
drawn AS (SELECT doc_id, text, units, len(units) AS n, {", ".join(draw)} FROM hashed),
placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {options.transformed} THEN 'plain'
      WHEN h4 % 100 < {options.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle,
    array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle
    ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
FROM parts"""


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Options = Options()) -> DataFrame:
    """``doc_id, n`` (code points), ``form, prefix_chars, middle_chars`` (null if plain), ``output``."""
    if len(set(options.marks)) < 3 or any(not (x[:1] == "<" and x[-1:] == ">" and not set("<>") & set(x[1:-1])) for x in options.marks):
        raise ValueError("marks are three different strings like <P>")
    sql = transform_sql(options)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        engine = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})
        kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        try:
            for part in by_bytes(batches, SLICE):
                engine.register("batch", pa.Table.from_batches([part]))
                out = engine.sql(sql).to_arrow_table()
                engine.unregister("batch")
                yield from out.cast(kinds).to_batches()
        finally:
            engine.close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(task, SCHEMA)


def restore(output: Column, form: Column, options: Options = Options()) -> Column:
    """The text that was transformed."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in options.marks), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


#: The query's rows by other functions than the operator's.
ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS z, CAST('0x' || h[25:32] AS BIGINT) % 100 AS w FROM drawn),
formed AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substring(text, 1, a) || '<S>' || substring(text, b + 1) || '<M>' || substring(text, a + 1, b - a)
    ELSE '<S>' || substring(text, b + 1) || '<P>' || substring(text, 1, a) || '<M>' || substring(text, a + 1, b - a) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM formed
"""
