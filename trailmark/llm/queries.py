"""One query for each operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import ann_partition, bpe, chat_format, collocations, fill_middle, jaccard_tree, media_png, mixing, packing, quality_gam, secret_trigram, token_counts, url_filter
from trailmark.llm.common import table

#: The conversation that op3 adds: control strings inside texts.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


#: Three words and nine tenths.
OP2 = jaccard_tree.Options(words=3, num=90, den=100)


def op2_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tree.join(table(spark, sf_dir, "documents"), options=OP2)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(probe)
    return chat_format.digests(chat_format.format_turns(turns))


def op4_ann_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_partition.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_png.media(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_secret_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_trigram.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, lambda k: F.when(k == F.lit(r.kind), 1)))).cast("long").alias(f"n_{r.kind}") for r in secret_trigram.BASE]
    return found.select("doc_id", *counts, secret_trigram.base_digest(F.col("spans")).alias("base_sha256"), secret_trigram.digest(F.col("spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.recount(token_counts.build(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op11_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_middle.restore(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_gam, op2_jaccard_tree, op3_chat_format, op4_ann_partition, op5_media_png, op6_secret_trigram, op7_mixing, op8_url_filter, op9_token_counts, op10_packing, op11_bpe_speculate, op12_collocations, op13_fill_middle)}

ORACLE: dict[str, str] = {
    "op2_jaccard_tree": jaccard_tree.oracle_sql(OP2.words, OP2.num, OP2.den),
    "op7_mixing": mixing.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
    "op3_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
ordered AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(role) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS formatted
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before, '') IN ('user', 'tool')
    WHEN 'tool' THEN coalesce(before, '') IN ('assistant', 'tool') ELSE false END
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM ordered GROUP BY conv_id
""",
}
