"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder and gives it, read again, to the next
stage. All but the last stage return the columns of ``documents``.

In every stage an empty table gives no rows, further columns are kept (by
``packed`` ignored) whatever their names, and a null id, language or source is a
value like another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import jaccard_tree, mixing, packing, quality_gam, secret_trigram
from trailmark.llm.common import cut, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects (score under 0.5) go.

    A null text is judged as an empty one; repeated rows are judged alike; texts
    are read whole.
    """
    small_batches(spark)
    return quality_gam.keep(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one of the smallest id stays.

    Documents without words (null, empty or white space) all stay, as they are
    linked with nothing. Of rows that repeat an id and text one stays, of rows of
    one id and several texts in a group the one of the smallest text hash.
    """
    small_batches(spark)
    return jaccard_tree.keep_one(docs, options=jaccard_tree.Options(words=5, num=80, den=100))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked and ``n_chars`` is counted anew.

    Every row stays, repeated ones too; a null text stays null, a text without
    secrets as it is.
    """
    small_batches(spark)
    return secret_trigram.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: never, once or twice.

    Null and empty texts have no words: they count for no target and come as their
    hash falls. Repeated rows are told apart; a null source is one of its own.
    """
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of 2048 tokens.

    Null and empty texts are the end token alone; repeated rows are packed each;
    very long texts become many windows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packed", packed),
]

#: SQL has neither the quality model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
