"""From raw documents to packed batches, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.

Null texts count as empty; the filters keep rows without an id unless their text
is rejected; repeated rows are judged alike, and exact dedup leaves one of them;
an empty table, or one without labels, passes through; other columns stay, whatever
their names: the stages name their own columns apart from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import digest_index, ngram_join, packing, quality, toxicity
from keyloom.llm.common import discard, mark, materialize, read_table, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return digest_index.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs)


def pack_by_length(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_by_length),
]

#: Two stages are learned models, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table of documents; what a stage has written goes when the next one's result is there."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = mark(spark)
        made = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since, keep=[made])
        if before is not None:
            discard(spark, before)
        docs = before = made
    return docs
