"""Plumbing shared by the operators: input columns, folds, and joins of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, mark, materialize, release, scratch_path

__all__ = ["SPACE_CLASS", "discard", "fold", "free_name", "join_counted", "mark", "materialize", "read_table", "release", "scratch_path", "shuffle_partitions", "two_columns"]

#: Bytes that separate words in the contracts of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def two_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``; null texts become empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is hot with at least this share of the rows and HOT_LEAST rows, so 1 / HOT_SHARE keys are hot at most.
HOT_SHARE = 1e-3
HOT_LEAST = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, counts: str, n_rows: int, least: int | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) with a table of one row a key, whose column ``counts`` says how many of the left's ``n_rows`` rows have it.

    Keys of ``least`` rows or more, and a share of HOT_SHARE, are hot. Hot keys are joined by broadcast - their number is bounded by what makes
    them hot - and the others by shuffle, so no key's rows meet in one task.
    """
    least = max(HOT_LEAST if least is None else least, n_rows * HOT_SHARE)
    if n_rows < least:
        return left.join(right.drop(counts), key, how)
    # rows of two numbers, 1 / HOT_SHARE at most
    hot = F.broadcast(right.where(F.col(counts) >= least).drop(counts))
    cold = right.where(F.col(counts) < least).drop(counts)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, how))
