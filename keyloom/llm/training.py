"""The bounded sample of labelled rows that the two classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, shuffle_partitions, two_columns


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, rows: int, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of at most ``rows`` labelled ids outside the held-out fold: doc_id, text, label.

    The ids with the smallest hashes are taken, and of an id with several texts
    the two with the smallest and the largest hash, so the same rows come back
    at each run, however many rows repeat an id. A label other than 0 or 1, or a null id, is no label.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held_out))
    texts = two_columns(docs, id_col, text_col)
    # labels of rows that the input lacks don't use up the sample
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = materialize(docs.sparkSession, chosen, f"{name}-ids")
    # ``rows`` rows of two integers at most
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("_pick", F.struct(F.xxhash64("text").alias("hash"), "text"))
    # each task keeps two texts of an id before any is moved
    ends = found.groupBy("doc_id", "label").agg(F.min("_pick").alias("_low"), F.max("_pick").alias("_high"))
    sample = ends.select("doc_id", F.explode(F.array_distinct(F.array("_low.text", "_high.text"))).alias("text"), "label")
    # dealt out evenly: the texts are few, but long ones cost much to read
    return materialize(docs.sparkSession, sample.repartition(shuffle_partitions(docs.sparkSession), "doc_id"), f"{name}-sample")


def held_out_flag(modulus: int, held_out: int):
    """Is the row in the held-out fold? Rows without an id count as held out: none was learned from."""
    return F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(True))
