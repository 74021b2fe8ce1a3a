"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the
normalised text (each run of ``[\\x20\\x09-\\x0D]`` replaced by one space). A new
batch is reduced to one row per digest, anti-joined to the index by a sort-merge
join that reads the index in place, without moving it, and what is new is
appended. Texts never enter a shuffle: only digests and ids do.

Defined results: null texts count as empty; of equal texts the smallest id
stays, null ids last; a row that repeats both id and text is a copy of the first
such row; an empty table gives an empty result; all other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, join_counted, mark, materialize, release, scratch_path, shuffle_partitions, two_columns

INDEX_SCHEMA = "digest binary, keep_id bigint"


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE_CLASS, " ").cast("binary"), 256))


class DigestIndex:
    """A persistent set of digests; ``path`` None keeps it in the warehouse."""

    def __init__(self, spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.table, self.path = spark, table, path
        self.buckets = buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], INDEX_SCHEMA))

    def _append(self, rows: DataFrame) -> None:
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, keyed: DataFrame) -> None:
        """Add the digests of ``keyed`` (digest, doc_id) that the index lacks."""
        # written out, or the optimiser puts the anti-join below the aggregation, where a hot digest's rows would meet
        firsts = materialize(self.spark, keyed.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "batch-digests")
        fresh = firsts.join(self.read().hint("merge"), "digest", "left_anti")
        # one sorted file for each bucket: the rows arrive dealt by digest, as many ways as there are buckets
        self._append(fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest"))


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return two_columns(docs, id_col, text_col).select(digest_of(F.col("text")).alias("digest"), "doc_id")


def verdicts(index: DigestIndex, keyed: DataFrame, n_rows: int) -> DataFrame:
    """One row per row of ``keyed`` (digest, doc_id, and the row's number): doc_id, keep_id, group_size, kept, digest.

    ``n_rows`` is the number of rows of ``keyed``. Large groups of copies are
    joined by broadcast, so none lands in one task.
    """
    # of rows that repeat id and text, one is the row that stays
    row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    sizes = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), row.alias("_first"))
    sizes = materialize(index.spark, sizes, "digest-sizes")
    known = materialize(index.spark, sizes.join(index.read().hint("merge"), "digest"), "digest-groups")
    joined = join_counted(keyed, known.withColumn("_rows", F.col("group_size")), "digest", "_rows", n_rows)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("_first"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, index: DigestIndex | None = None
) -> DataFrame:
    """Deduplicate ``docs`` through an index that takes them in ``batches`` of ascending id.

    Ascending batches make the first row that the index sees of a text the one
    with the smallest id. An index that is given keeps what it holds: texts that
    it already has are dropped in favour of the row it recorded.
    """
    spark = docs.sparkSession
    own = index is None
    if own:
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", scratch_path(spark, "digest-index"))
    keyed = materialize(spark, keyed_documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "digests")
    n_rows = keyed.count()
    cuts = keyed.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    low: float | None = None
    for high in [*cuts, None]:
        batch = keyed
        if low is not None:
            batch = batch.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        index.ingest(batch)
        low = high
    found = verdicts(index, keyed, n_rows)
    if own:
        # what it knows of these rows is written by now
        spark.sql(f"DROP TABLE {index.table}")
    return found


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows stay once.

    The survivors are a list of (id, digest); texts move once, to meet it.
    """
    spark = docs.sparkSession
    since = mark(spark)
    verdict = materialize(spark, deduplicate(docs), "verdicts")
    release(spark, since, keep=[verdict])
    own, key, kept_id = (free_name(docs, name) for name in ("_keyloom_digest", "_keyloom_kept", "_keyloom_id"))
    stay = verdict.where("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(key))
    marked = docs.withColumn(own, digest_of(F.coalesce(F.col("text"), F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(key))
    kept = marked.join(stay, same, "left_semi")
    repeats = verdict.groupBy("doc_id", "digest").count().where("count > 1")
    return (kept.dropDuplicates(["doc_id", own]) if not repeats.isEmpty() else kept).drop(own)
