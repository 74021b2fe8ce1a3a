"""Packing by length: optimal buckets from the global histogram, then token-budget batches.

The length of a text is its number of words ``[^\\x20\\x09-\\x0D]+``, at least 1.
Every length is counted exactly. The histogram has a row for each different
length; texts of d different lengths have d (d + 1) / 2 words at least, so 100 TB
of text, some 2e13 words, have fewer than 6.4 million rows of two numbers. Dynamic
programming over them picks at most ``n_buckets`` bounds with the least total
padding (of equal plans, the one whose
last cuts are leftmost). Inside each bucket the texts stand in the order of
the MD5 of their id and fill batches of ``budget // bound`` rows (at least one).

Defined results: null or empty texts have length 1; ties of the order stand by
id; an empty table gives an empty result; all other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, two_columns

N_BUCKETS = 8
TOKEN_BUDGET = 65_536
#: Leading hex digits of the MD5 that deal a bucket's rows out; 16**3 shares at most.
SHARE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words, at least 1."""
    squeezed = F.trim(F.regexp_replace(text, SPACE_CLASS, " "))
    return F.greatest(F.lit(1), F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Bounds, ascending, that minimise sum(count * (bound - length)); lengths ascend.

    dp[k][i] is the least padded total of the first i lengths in k buckets. The
    leftmost best cut moves right with i, so each layer is filled by divide and
    conquer in n log n steps. Fewer buckets are used where more don't pay.
    """
    n = len(lengths)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    lengths = lengths.astype(np.int64)
    best = total[1:] * lengths  # one bucket
    cuts: list[np.ndarray] = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(n_buckets, n)):
        nxt, cut = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # cut c: the last bucket holds lengths c..i; c = 0 means that a single bucket does it all
        before = np.concatenate([[0], best])
        stack = [(0, n - 1, 0, n - 1)]
        while stack:
            lo, hi, c_lo, c_hi = stack.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            c = np.arange(c_lo, min(c_hi, i) + 1)
            cost = before[c] + (total[i + 1] - total[c]) * lengths[i]
            at = int(np.argmin(cost))
            nxt[i], cut[i] = cost[at], c[at]
            stack += [(lo, i - 1, c_lo, int(c[at])), (i + 1, hi, int(c[at]), c_hi)]
        best = nxt
        cuts.append(cut)
    bounds, i = [], n - 1
    for cut in reversed(cuts):
        bounds.append(int(lengths[i]))
        i = int(cut[i]) - 1
        if i < 0:
            break
    return bounds[::-1]


def length_histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different lengths, ascending, and how many texts have each."""
    rows = lengths.groupBy("n_words").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_words")
    return np.array(rows.column("n_words"), dtype=np.int64), np.array(rows.column("n"), dtype=np.int64)


def pack(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, bucket_bound, batch_id, slot, padding.

    ``batch_id`` counts from 0 inside a bucket; ``slot`` from 0 inside a batch.
    """
    spark = docs.sparkSession
    lengths = two_columns(docs, id_col, text_col).select("doc_id", word_count(F.col("text")).alias("n_words"))
    lengths = materialize(spark, lengths, "lengths")
    bounds = optimal_bounds(*length_histogram(lengths), n_buckets)
    bound = F.lit(None).cast("long")
    for b in reversed(bounds):
        bound = F.when(F.col("n_words") <= b, F.lit(b).cast("long")).otherwise(bound)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    placed = lengths.withColumns({"bucket_bound": bound, "_order": order}).withColumn("_share", F.substring("_order", 1, SHARE_DIGITS))
    # position in the bucket: rows of earlier shares, then the row's place in its own share
    shares = placed.groupBy("bucket_bound", "_share").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("bucket_bound").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select("bucket_bound", "_share", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    # at most n_buckets * 16**SHARE_DIGITS rows
    placed = placed.join(F.broadcast(starts), ["bucket_bound", "_share"])
    own = Window.partitionBy("bucket_bound", "_share").orderBy("_order", "doc_id", "n_words")
    position = F.col("_start") + F.row_number().over(own) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_bound"))).cast("long")
    return placed.withColumn("_position", position).select(
        "doc_id",
        "n_words",
        "bucket_bound",
        F.floor(F.col("_position") / rows).cast("long").alias("batch_id"),
        (F.col("_position") % rows).cast("long").alias("slot"),
        (F.col("bucket_bound") - F.col("n_words")).alias("padding"),
    )
