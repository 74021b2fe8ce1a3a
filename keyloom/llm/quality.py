"""Quality classifier: supervised subword embeddings, averaged, with a softmax.

A text's features are its words, its pairs of neighbouring words and its
character n-grams (as bytes, case kept), each hashed to one of ``BUCKETS``
learned vectors. Each kind of feature is averaged by itself, so that the many
character n-grams don't drown the words, and the mean of the kinds' averages goes
through a softmax. The vectors and the softmax
are trained by stochastic gradient descent in numpy, with a step for each
coordinate that shrinks with its past gradients, on a bounded sample of labelled
texts (``SAMPLE_ROWS``, read whole), by one task of an executor. To score, the softmax is folded into the
vectors: one number for each bucket, a table of fixed size, so a text's score is
the mean of table entries. Scoring is a map: nothing is shuffled.

Defined results: a null or empty text has no features and scores the bias alone;
without usable labels every text scores 1 (kept); rows that repeat an id are
scored each for itself; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytescan import IS_SPACE, buffers, mix, per_document, released, runs, slices, span_hashes
from .common import two_columns
from .training import held_out_flag, labelled_sample

BUCKETS = 1 << 16
GRAMS = (3, 5)
#: Kinds of features: words, pairs of words, and the character n-grams of each length.
KINDS = 2 + len(GRAMS)
WIDTH = 8
SAMPLE_ROWS = 4000
EPOCHS = 12
RATE = 0.3
MODULUS, HELD_OUT = 3, 1
#: Texts of each class below which nothing is learned.
LEAST = 3
#: Keeps the hashes of pairs apart from those of words.
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, features of each document), one kind after another."""
    starts, ends, per_doc = runs(~IS_SPACE[data], offsets)
    words = span_hashes(data, starts, ends)
    yield (words >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), per_doc
    # pairs of neighbours, within a document: hashed by how far apart the words' hashes are, so a word beside itself is one pair
    place = np.arange(len(words)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    second = np.flatnonzero(place > 0)
    pairs = mix(words[second] - words[second - 1] + _PAIR)
    yield pairs.astype(np.int64) & (BUCKETS - 1), np.maximum(per_doc - 1, 0)
    sizes = np.diff(offsets)
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= data[k : len(data) - n + 1 + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        # n-grams that cross from one document into the next don't count
        inside = np.maximum(sizes - n + 1, 0)
        keep = np.ones(len(h) + 1, dtype=np.int8)
        cross = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(cross, offsets[:-1] + inside, 1)
        np.add.at(cross, offsets[1:], -1)
        keep = np.cumsum(cross[: len(h)]) == 0
        yield (h[keep] & np.uint32(BUCKETS - 1)).astype(np.int64), inside


@dataclass
class QualityModel:
    """``table``: log-odds of each bucket; ``bias``: log-odds of a text without features."""

    table: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros(len(offsets) - 1)
        for buckets, per_doc in features(data, offsets):
            total += per_document(self.table[buckets], per_doc) / np.maximum(per_doc, 1)
        return total / KINDS + self.bias


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, width: int = WIDTH, seed: int = 7) -> QualityModel:
    """Each bag: (buckets, their shares of the text's features)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32)
    steps = np.full(BUCKETS, 1e-8, dtype=np.float32)
    out, bias = np.zeros((2, width), dtype=np.float32), np.zeros(2, dtype=np.float32)
    out_steps, bias_steps = np.full((2, width), 1e-8, dtype=np.float32), np.full(2, 1e-8, dtype=np.float32)
    for epoch in range(epochs):
        pace = np.float32(rate * (1 - epoch / epochs))
        for k in rng.permutation(len(bags)):
            buckets, share = bags[k]
            own = vectors[buckets]
            mean = share @ own
            z = out @ mean + bias
            z = np.exp(z - z.max())
            wrong = (z / z.sum()).astype(np.float32)
            wrong[labels[k]] -= 1
            back = out.T @ wrong
            grad = np.outer(wrong, mean)
            out_steps += grad * grad
            out -= pace * grad / np.sqrt(out_steps)
            bias_steps += wrong * wrong
            bias -= pace * wrong / np.sqrt(bias_steps)
            if len(buckets):
                steps[buckets] += share * share * float(back @ back) / width
                vectors[buckets] = own - (pace * share / np.sqrt(steps[buckets]))[:, None] * back
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from at most ``rows`` labelled texts outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, rows, "quality")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                shares = np.zeros(BUCKETS, dtype=np.float32)
                for buckets, n in features(data[a:b], np.array([0, b - a])):
                    shares += (np.bincount(buckets, minlength=BUCKETS) / (KINDS * max(1, int(n[0])))).astype(np.float32)
                used = np.flatnonzero(shares)
                out.append(used.astype("<i4").tobytes() + shares[used].astype("<f4").tobytes())
            checks = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(checks, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "label", "check", "bag"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # views of the batches; rows that repeat an id stand in the order of their texts' checksums
        got = [row for b in batches for row in zip(*(b.column(k).to_pylist() for k in ("doc_id", "check", "label")), b.column("bag"), strict=True)]
        got.sort(key=lambda row: row[:2])
        y = np.array([row[2] for row in got], dtype=np.int64)
        if min((y == 0).sum(), (y == 1).sum()) >= LEAST:
            raw = [row[3].as_buffer() for row in got]
            model = train([(np.frombuffer(x, "<i4", len(x) // 8), np.frombuffer(x, "<f4", offset=len(x) // 2)) for x in raw], y)
            yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()]), pa.array([model.bias])], names=["table", "bias"])

    bags = sample.select("doc_id", "label", "text").mapInArrow(released(bag), "doc_id long, label int, check long, bag binary")
    # one task holds ``rows`` bags of at most BUCKETS numbers each
    made = bags.repartition(1).mapInArrow(released(learn), "table binary, bias double").collect()
    if not made:
        return QualityModel(np.zeros(BUCKETS, dtype=np.float32), 30.0)
    return QualityModel(np.frombuffer(made[0]["table"], dtype=np.float32), made[0]["bias"])


SCHEMA = "doc_id long, score double, predicted int"


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*sent.value)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            z = np.concatenate([np.zeros(0), *(own.logits(part, cuts) for _, _, part, cuts in slices(data, offsets))])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = two_columns(docs, id_col, text_col).mapInArrow(released(run), SCHEMA)
    return scored.select("doc_id", held_out_flag(MODULUS, HELD_OUT).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected, with all their columns."""
    return filter_rows(docs, fit(docs, labels))


def filter_rows(docs: DataFrame, model: QualityModel) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*sent.value)
        for batch in batches:
            data, offsets = buffers(batch.column(place))
            z = np.concatenate([np.zeros(0), *(own.logits(part, cuts) for _, _, part, cuts in slices(data, offsets))])
            yield batch.filter(pa.array(z >= 0))

    return docs.mapInArrow(released(run), docs.schema)
