"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

The texts are packed once into blocks: for each block the distinct words' 64-bit
hashes, the words of each text as block-local numbers, and the training counts.
Everything after works on blocks, and every count covers all training texts.

1. **First classes.** Words that make up at least ``FREQUENT`` of the training
   tokens (so ``1 / FREQUENT`` words at most) are clustered by the exchange
   algorithm on the bigram counts among them: each word in turn moves to the class
   that raises the class-bigram likelihood most. Every other word joins the class
   whose gain is largest by the classes that stand before and after it.
2. **Exchange of the whole vocabulary**, ``ROUNDS`` times, distributed: every word's
   neighbours are counted by their classes over all blocks, and each word, taken
   out of its class, moves to the class that raises the likelihood most, by the
   class bigrams of the round before, which hold still while all words move.
3. **Counts** of words, classes and class transitions over all training texts.
4. **Scores.** ``P(word | before) = P(class | class before) * P(word | class)``.
   Transitions are smoothed towards the class frequencies; a class gives its
   share of once-seen words to the unknown word, which is a single type, as in the
   base, so the probabilities of the V known types and the unknown one add up to
   1. An unknown word leaves the class before it in place.

All counts are whole numbers summed before anything is decided, so classes and
scores don't depend on how the texts are dealt out. Hot words cost a row for each
block at most. Only tables of a bounded size reach
the driver: the frequent words, their bigram counts, and class counts.

Defined results: a null or empty text has one token, the end; rows without an id
are scored but not learned from; rows that repeat an id are scored each for
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import IS_SPACE, LOWER, buffers, per_document, runs, slices, span_hashes
from .common import mark, materialize, release, two_columns

MODULUS, HELD_OUT = 10, 0
BLOCK_BYTES = 8 << 20
#: Least share of the training tokens of a word that is clustered by exchange.
FREQUENT = 2.5e-4
CLASSES = 32
PASSES = 4
#: Exchange steps of the whole vocabulary.
ROUNDS = 1
#: Counts by which transitions are drawn towards the class frequencies.
TRANSITION_PRIOR = 20.0
#: Classes beyond those of the exchange: words without context, and the end.
LOOSE, END = CLASSES, CLASSES + 1
N_CLASSES = CLASSES + 2
#: What is counted of a word: a class before it, a class after it, its own class where it has one, itself beside itself.
CODES = 3 * N_CLASSES + 1
BESIDE_ITSELF = CODES - 1
UNKNOWN = 255
#: Words of all blocks that a bucket of hashes takes in, about; and the bytes of a hash that are kept beside its bucket.
BUCKET_WORDS = 1_000_000
LOW_BYTES = 7

BLOCK_SCHEMA = "block bigint, doc_ids array<bigint>, n_words array<int>, words binary, vocabulary binary, counts binary, train array<boolean>, n_types bigint, n_train bigint"


#: Bytes below which an array is stored as it is.
_SMALL = 256


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return b"\0" + raw if len(raw) < _SMALL else b"\1" + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    if data[:1] == b"\0":
        return np.frombuffer(data, dtype=kind, offset=1)
    return np.frombuffer(pa.decompress(data[9:], decompressed_size=int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True), dtype=kind)


def learned_from(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % MODULUS != HELD_OUT


def block_table(docs: DataFrame) -> DataFrame:
    """The texts of (doc_id, text) packed into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # blocks are written to a table, of which each partition has one version
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for first, last, part, cuts in slices(data, offsets, BLOCK_BYTES):
                starts, ends, per_doc = runs(~IS_SPACE[part], cuts)
                hashes = span_hashes(LOWER[part], starts, ends).view(np.int64)
                vocabulary, words, n = np.unique(hashes, return_inverse=True, return_counts=True)
                # the most common words get the smallest numbers, which pack best
                order = np.argsort(-n, kind="stable")
                rank = np.empty(len(order), dtype=np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                words, vocabulary = rank[words], vocabulary[order]
                ids = batch.column(0).slice(first, last - first)
                train = np.array([learned_from(i) for i in ids.to_pylist()], dtype=bool)
                counts = np.bincount(words[np.repeat(train, per_doc)], minlength=len(vocabulary)).astype(np.int32)
                columns = [[next(number)], [ids.to_pylist()], [per_doc.tolist()], [_pack(words)], [_pack(vocabulary)], [_pack(counts)], [train.tolist()], [len(vocabulary)], [int(counts.sum())]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.bool_()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "doc_ids", "n_words", "words", "vocabulary", "counts", "train", "n_types", "n_train"])

    return docs.mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """One block, unpacked."""

    def __init__(self, row: dict):
        self.name, self.ids = row["block"], row["doc_ids"]
        self.n_words = np.array(row["n_words"], dtype=np.int64)
        self.train = np.array(row["train"], dtype=bool)
        self.words = _unpack(row["words"], "uint32").astype(np.int64)
        self.vocabulary = _unpack(row["vocabulary"], "int64")
        self.counts = _unpack(row["counts"], "int32").astype(np.int64)

    def sequence(self, value: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(values of start, words, end of each training text, one after another; place of the words)."""
        own = np.repeat(self.train, self.n_words)
        sizes = self.n_words[self.train]
        total = int(sizes.sum()) + 2 * len(sizes)
        out = np.empty(total, dtype=np.int64)
        begins = np.cumsum(sizes + 2) - (sizes + 2)
        out[begins], out[begins + sizes + 1] = start, end
        inside = np.ones(total, dtype=bool)
        inside[begins] = inside[begins + sizes + 1] = False
        out[inside] = value[self.words[own]]
        return out, inside


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch.slice(row, 1).to_pylist()[0])


def _dealt(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of each stretch of the ascending hashes that have the same leading bits."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True)


def frequent_words(blocks: DataFrame, bits: int, n_tokens: int) -> np.ndarray:
    """Hashes, ascending, of the words that have FREQUENT of the training tokens; ``1 / FREQUENT`` at most."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _rows(batches):
            some = np.flatnonzero(block.counts)
            if not len(some):
                continue
            some = some[np.argsort(block.vocabulary.view(np.uint64)[some])]
            hashes, counts = block.vocabulary.view(np.uint64)[some], block.counts[some].astype(np.int32)
            rows = [(bucket, _low_bytes(hashes[a:b]), _pack(counts[a:b])) for bucket, a, b in _dealt(hashes, bits)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "words", "counts"])

    def often(table: pa.Table) -> pa.Table:
        words, where = np.unique(np.concatenate([_from_low_bytes(x) for x in table.column("words").to_pylist()]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([_unpack(x, "int32") for x in table.column("counts").to_pylist()])).astype(np.int64)
        top = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(64 - bits)
        low = np.uint64((1 << (64 - bits)) - 1)
        words = (words & low | top)[n >= FREQUENT * n_tokens]
        return pa.table({"word": pa.array(words.view(np.int64), pa.int64())})

    rows = blocks.mapInArrow(deal, "bucket long, words binary, counts binary").groupBy("bucket").applyInArrow(often, "word long").collect()
    return np.array(sorted(r[0] for r in rows), dtype=np.int64)


def bigram_counts(blocks: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the frequent words, the start (second last) and the end (last)."""
    m = len(frequent) + 2
    sent = blocks.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in _rows(batches):
            seq, _ = block.sequence(_position(block.vocabulary, sent.value), m - 2, m - 1)
            a, b = seq[:-1], seq[1:]
            some = (a >= 0) & (b >= 0) & (a != m - 1)
            pairs, n = np.unique(a[some] * m + b[some], return_counts=True)
            keys, place = np.unique(np.concatenate([keys, pairs]), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

    table = blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(m * m, dtype=np.int64)
    got = table.toArrow()  # a bounded number of pairs
    sent.destroy()
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(m, m)


def _position(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Place of each word among the frequent ones, or -1."""
    if not len(frequent):
        return np.full(len(words), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
    return np.where(frequent[at] == words, at, -1)


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, passes: int = PASSES) -> tuple[np.ndarray, list[float]]:
    """(class of each word, objective after each pass); start and end, the last two words, stay in classes of their own.

    The objective is sum n(c, d) log n(c, d) - sum left(c) log left(c) - sum right(d) log right(d).
    """
    m = len(bigrams) - 2
    k = n_classes + 2
    rank = np.argsort(-(bigrams.sum(axis=0) + bigrams.sum(axis=1))[:m], kind="stable")
    of = np.empty(m + 2, dtype=np.int64)
    of[rank] = np.arange(m) % n_classes
    of[m], of[m + 1] = n_classes, n_classes + 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    right_of = np.zeros((m + 2, k))  # counts of the classes after each word
    np.add.at(right_of.T, of, bigrams.T.astype(float))
    left_of = np.zeros((m + 2, k))
    np.add.at(left_of.T, of, bigrams.astype(float))
    table = np.zeros((k, k))
    np.add.at(table, of, right_of)
    score = lambda t: float(f(t).sum() - f(t.sum(axis=1)).sum() - f(t.sum(axis=0)).sum())
    history = [score(table)]
    for _ in range(passes):
        moved = 0
        for w in rank:
            a, own = of[w], float(bigrams[w, w])
            r, l = right_of[w].copy(), left_of[w].copy()
            r[a] -= own
            l[a] -= own
            t = table.copy()
            t[a] -= r
            t[:, a] -= l
            t[a, a] -= own
            # the word's neighbours in other classes take its counts whatever its class is
            rows, cols, n_r, n_l = t.sum(axis=1) + l, t.sum(axis=0) + r, r.sum() + own, l.sum() + own
            # gain of joining class c: its row takes r, its column l, its own cell both and the word after itself
            gain = (f(t + r) - f(t)).sum(axis=1) + (f(t + l[:, None]) - f(t)).sum(axis=0)
            d = np.diag(t)
            gain += f(d + r + l + own) - f(d + r) - f(d + l) + f(d)
            gain -= f(rows + n_r) - f(rows) + f(cols + n_l) - f(cols)
            b = int(np.argmax(gain[:n_classes]))
            if b != a and gain[b] > gain[a] + 1e-9:
                t[b] += r
                t[:, b] += l
                t[b, b] += own
                table, moved = t, moved + 1
                of[w] = b
                right_of[:, a] -= bigrams[:, w]
                right_of[:, b] += bigrams[:, w]
                left_of[:, a] -= bigrams[w]
                left_of[:, b] += bigrams[w]
        history.append(score(table))
        if not moved:
            break
    return of[:m], history


def _class_bigrams(bigrams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts of each class with the one after it; start is row LOOSE, end column END."""
    of = np.concatenate([classes, [LOOSE, END]]).astype(np.int64)
    table = np.zeros((N_CLASSES, N_CLASSES))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    return table


def _low_bytes(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]).tobytes()


def _from_low_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // LOW_BYTES, 8), dtype=np.uint8)
    out[:, :LOW_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, LOW_BYTES)
    return out.view("<u8").ravel()


def best_classes(keys: np.ndarray, amounts: np.ndarray, size: int, table: np.ndarray, moving: bool) -> np.ndarray:
    """The class of each word by the exchange gain against the classes' bigrams ``table``.

    ``keys`` ascend: word * CODES + code. A word with a class keeps it, unless
    all are ``moving``: then ``table`` holds its own counts, which are taken out.
    """
    out = np.full(size, LOOSE, dtype=np.uint8)
    step = 1 << 12
    for first in range(0, size, step):
        a, b = np.searchsorted(keys, [first * CODES, (first + step) * CODES])
        word, code = np.divmod(keys[a:b] - first * CODES, CODES)
        n = amounts[a:b].astype(np.float64)
        own = (code >= 2 * N_CLASSES) & (code < BESIDE_ITSELF)
        out[first + word[own]] = code[own] - 2 * N_CLASSES
        chosen = _moves(word, code, n, out[first : first + step].astype(np.int64), own, table, moving)
        out[first : first + step] = chosen
    return out


def _moves(word: np.ndarray, code: np.ndarray, n: np.ndarray, now: np.ndarray, own: np.ndarray, table: np.ndarray, moving: bool) -> np.ndarray:
    """The classes of some words after a step; ``now``: their classes before it."""
    f = lambda x: x * np.log(np.maximum(x, 1))
    w = len(now)
    has = np.zeros(w, dtype=bool)
    has[word[own]] = True
    around, itself = np.zeros((w, 2 * N_CLASSES)), np.zeros(w)
    near = code < 2 * N_CLASSES
    around[word[near], code[near]] = n[near]
    itself[word[code == BESIDE_ITSELF]] = n[code == BESIDE_ITSELF]
    at = np.flatnonzero(near & (moving | ~has[word]))
    free = np.unique(word[at])
    if not len(free):
        return now
    word, code, n = word[at], code[at], n[at]
    l, r = around[:, :N_CLASSES], around[:, N_CLASSES:]
    before, other = code < N_CLASSES, code % N_CLASSES
    # how often each class stands beside what a code stands for, without the word itself
    beside = np.where(before[:, None], table[other], table.T[other])
    # a class without words has no contexts to be like
    empty = (table.sum(axis=1) + table.sum(axis=0))[:CLASSES] == 0
    mine = np.zeros((w, N_CLASSES))
    if moving:
        mine[np.arange(w), now] = 1
        home = other == now[word]
        beside -= mine[word] * np.where(home, l[word, other] + r[word, other] + itself[word], n)[:, None]
        away = home[:, None] * (1 - mine[word]) * np.where(before[:, None], r[word], l[word])
        beside -= away
    starts = np.searchsorted(word, free)
    gain = np.add.reduceat((f(beside + n[:, None]) - f(beside))[:, :CLASSES], starts, axis=0)
    l, r, itself, mine = l[free], r[free], itself[free][:, None], mine[free]
    n_l, n_r = l.sum(axis=1, keepdims=True) + itself, r.sum(axis=1, keepdims=True) + itself
    d = np.diag(table) - mine * (l + r + itself)
    rows, cols = table.sum(axis=1) - mine * n_r, table.sum(axis=0) - mine * n_l
    if not moving:
        # the word's own counts are not yet in the rows and columns of its neighbours
        rows, cols = rows + l, cols + r
    l, r, d, rows, cols = (x[:, :CLASSES] for x in (l, r, d, rows, cols))
    gain += f(d + r + l + itself) - f(d + r) - f(d + l) + f(d)
    gain -= f(rows + n_r) - f(rows) + f(cols + n_l) - f(cols)
    gain[:, empty] = -np.inf
    if empty.all():
        return now
    best = gain.argmax(axis=1)
    here = np.minimum(now[free], CLASSES - 1)
    stays = moving & (now[free] < CLASSES) & (gain[np.arange(len(free)), best] <= gain[np.arange(len(free)), here] + 1e-9)
    out = now.copy()
    out[free] = np.where(stays, now[free], best)
    return out


CONTEXT_SCHEMA = "bucket long, block long, words binary, counts binary, sizes binary, codes binary, amounts binary"
#: The bucket of the rows that hold a block's counts of class bigrams.
BIGRAMS = -1


def _contexts(block: Block, known: np.ndarray, bits: int, every: bool) -> pa.RecordBatch:
    """A block's words with the classes beside them, dealt by the words' hashes, and its class bigrams if all words have classes.

    ``known``: the class of each word of the block's vocabulary, or -1. A word has
    ``sizes`` codes, each with an amount; see ``best_classes``.
    """
    size = len(block.vocabulary)
    rows: list[tuple] = []
    names, kinds = [c.split()[0] for c in CONTEXT_SCHEMA.split(", ")], [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    if size:
        hashes = block.vocabulary.view(np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.arange(size)
        seq, inside = block.sequence(known, LOOSE, END)
        # words that keep their class need no contexts
        numbers, _ = block.sequence(rank if every else np.where(known >= 0, -1, rank), -1, -1)
        place = np.flatnonzero(inside & (numbers >= 0))
        keys = [rank[known >= 0] * CODES + 2 * N_CLASSES + known[known >= 0]]
        for k, step in enumerate((-1, 1)):
            near, same = seq[place + step], numbers[place + step] == numbers[place]
            some = ~same if every else near >= 0
            keys.append(numbers[place[some]] * CODES + k * N_CLASSES + near[some])
            if every and k:
                keys.append(numbers[place[same]] * CODES + BESIDE_ITSELF)
        keys, amounts = np.unique(np.concatenate(keys), return_counts=True)
        word, codes = np.divmod(keys, CODES)
        sizes = np.bincount(word, minlength=size)
        hashes, counts = hashes[order], block.counts[order].astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        sizes, codes, amounts = sizes.astype(np.uint8), codes.astype(np.uint8), amounts.astype(np.int32)
        rows = [
            (bucket, block.name, _low_bytes(hashes[a:b]), *map(_pack, (counts[a:b], sizes[a:b], codes[upto[a] : upto[b]], amounts[upto[a] : upto[b]])))
            for bucket, a, b in _dealt(hashes, bits)
        ]
        if every:
            follows = seq[:-1] != END
            pairs = np.bincount(seq[:-1][follows] * N_CLASSES + seq[1:][follows], minlength=N_CLASSES * N_CLASSES)
            rows.append((BIGRAMS, block.name, b"", _pack(pairs.astype(np.int64)), b"", b"", b""))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def first_contexts(blocks: DataFrame, bits: int, frequent: np.ndarray, classes: np.ndarray) -> DataFrame:
    """Contexts of all words but the frequent ones, by neighbours that are frequent."""
    sent = blocks.sparkSession.sparkContext.broadcast((frequent, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes = sent.value
        for block in _rows(batches):
            at = _position(block.vocabulary, frequent)
            yield _contexts(block, np.where(at >= 0, classes[at] if len(classes) else -1, -1), bits, every=False)

    return blocks.mapInArrow(run, CONTEXT_SCHEMA)


def all_contexts(blocks: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Contexts of all words, by all their neighbours, and the class bigrams of each block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_contexts(block, _word_columns(block, right)["class"].astype(np.int64), bits, every=True) for block in map(Block, left.to_pylist())]
        return pa.Table.from_batches(parts)

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, CONTEXT_SCHEMA)


def summed_bigrams(contexts: DataFrame) -> np.ndarray:
    """The class bigrams of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CLASSES * N_CLASSES, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("counts").to_pylist():
                total += _unpack(packed, "int64")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    out = np.zeros(N_CLASSES * N_CLASSES)
    for r in contexts.where(F.col("bucket") == BIGRAMS).select("counts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(N_CLASSES, N_CLASSES)


def word_table(contexts: DataFrame, bigrams: np.ndarray, moving: bool = False) -> DataFrame:
    """(block, bucket, c, class, first): for a block's words of a bucket, by hash, the training counts, classes, and whether no earlier block has them.

    A word comes once a block, so a bucket's rows follow the number of blocks, not a word's occurrences.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        words = [_from_low_bytes(x) for x in table.column("words").to_pylist()]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        n, codes_each, codes, amounts = (np.concatenate([_unpack(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("counts", "int32"), ("sizes", "uint8"), ("codes", "uint8"), ("amounts", "int32")))
        types, first_at, word = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        c = np.bincount(word, weights=n, minlength=len(types)).astype(np.int64)
        # the same word and code of all blocks are one
        keys, place = np.unique(np.repeat(word, codes_each) * CODES + codes, return_inverse=True)
        of = best_classes(keys, np.bincount(place, weights=amounts, minlength=len(keys)), len(types), bigrams, moving)
        first = np.zeros(len(word), dtype=np.uint8)
        first[first_at] = 1
        ends = np.cumsum(sizes)
        parts = [(_pack(c[word[e - k : e]]), _pack(of[word[e - k : e]]), _pack(first[e - k : e])) for e, k in zip(ends, sizes, strict=True)]
        made = {name: pa.array([p[i] for p in parts], pa.binary()) for i, name in enumerate(("c", "class", "first"))}
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket")} | made)

    return contexts.where(F.col("bucket") != BIGRAMS).groupBy("bucket").applyInArrow(run, "block long, bucket long, c binary, class binary, first binary")


def _word_columns(block: Block, table: pa.Table) -> dict[str, np.ndarray]:
    """The columns of a block's rows of ``word_table``, in the order of the block's vocabulary."""
    # the buckets in order have the block's words by hash
    table = table.sort_by("bucket")
    order = np.argsort(block.vocabulary.view(np.uint64))
    out = {}
    for name, kind in (("c", "int64"), ("class", "uint8"), ("first", "uint8")):
        out[name] = np.zeros(len(order), dtype=kind)
        out[name][order] = np.concatenate([np.zeros(0, kind), *(_unpack(x, kind) for x in table.column(name).to_pylist())])
    return out


SEQUENCE_SCHEMA = "kind int, doc_id bigint, n_words bigint, n_known bigint, base double, emission double, train boolean, data binary"


def class_sequences(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Kind 0: a text with its classes, log10 sums and counts; kind 1: a block's share of the class counts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SEQUENCE_SCHEMA.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.binary()]
        out: list[list] = [[] for _ in names]
        for row in left.to_pylist():
            block = Block(row)
            own = _word_columns(block, right)
            c, of, first = own["c"].astype(np.float64), own["class"].astype(np.int64), own["first"].astype(bool)
            # counts of the words that this block is the first to have: types, once-seen types and tokens by class
            own = first & (c > 0)
            stats = np.concatenate([np.bincount(of[own], minlength=N_CLASSES), np.bincount(of[own & (c == 1)], minlength=N_CLASSES), np.bincount(of[own], weights=c[own], minlength=N_CLASSES)])
            known = c > 0
            log_c = np.log10(np.maximum(c, 1))
            sequence = np.where(known, of, UNKNOWN).astype(np.uint8)[block.words]
            sums = [per_document(x[block.words], block.n_words) for x in (known.astype(np.int64), np.log10(c + 0.1), log_c)]
            ends = np.cumsum(block.n_words)
            rows = [(1, None, 0, 0, 0.0, 0.0, False, stats.astype(np.float64).tobytes())]
            for k, doc_id in enumerate(block.ids):
                rows.append((0, doc_id, int(block.n_words[k]), int(sums[0][k]), float(sums[1][k]), float(sums[2][k]), bool(block.train[k]), _pack(sequence[ends[k] - block.n_words[k] : ends[k]])))
            for column, values in zip(out, zip(*rows, strict=True), strict=True):
                column += values
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, out, kinds, strict=True)})

    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(run, SEQUENCE_SCHEMA)


def _with_borders(sequence: np.ndarray) -> np.ndarray:
    """Class before the first word (LOOSE stands for the start), known classes, the end."""
    return np.concatenate([[LOOSE], sequence[sequence != UNKNOWN], [END]]).astype(np.int64)


def transition_counts(sequences: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts of class after class in the training texts, counts by class); both of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, stats = np.zeros(N_CLASSES * N_CLASSES), np.zeros(3 * N_CLASSES)
        for batch in batches:
            for kind, train, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "train", "data")), strict=True):
                if kind == 1:
                    stats += np.frombuffer(data, dtype=np.float64)
                elif train:
                    s = _with_borders(_unpack(data, "uint8"))
                    table += np.bincount(s[:-1] * N_CLASSES + s[1:], minlength=N_CLASSES * N_CLASSES)
        both = np.concatenate([table, stats])
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(both[some])], names=["at", "n"])

    rows = sequences.select("kind", "train", "data").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(N_CLASSES * N_CLASSES + 3 * N_CLASSES)
    for r in rows:
        out[r["at"]] = r["n"]
    return out[: N_CLASSES * N_CLASSES].reshape(N_CLASSES, N_CLASSES), out[N_CLASSES * N_CLASSES :].reshape(3, N_CLASSES)


class ClassModel:
    """Smoothed transitions and what a class gives to unknown words."""

    def __init__(self, transitions: np.ndarray, stats: np.ndarray):
        types, once, tokens = stats
        # the end is a word of its own class, seen once a training text
        self.end_count = float(transitions[:, END].sum())
        tokens = tokens.copy()
        tokens[END] += self.end_count
        self.train_tokens = float(tokens.sum())
        self.train_types = float(types.sum()) + (self.end_count > 0)
        frequency = (tokens + 0.1) / (tokens + 0.1).sum()
        self.log_transition = np.log10((transitions + TRANSITION_PRIOR * frequency) / (transitions.sum(axis=1, keepdims=True) + TRANSITION_PRIOR))
        # Good-Turing share of unseen words in each class, kept away from 0 and 1; the end class has none
        unseen = np.clip((once + 0.5) / (tokens + 1.0), 1e-6, 0.9)
        unseen[END] = 0.0
        empty = tokens == 0
        unseen[empty & (np.arange(N_CLASSES) != END)] = 1.0
        self.log_known = np.log10(np.maximum(1 - unseen, 1e-300)) - np.log10(np.maximum(tokens, 1))
        self.log_known[END] = 0.0
        self.log_unknown = np.log10(10**self.log_transition @ unseen)

    def score(self, sequence: np.ndarray, emission: float) -> float:
        """log10 probability; ``emission``: sum of log10 c over the known words."""
        s = _with_borders(sequence)
        total = self.log_transition[s[:-1], s[1:]].sum() + self.log_known[s[1:]].sum() + emission
        unknown = sequence == UNKNOWN
        if unknown.any():
            # the class before an unknown word is that of the last known one
            last = np.maximum.accumulate(np.where(unknown, -1, np.arange(len(sequence))))
            before = np.where(last[unknown] < 0, LOOSE, sequence[np.maximum(last[unknown], 0)])
            total += self.log_unknown[before].sum()
        return float(total)


def train(spark: SparkSession, docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and the class sequences of all texts."""
    since = mark(spark)
    blocks = materialize(spark, block_table(docs), "blocks")
    n_types, n_tokens = blocks.agg(F.sum("n_types"), F.sum("n_train")).first()
    bits = max(8, math.ceil((n_types or 0) / BUCKET_WORDS).bit_length())
    frequent = frequent_words(blocks, bits, n_tokens or 0)
    bigrams = bigram_counts(blocks, frequent)
    classes, _ = exchange(bigrams)
    words = word_table(first_contexts(blocks, bits, frequent, classes), _class_bigrams(bigrams, classes))
    for _ in range(ROUNDS):
        contexts = materialize(spark, all_contexts(blocks, words, bits), "contexts")
        words = word_table(contexts, summed_bigrams(contexts), moving=True)
    sequences = materialize(spark, class_sequences(blocks, words), "class-sequences")
    model = ClassModel(*transition_counts(sequences))
    release(spark, since, keep=[sequences])
    return model, sequences


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row by a model of the rows whose id isn't held out."""
    spark = docs.sparkSession
    model, sequences = train(spark, two_columns(docs, id_col, text_col))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        below = math.log10(m.train_tokens + 0.1 * (m.train_types + 1))
        for batch in batches:
            rows = batch.to_pylist()
            n = [r["n_words"] + 1 for r in rows]
            base = [r["base"] + math.log10(m.end_count + 0.1) - k * below for r, k in zip(rows, n, strict=True)]
            score = [m.score(_unpack(r["data"], "uint8"), r["emission"]) for r in rows]
            columns = [
                pa.array([r["doc_id"] for r in rows], pa.int64()),
                pa.array([r["doc_id"] is None or not r["train"] for r in rows], pa.bool_()),
                pa.array(n, pa.int64()),
                pa.array([r["n_known"] + (m.end_count > 0) for r in rows], pa.int64()),
                pa.array([int(m.train_tokens)] * len(rows), pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(score, pa.float64()),
                pa.array([10 ** min(300.0, -s / k) for s, k in zip(score, n, strict=True)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return sequences.where("kind = 0").mapInArrow(run, SCHEMA)
