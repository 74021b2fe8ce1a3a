"""BPE encoding and decoding by speculation and verification.

For each new pre-token a greedy longest match proposes tokens. A proposal is the
exact encoding if every token and every adjacent pair of tokens is compatible,
that is, if the exact merges of their joint string give back just them: merges
inside a token don't depend on what stands beside it until one crosses the
border, and such a merge would show in the pair. All pairs of all proposals of a
batch are tested at once, as integers against a sorted table of known verdicts;
only words with a failing pair undergo exact merging.

Encoding is a map over the texts: nothing is shuffled and each text is whole.
Defined results: a null or empty text gives no ids and an empty decoded text;
special strings inside a text become their own ids, as in the library; rows that
repeat an id are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import two_columns
from .word_bpe import END, WordBpe, shared_vocabulary

#: Distinct words, and tested pairs, that a worker remembers.
MEMORY = 200_000
PAIR_MEMORY = 1_000_000
#: Texts, and bytes of them, encoded together, so that their new words are verified together.
GROUP = 256
GROUP_BYTES = 2 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.tokens = [""] * (max([*bpe.vocab.values(), *bpe.special.values()]) + 1)
        for token, i in [*bpe.vocab.items(), *bpe.special.items()]:
            self.tokens[i] = token
        self.names = list(map(str, range(len(self.tokens))))
        #: First two letters -> letters of the longest token that begins with them and doesn't end a word.
        self.reach: dict[str, int] = {}
        for token in bpe.vocab:
            if not token.endswith(END) and len(token) > self.reach.get(token[:2], 1):
                self.reach[token[:2]] = len(token)
        self.known: dict[str, tuple[str, int, str]] = {}
        self.pairs = np.zeros(0, dtype=np.int64)
        self.verdicts = np.zeros(0, dtype=bool)
        #: 1, 0, or -1 where it isn't known: whether a token that ends a word is a word's exact encoding.
        self.alone = np.full(len(self.tokens), -1, dtype=np.int8)
        self.counts = {"words": 0, "failed": 0}

    def propose(self, spelled: str) -> list[int] | None:
        """Longest match from the left; the last token carries the end mark."""
        vocab, longest, reach = self.bpe.vocab, self.bpe.max_length, self.reach
        text, n, at, out = spelled + END, len(spelled), 0, []
        while at < n:
            if n - at + len(END) <= longest and (i := vocab.get(text[at:])) is not None:
                out.append(i)
                return out
            # a token that doesn't end the word leaves at least its last letter
            for to in range(min(n - 1, at + reach.get(text[at : at + 2], 1)), at, -1):
                if (i := vocab.get(text[at:to])) is not None:
                    break
            else:
                return None
            out.append(i)
            at = to
        return out

    def _compatible(self, pair: int) -> bool:
        left, right = self.tokens[pair >> 32], self.tokens[pair & 0xFFFFFFFF]
        ends = right.endswith(END)
        return self.bpe.merge(left + (right[: -len(END)] if ends else right), ends) == [left, right]

    def check(self, pairs: np.ndarray) -> np.ndarray:
        """Verdict on each pair, (left id << 32) + right id."""
        distinct, where = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        seen = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.pairs)
        seen[inside] = self.pairs[at[inside]] == distinct[inside]
        verdict = np.zeros(len(distinct), dtype=bool)
        verdict[seen] = self.verdicts[at[seen]]
        new = distinct[~seen]
        verdict[~seen] = fresh = np.array([self._compatible(int(p)) for p in new], dtype=bool)
        if len(self.pairs) + len(new) > PAIR_MEMORY:
            self.pairs, self.verdicts = distinct, verdict.copy()
        elif len(new):
            spots = np.searchsorted(self.pairs, new)
            self.pairs, self.verdicts = np.insert(self.pairs, spots, new), np.insert(self.verdicts, spots, fresh)
        return verdict[where]

    def stands_alone(self, ids: np.ndarray) -> np.ndarray:
        """Does each token's own string merge into it? Found out once a token."""
        for i in np.unique(ids[self.alone[ids] < 0]).tolist():
            self.alone[i] = len(self.bpe.merge(self.tokens[i][: -len(END)])) == 1
        return self.alone[ids] > 0

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        spelled = [self.bpe.spell(w) for w in words]
        proposals = [self.propose(s) for s in spelled]
        flat = np.fromiter(chain.from_iterable(p for p in proposals if p), dtype=np.int64)
        sizes = np.fromiter((len(p) if p else 0 for p in proposals), dtype=np.int64, count=len(proposals))
        starts = np.cumsum(sizes) - sizes
        good = sizes > 0
        if len(flat) > 1:
            crosses = np.zeros(len(flat), dtype=bool)
            crosses[starts[1:][starts[1:] < len(flat)]] = True
            left = np.flatnonzero(~crosses[1:])
            owner = np.repeat(np.arange(len(words)), sizes)
            ok = self.check((flat[left] << 32) + flat[left + 1])
            good[owner[left[~ok]]] = False
        single = np.flatnonzero(good & (sizes == 1))
        good[single] = self.stands_alone(flat[starts[single]])
        vocab, merge = self.bpe.vocab, self.bpe.merge
        self.counts["words"] += len(words)
        self.counts["failed"] += int((~good).sum())
        return [p if g else [vocab[t] for t in merge(s)] for p, g, s in zip(proposals, good, spelled, strict=True)]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > MEMORY:
            self.known.clear()
        new, known, names, tokens = list(words), self.known, self.names, self.tokens
        for word, ids in zip(new, self.encode_words(new), strict=True):
            known[word] = (names[ids[0]], 1, tokens[ids[0]]) if len(ids) == 1 else (" ".join([names[i] for i in ids]), len(ids), " ".join([tokens[i] for i in ids]))

    def encode_many(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by a space, their number, decoded text) of each text."""
        bpe, known = self.bpe, self.known
        split = [[(k % 2, part if k % 2 else bpe.words(part)) for k, part in enumerate(bpe.segments(t))] for t in texts]
        needed: set[str] = set()
        for parts in split:
            for special, words in parts:
                if not special:
                    needed.update(words)
        missing = needed.difference(known)
        if missing:
            if len(known) + len(missing) > MEMORY:
                known.clear()
                missing = needed
            self._learn(missing)
        for parts in split:
            entries = []
            for special, words in parts:
                if special:
                    entries.append((self.names[bpe.special[words]], 1, words))
                else:
                    entries += map(known.__getitem__, words)
            ids, n, tokens = zip(*entries, strict=True) if entries else ((), (), ())
            yield " ".join(ids), sum(n), " ".join(tokens)


def decode(bpe: WordBpe, ids: list[int]) -> str:
    """What a tokenizer without a decoder gives: its tokens joined by spaces."""
    names = {i: t for t, i in [*bpe.vocab.items(), *bpe.special.items()]}
    return " ".join(names[i] for i in ids)


_codecs: dict[int, Codec] = {}


def codec_of(content: bytes) -> Codec:
    if (key := hash(content)) not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared_vocabulary(content))
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: doc_id, ids, n_tokens, decoded (strings)."""
    return _encode(docs, vocabulary, id_col, text_col, "doc_id long, ids string, n_tokens long, decoded string", lambda ids, n, text: (ids, n, text))


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded text of every row."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _encode(docs, vocabulary, id_col, text_col, SCHEMA, lambda ids, n, text: (n, sha(ids), sha(text)))


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of GROUP rows and GROUP_BYTES at most, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, min(first + GROUP, int(np.searchsorted(ends, before + GROUP_BYTES, side="right"))))
        yield batch.slice(first, last - first)
        first = last


def _encode(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, schema: str, shape) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        # what is remembered of words has no cycles: looking for them costs time only
        gc.disable()
        try:
            for batch in batches:
                for part in _groups(batch):
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    rows = [shape(*r) for r in codec.encode_many(texts)]
                    arrays = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=columns)
        finally:
            gc.enable()

    return two_columns(docs, id_col, text_col).mapInArrow(encode, schema)
