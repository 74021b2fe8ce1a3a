"""Token counts by the whole-token shortcut.

Before the job, the driver proves which strings of the vocabulary encode alone
as one token: the exact merges of the string must give back that single token.
A pre-token among them counts one; only the others are merged, each distinct one
once for as long as the worker remembers it. Counting is a map over the texts:
nothing is shuffled and each text is read whole.

Defined results: a null or empty text has no bytes and no tokens; special
strings inside a text count as one token, as the library counts them; rows that
repeat an id are counted each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import two_columns
from .word_bpe import END, WordBpe, shared_vocabulary

LIMIT = 2048
#: Distinct words that a worker remembers.
MEMORY = 300_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_whole_tokens(content: bytes) -> list[str]:
    """Pre-tokens, as they stand in a text, that are one token of the vocabulary."""
    bpe = WordBpe(content)
    byte = {letter: b for b, letter in bpe.letters.items()}
    proved = []
    for token in bpe.vocab:
        if not token.endswith(END) or token == END:
            continue
        spelled = token[: -len(END)]
        if bpe.merge(spelled) != [token]:
            continue
        try:
            word = bytes(byte[c] for c in spelled).decode()
        except UnicodeDecodeError:
            continue
        proved.append(word)
    return proved


class TokenCounter:
    def __init__(self, content: bytes, whole: list[str]):
        self.bpe, self.whole = shared_vocabulary(content), dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.bpe.segments(text)):
            if k % 2:
                total += 1
                continue
            words = self.bpe.words(part)
            try:
                total += sum(map(self.known.__getitem__, words))
            except KeyError:
                total += self._count_new(words)
        return total

    def _count_new(self, words: list[str]) -> int:
        if len(self.known) > MEMORY:
            self.known = dict(self.whole)
        known, bpe = self.known, self.bpe
        for word in [w for w in set(words) if w not in known]:
            known[word] = len(bpe.merge(bpe.spell(word)))
        return sum(map(known.__getitem__, words))


_counters: dict[int, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; ``vocabulary``: path of the JSON file, read by the driver."""
    content = Path(vocabulary).read_bytes()
    sent = docs.sparkSession.sparkContext.broadcast((content, prove_whole_tokens(content)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, whole = sent.value
        if (key := hash(data)) not in _counters:
            _counters.clear()
            _counters[key] = TokenCounter(data, whole)
        counter = _counters[key]
        for batch in batches:
            sizes, counts = [], []
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(counter.count(text))
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return two_columns(docs, id_col, text_col).mapInArrow(count, SCHEMA)
