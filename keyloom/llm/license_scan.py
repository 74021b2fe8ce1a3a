"""License scans: exact notices, and fuzzy ones found from exact seeds.

Words are ``[0-9a-z]`` and characters beyond ASCII, after A-Z are lowered. The
base places are where a base phrase's words stand one after another. The fuzzy
search allows a notice of n letters up to k edits: cut into k + 1 pieces, any
place within k edits must hold one piece unchanged (pigeonhole), so exact piece
hits locate the candidates, and the ``regex`` library's bounded-error matching
verifies a window of bounded size around each and reports its span and edits. The
words that tell a licence from others (``mit``, ``2``) must stand unchanged. Of
matches of one notice that overlap, those with the fewest edits count; a match
that lies inside one of a longer notice doesn't. The search runs over the words of
the whole text joined by single spaces, in time that grows with the text.

Defined results: a null or empty text has no words and no labels; rows that
repeat an id are scanned each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytescan import IS_ALNUM, buffers, runs, slices
from .common import two_columns

#: Phrases whose exact places are the base.
BASE_NOTICES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice -> (label, edits allowed, words that must stand unchanged).
FUZZY_NOTICES = {
    "under the mit license": ("mit", 2, "mit"),
    "apache license version 2": ("apache-2", 2, "apache 2"),
    "gnu general public license": ("gpl", 2, ""),
    "gnu lesser general public license": ("lgpl", 2, ""),
    "mozilla public license": ("mpl", 2, "mozilla"),
    "creative commons attribution": ("cc-by", 2, ""),
    "creative commons attribution noncommercial": ("cc-by-nc", 3, ""),
    "creative commons attribution sharealike": ("cc-by-sa", 3, ""),
    "redistribution and use in source and binary forms": ("bsd", 3, ""),
    "cc by nc": ("cc-by-nc", 0, ""),
    "cc by sa": ("cc-by-sa", 0, ""),
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Hit:
    """A notice found: the label, its words (from 0, the end excluded), where it stands in the joined words, and its edits."""

    label: str
    notice: str
    first_word: int
    end_word: int
    start: int
    end: int
    edits: int


class LicenseScanner:
    def __init__(self, base: dict[str, str] = BASE_NOTICES, fuzzy: dict[str, tuple[str, int, str]] = FUZZY_NOTICES):
        self.base = [(label, f" {phrase} ".encode()) for phrase, label in base.items()]
        self.fuzzy = []
        for notice, (label, edits, fixed) in fuzzy.items():
            step = len(notice) / (edits + 1)
            cuts = [round(step * k) for k in range(edits + 2)]
            pieces = [(notice[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
            # (?b): the best match; word borders, so that a notice is not found inside longer words
            pattern = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice)}){{e<={edits}}}(?![^ ])")
            self.fuzzy.append((notice, label, edits, pieces, fixed.split(), pattern))

    @staticmethod
    def words(raw: bytes) -> bytes:
        """The words joined, and enclosed, by single spaces."""
        return b" " + _GAP.sub(b" ", raw.lower()).strip(b" ") + b" "

    @staticmethod
    def gaps(joined: bytes) -> np.ndarray:
        """Where the spaces of joined words stand: the k-th comes before word k."""
        return np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)

    def exact(self, joined: bytes, gaps: np.ndarray) -> list[tuple[str, int]]:
        """(label, index of the first word) of every base place."""
        found = []
        for label, phrase in self.base:
            at = joined.find(phrase)
            while at >= 0:
                found.append((label, int(np.searchsorted(gaps, at))))
                at = joined.find(phrase, at + 1)
        return found

    def hits(self, joined: bytes, gaps: np.ndarray | None = None) -> list[Hit]:
        """Every notice within its edits, once for each place."""
        gaps = self.gaps(joined) if gaps is None else gaps
        found: list[Hit] = []
        for notice, label, edits, pieces, fixed, pattern in self.fuzzy:
            matches: dict[tuple[int, int], int] = {}
            for low, high in self._windows(joined, len(notice), edits, pieces):
                text = joined[low:high].decode("utf-8", "replace")
                if not set(fixed) <= set(text.split()):
                    continue
                for m in self._places(pattern, text):
                    if set(fixed) <= set(m.group().split()):
                        start = low + len(text[: m.start()].encode())
                        matches.setdefault((start, start + len(m.group().encode())), sum(m.fuzzy_counts))
            best = sorted((e, a, b) for (a, b), e in matches.items())
            for e, a, b in _apart(best):
                first, last = np.searchsorted(gaps, [a, b - 1], side="right") - 1
                found.append(Hit(label, notice, int(first), int(last) + 1, a, b, e))
        return self._outermost(found)

    @staticmethod
    def _outermost(found: list[Hit]) -> list[Hit]:
        """The hits that lie inside no other hit's words."""
        out: list[Hit] = []
        end = -1
        for h in sorted(found, key=lambda h: (h.first_word, -h.end_word, h.edits, h.label)):
            if h.end_word > end:
                out.append(h)
                end = h.end_word
        return out

    @staticmethod
    def _places(pattern: regex.Pattern, text: str) -> list[regex.Match]:
        """The best match, and likewise what lies before and behind it."""
        found, todo = [], [(0, len(text))]
        while todo:
            low, high = todo.pop()
            m = pattern.search(text, low, high)
            if m and m.group().strip():
                found.append(m)
                todo += [(low, m.start()), (m.end(), high)]
        return found

    @staticmethod
    def _windows(joined: bytes, n: int, edits: int, pieces: list[tuple[bytes, int]]) -> set[tuple[int, int]]:
        """Where a match could lie, for each seed: whole words, and not many more than the notice has."""
        found = set()
        slack = 2 * edits + 2
        for piece, offset in pieces:
            at = joined.find(piece)
            while at >= 0:
                # words that are cut off here lie outside any match: it begins at most ``edits`` before the notice would
                first, last = max(0, at - offset - slack), min(len(joined), at - offset + n + slack)
                low = joined.find(b" ", first, last) + 1
                high = joined.rfind(b" ", first, last)
                if 0 < low < high:
                    found.add((low, high))
                at = joined.find(piece, at + 1)
        return found

    def scan(self, raw: bytes) -> tuple[int, int | None, int | None, str, str, float, str]:
        joined = self.words(raw)
        gaps = self.gaps(joined)
        base = self.exact(joined, gaps)
        hits = self.hits(joined, gaps)
        places = [w for _, w in base]
        own = {label for label, _ in base}
        best = max([1.0 - h.edits / len(h.notice) for h in hits], default=0.0)
        return (
            len(base),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(own)),
            ",".join(sorted(own | {h.label for h in hits})),
            1.0 if base else best,
            ",".join(f"{h.first_word}-{h.end_word}:{h.label}:{h.edits}" for h in hits),
        )


def _apart(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end), in this order, those that overlap no earlier one; they come back by their start."""
    taken: list[tuple[int, int, int]] = []
    for e, a, b in matches:
        at = bisect_left(taken, (a, b, 0))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            insort(taken, (a, b, e))
    return [(e, a, b) for a, b, e in taken]


def find_notices(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice found: doc_id, label, first_word, edits, matched (the span's words)."""
    scanner = scanner or LicenseScanner()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                joined = scanner.words((text.as_py() or "").encode())
                out += [(doc_id, h.label, h.first_word, h.edits, joined[h.start : h.end].decode("utf-8", "replace")) for h in scanner.hits(joined)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "label", "first_word", "edits", "matched"])

    return two_columns(docs, id_col, text_col).mapInArrow(scan, "doc_id long, label string, first_word long, edits long, matched string")


def scan_documents(docs: DataFrame, scanner: LicenseScanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its base places, labels and score.

    ``score`` is 1 with a base place, else the likeness of the best fuzzy notice, else 0.
    ``spans``: ``first-end:label:edits`` of each notice found, in words.
    """
    scanner = scanner or LicenseScanner()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n_words = np.concatenate([np.zeros(0, np.int64), *(runs(IS_ALNUM[part], cuts)[2] for _, _, part, cuts in slices(data, offsets))])
            rows = [scanner.scan(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *arrays], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return two_columns(docs, id_col, text_col).mapInArrow(scan, SCHEMA)
