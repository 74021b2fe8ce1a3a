"""The word-end BPE vocabulary: normaliser, pre-tokens and exact merges.

Follows a ``tokenizers`` JSON file of this family: NFC, white space dropped,
lower case, a split into contractions, letters, single digits and other signs,
bytes written as printable characters, and merges by rank with ``</w>`` closing
each pre-token. The file's content is read on the driver and sent to the tasks
(its size is that of a vocabulary, whatever the corpus).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex

END = "</w>"
#: Characters for which the standard library's classes agree with the file's pattern.
_PLAIN = re.compile(r"[\x00-\x1B\x20-\x7E¡§«°´¶·»¿À-ȗ‐-‧‰-›€]*\Z")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+(?:_+[^\s\w]*)*|_+(?:[^\s\w]+_*)*")
_ANY_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordBpe:
    """One vocabulary. ``content``: the JSON file's bytes."""

    #: Longer words are merged with a heap, in n log n steps.
    SHORT = 48

    def __init__(self, content: bytes):
        model = json.loads(content)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.letters = byte_letters()
        self.table = {b: s for b, s in self.letters.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.max_length = max(map(len, self.vocab))

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand at odd places of the list."""
        return self._specials.split(text) if "<|" in text else [text]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, before they are written as bytes."""
        if not text.isascii():
            # the library lowers one character at a time, so a final sigma stays the common one
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (_PLAIN_WORDS if _PLAIN.match(text) else _ANY_WORDS).findall(text)

    def spell(self, word: str) -> str:
        """A pre-token in the vocabulary's letters, without its end mark."""
        # printable ASCII stands for itself
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        letters = self.letters
        return "".join([letters[b] for b in word.encode()])

    def merge(self, spelled: str, ends: bool = True) -> list[str]:
        """The exact merges of a spelled word; ``ends``: the last letter carries the end mark."""
        parts = list(spelled)
        if ends and parts:
            parts[-1] += END
        return self._merge_short(parts) if len(parts) <= self.SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        # ranks of the neighbours: a merge changes two of them
        own = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while own and (best := min(own)) < none:
            at = own.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del own[at]
            if at:
                own[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(own):
                own[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, ranks = len(parts), self.ranks
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i] += parts[j]
            live[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, x in zip(parts, live, strict=True) if x]


_cached: dict[int, WordBpe] = {}


def shared_vocabulary(content: bytes) -> WordBpe:
    """One vocabulary for each worker process."""
    key = hash(content)
    if key not in _cached:
        _cached.clear()
        _cached[key] = WordBpe(content)
    return _cached[key]
