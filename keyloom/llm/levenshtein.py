"""A lexicon trie intersected with Levenshtein automata, as one deterministic table.

A state of the table is the set of all (trie node, edits so far) that a word's
characters may have led to, for all terms at once; accepting states name the
closest term. Words of a batch run through the table side by side, one code point
at a time, and those that no term can match any more drop out, mostly after a few.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import cache

import numpy as np


@dataclass(frozen=True)
class Term:
    """``stem``: the term may be followed by anything. ``edits``: how many are allowed."""

    text: str
    stem: bool
    weight: float
    edits: int


@dataclass
class LexiconAutomaton:
    """``table[state, kind of code point]``: next state, 0 is dead; ``hit[state]``: term or -1; ``edits[state]``."""

    kinds: np.ndarray
    table: np.ndarray
    hit: np.ndarray
    edits: np.ndarray

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of each word that is within a term's edits; ``data``: code points."""
        live = np.arange(len(starts))
        state = np.ones(len(starts), dtype=np.int64)
        at = starts.copy()
        words, states = [], []
        while len(live):
            over = at >= ends[live]
            if over.any():
                words.append(live[over])
                states.append(state[over])
                live, state, at = live[~over], state[~over], at[~over]
                if not len(live):
                    break
            state = self.table[state, self.kinds.take(data[at], mode="clip")]
            at = at + 1
            # states that accept whatever follows are done
            go = state > 0
            if not go.all():
                live, state, at = live[go], state[go], at[go]
        if not words:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        word, last = np.concatenate(words), np.concatenate(states)
        found = self.hit[last] >= 0
        word, last = word[found], last[found]
        order = np.argsort(word)
        return word[order], self.hit[last][order], self.edits[last][order]


def build(terms: list[Term]) -> LexiconAutomaton:
    """Subset construction over (trie node, edits); edits beyond what any term below allows are cut.

    A set is an integer with one bit for each place: ``node * wide + edits``,
    behind the nodes one for each stem that has accepted whatever follows.
    """
    children: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    allowed = [-1]
    for k, term in enumerate(terms):
        node = 0
        allowed[0] = max(allowed[0], term.edits)
        for b in map(ord, term.text):
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append([])
                allowed.append(-1)
            node = children[node][b]
            allowed[node] = max(allowed[node], term.edits)
        ends[node].append(k)
    letters = sorted({b for c in children for b in c})
    # the last kind, of no letter, is also that of all code points beyond
    kinds = np.zeros(max(letters, default=0) + 2, dtype=np.int64)
    for k, b in enumerate(letters):
        kinds[b] = k + 1
    wide, n_nodes = max([t.edits for t in terms], default=0) + 1, len(children)

    def place(node: int, e: int) -> int:
        return node * wide + e

    @cache
    def closed(node: int, e: int) -> int:
        """The place with all that skipping letters of a term leads to."""
        out = 1 << place(node, e)
        for k in ends[node]:
            if terms[k].stem and e <= terms[k].edits:
                out |= 1 << place(n_nodes + k, e)
        for c in children[node].values():
            if e + 1 <= allowed[c]:
                out |= closed(c, e + 1)
        return out

    @cache
    def after(at: int) -> tuple[int, dict[int, int]]:
        """(where any other letter leads, where the letters of the node's children lead) from a place."""
        node, e = divmod(at, wide)
        if node >= n_nodes:
            return 1 << at, {}
        other = closed(node, e + 1) if e + 1 <= allowed[node] else 0
        for c in children[node].values():
            if e + 1 <= allowed[c]:
                other |= closed(c, e + 1)
        return other, {b: other | closed(c, e) for b, c in children[node].items() if e <= allowed[c]}

    fewest = [sum(1 << place(n, e) for n in range(n_nodes + len(terms))) for e in range(wide)]

    def pruned(mask: int) -> int:
        """Of the same node, the fewest edits are enough."""
        for e in range(wide - 1):
            have = mask & fewest[e]
            for more in range(1, wide - e):
                mask &= ~(have << more)
        return mask

    def places(mask: int) -> list[int]:
        out = []
        while mask:
            low = mask & -mask
            out.append(low.bit_length() - 1)
            mask ^= low
        return out

    def verdict(own: list[int]) -> tuple[int, int]:
        best = (99, -1)
        for at in own:
            node, e = divmod(at, wide)
            for k in [node - n_nodes] if node >= n_nodes else ends[node]:
                if e <= terms[k].edits:
                    best = min(best, (e, k))
        return (best[1], best[0]) if best[1] >= 0 else (-1, 0)

    first = pruned(closed(0, 0)) if terms else 0
    names = {0: 0, first: 1}
    rows, verdicts, queue = [np.zeros(len(letters) + 1, np.int32)], [(-1, 0)], deque()
    rows.append(rows[0])
    verdicts.append(verdict(places(first)))
    if terms:
        queue.append(first)

    def name(mask: int) -> int:
        mask = pruned(mask)
        if mask not in names:
            names[mask] = len(rows)
            rows.append(rows[0])
            verdicts.append(verdict(places(mask)))
            queue.append(mask)
        return names[mask]

    while queue:
        mask = queue.popleft()
        steps = [after(at) for at in places(mask)]
        other = 0
        for o, _ in steps:
            other |= o
        row = np.full(len(letters) + 1, name(other), dtype=np.int32)
        # a letter adds to what any other letter leads to
        special: dict[int, int] = {}
        for _, own in steps:
            for b, to in own.items():
                special[b] = special.get(b, other) | to
        for b, to in special.items():
            row[kinds[b]] = name(to)
        rows[names[mask]] = row
    hit, edits = zip(*verdicts, strict=True)
    return LexiconAutomaton(kinds, np.array(rows, dtype=np.int32), np.array(hit, dtype=np.int64), np.array(edits, dtype=np.int64))
