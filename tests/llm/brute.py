"""The operators' definitions in plain Python, one text and one pair at a time."""

from __future__ import annotations

import hashlib
import math
import re
from unicodedata import category

import numpy as np

from keyloom.llm import bytescan, packing, quality, toxicity


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def spans(text: str) -> list[tuple[int, int]]:
    """Where the toxicity operator's words stand."""
    inside = [c.isalnum() or c == "\xad" or category(c)[0] == "M" for c in text] + [False]
    out, start = [], None
    for k, is_in in enumerate(inside):
        if is_in and start is None:
            start = k
        elif not is_in and start is not None:
            out.append((start, k))
            start = None
    return out


def hit_of(word: str, terms) -> tuple[int, int] | None:
    """(edits, number) of the closest term, of these the first."""
    found = []
    for k, t in enumerate(terms):
        if t.stem:
            near = range(max(0, len(t.text) - t.edits), min(len(word), len(t.text) + t.edits) + 1)
            d = min((edit_distance(word[:n], t.text) for n in near), default=99)
        else:
            d = edit_distance(word, t.text) if abs(len(word) - len(t.text)) <= t.edits else 99
        if d <= t.edits:
            found.append((d, k))
    return min(found, default=None)


def toxicity_logit(model: toxicity.ToxicityModel, text: str) -> float:
    text, wide, terms = (text or "").lower(), toxicity.WINDOW, model.lexicon.terms
    words = spans(text)
    sums, used = [0.0, 0.0, 0.0], set()
    for i, (a, b) in enumerate(words):
        if (hit := hit_of(text[a:b], terms)) is None:
            continue
        before = text[words[i - wide - 1][1] if i > wide else 0 : a]
        after = text[b : words[i + wide + 1][0] if i + wide + 1 < len(words) else len(text)]
        marks = bool(toxicity.QUOTE_MARKS.search(after))
        quoted = marks and bool(toxicity.QUOTE_MARKS.search(before) or toxicity.REPORTING.search(before))
        term = terms[hit[1]]
        sums[quoted] += term.weight * (1 - hit[0] / len(term.text))
        sums[2] += bool(toxicity.ADDRESS.search(before) or toxicity.ADDRESS.search(after))
        used.add(hit[1])
    x = [math.log1p(max(0.0, v)) for v in sums] + [math.log1p(len(used)), sums[0] / max(1, len(words)) * 10] if used else [0.0] * 5
    return float(np.dot(x, model.coefficients)) + model.bias


def quality_logit(model: quality.QualityModel, text: str) -> float:
    raw, mask = (text or "").encode(), (1 << 64) - 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    whole = [int(bytescan.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    mixed = lambda h: int(bytescan.mix(np.array([h & mask], dtype=np.uint64))[0])
    kinds = [[(h >> 20) % quality.BUCKETS for h in whole], [mixed(b - a + int(quality._PAIR)) % quality.BUCKETS for a, b in zip(whole, whole[1:], strict=False)]]
    for n in quality.GRAMS:
        own = []
        for k in range(len(raw) - n + 1):
            h = n
            for c in raw[k : k + n]:
                h = h * 0x01000193 % (1 << 32) ^ c
            h ^= h >> 15
            h = h * 0x85EBCA6B % (1 << 32)
            own.append((h ^ h >> 13) % quality.BUCKETS)
        kinds.append(own)
    return sum(float(np.mean([float(model.table[b]) for b in own])) for own in kinds if own) / quality.KINDS + model.bias


def exact_kept(rows: list[tuple[int, str]]) -> set[int]:
    least: dict[str, int] = {}
    for i, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        least[key] = min(i, least.get(key, i))
    return set(least.values())


def packed(rows: list[tuple[int, str]], n_buckets: int = packing.N_BUCKETS, budget: int = packing.TOKEN_BUDGET) -> list[tuple]:
    lengths = {i: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows}
    sizes = sorted(set(lengths.values()))
    count = {n: sum(1 for v in lengths.values() if v == n) for n in sizes}
    # least padded total of the first lengths in so many buckets, and its bounds; of equal ones the leftmost last cut
    best = {0: (0, [])}
    plans = [best]
    for _ in range(n_buckets):
        now = {}
        for j in range(1, len(sizes) + 1):
            options = [(plans[-1][c][0] + sum(count[n] for n in sizes[c:j]) * sizes[j - 1], c) for c in range(j) if c in plans[-1]]
            if 0 not in plans[-1]:
                options.append((sum(count[n] for n in sizes[:j]) * sizes[j - 1], 0))
            cost, c = min(options)
            now[j] = (cost, [*(plans[-1].get(c, (0, []))[1] if c else []), sizes[j - 1]])
        plans.append(now)
    bounds = plans[-1][len(sizes)][1] if sizes else []
    out = []
    for bound in bounds:
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, n in lengths.items() if min(b for b in bounds if b >= n) == bound)
        room = max(1, budget // bound)
        out += [(i, lengths[i], bound, k // room, k % room, bound - lengths[i]) for k, (_, i) in enumerate(own)]
    return sorted(out)
