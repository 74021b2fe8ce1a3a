"""Key identity across tables, and one order of keys that agrees with every table's own."""

from __future__ import annotations

from ..sources.schema import Field
from .catalog import Table


class KeyOrderError(ValueError):
    """Tables whose key orders contradict each other, or that share no key."""


def same_key(a: Field, b: Field) -> bool:
    """Equal names, or the alias of one is the name of the other. Two equal aliases don't count."""
    names = (a.name.lower(), b.name.lower())
    return names[0] == names[1] or bool(a.alias and a.alias.lower() == names[1]) or bool(b.alias and b.alias.lower() == names[0])


def canonical_keys(tables: list[Table]) -> list[list[int]]:
    """For each table the numbers of its keys; keys that are the same have the same number."""
    known: list[list[Field]] = []
    group_of: list[int] = []
    out = []
    for t in tables:
        numbers = []
        for key in t.definition.key_fields():
            hits = [k for k, group in enumerate(known) if any(same_key(key, other) for other in group)]
            if not hits:
                hits = [len(known)]
                known.append([])
                group_of.append(hits[0])
            # a key that is the same as those of several groups makes them one
            first, *others = hits
            for k in others:
                known[first] += known[k]
                known[k] = []
                group_of = [first if g == k else g for g in group_of]
            known[first].append(key)
            numbers.append(first)
        out.append(numbers)
    merged = [[group_of[k] for k in numbers] for numbers in out]
    for t, numbers in zip(tables, merged, strict=True):
        if len(set(numbers)) < len(numbers):
            raise KeyOrderError(f"two keys of {t.name} are the same key of another table")
    return merged


def key_sequence(orders: list[list[int]]) -> list[int]:
    """All keys in one order that keeps each table's; ties go to the key met first."""
    met = list(dict.fromkeys(k for keys in orders for k in keys))
    before: dict[int, set[int]] = {k: set() for k in met}
    for keys in orders:
        for a, b in zip(keys, keys[1:], strict=False):
            before[b].add(a)
    out: list[int] = []
    while len(out) < len(met):
        ready = [k for k in met if k not in out and before[k] <= set(out)]
        if not ready:
            raise KeyOrderError("the tables order their keys in ways that contradict each other")
        out.append(ready[0])
    return out
