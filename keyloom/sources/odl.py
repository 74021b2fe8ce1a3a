"""Label text to a tree of objects and keywords.

A label is a sequence of lines ``KEYWORD = value``, ``OBJECT = CLASS`` ...
``END_OBJECT`` and a closing ``END``, after which binary data may follow. Values
keep their raw text, quotes and ``<units>`` included; helpers take them apart.
``^STRUCTURE = "file"``, or ``^ANY_STRUCTURE``, splices another label file in its place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from . import files

#: Keywords that name a label file to be put in their place.
INCLUDES = "^*STRUCTURE"
#: A line without a newline within so many bytes ends the label.
LINE_LIMIT = 256


class LabelError(ValueError):
    """A label that can't be understood."""


@dataclass
class LabelObject:
    """An object of the tree: its class, keywords in order, and children."""

    kind: str
    keywords: list[tuple[str, str]] = field(default_factory=list)
    children: list[LabelObject] = field(default_factory=list)
    parent: LabelObject | None = field(default=None, repr=False, compare=False)

    def get(self, *names: str) -> str | None:
        """Raw value of the first keyword that any of the patterns names, in the patterns' order."""
        for name in names:
            for keyword, value in self.keywords:
                if fnmatchcase(unquote(keyword), unquote(name)):
                    return value
        return None

    def find(self, kind: str, scope: str = "subtree") -> LabelObject | None:
        """The first object of a class in a scope, in the order of the text."""
        return next(self.find_all(kind, scope), None)

    def find_all(self, kind: str, scope: str = "subtree") -> Iterator[LabelObject]:
        """Objects whose class the pattern ``kind`` names, ``*`` standing for anything.

        Scopes: ``this`` object alone, its ``children``, its ``siblings`` that come
        after it, its ``subtree``, itself included, or from itself to the ``end`` of
        the label.
        """
        later = self.parent.children[self.place() + 1 :] if self.parent else []
        among = {"this": [self], "children": self.children, "siblings": later, "subtree": self._below(), "end": self._onwards()}
        if scope not in among:
            raise LabelError(f"{scope} is no scope of a search: {', '.join(among)}")
        return (o for o in among[scope] if fnmatchcase(unquote(o.kind), unquote(kind)))

    def place(self) -> int:
        """Which child of its parent the object is."""
        return next(k for k, o in enumerate(self.parent.children) if o is self)

    def _below(self) -> Iterator[LabelObject]:
        yield self
        for child in self.children:
            yield from child._below()

    def _onwards(self) -> Iterator[LabelObject]:
        yield from self._below()
        at = self
        while at.parent:
            for child in at.parent.children[at.place() + 1 :]:
                yield from child._below()
            at = at.parent


def unquote(text: str) -> str:
    text = text.strip()
    if len(text) >= 2 and text[0] in "\"'" and text[-1] == text[0]:
        return text[1:-1].strip()
    return text.strip("\"'")


def unit_of(text: str) -> str | None:
    """What stands between ``<`` and ``>`` after a value."""
    found = re.search(r"<([^>]*)>\s*\)?\s*$", text)
    return found[1].strip() if found else None


def list_values(text: str) -> list[str]:
    """Members of a list value, nested ``()`` and ``{}`` flattened; a bare value is a list of one."""
    out, now, quote = [], "", ""
    for c in text:
        if quote:
            now += c
            quote = "" if c == quote else quote
        elif c in "\"'":
            now += c
            quote = c
        elif c in "(){},":
            if now.strip():
                out.append(unquote(now))
            now = ""
        else:
            now += c
    if now.strip():
        out.append(unquote(now))
    return out


_INT = re.compile(r"\s*[-+]?\d+")
_REAL = re.compile(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def leading_int(text: str | None) -> int:
    """The number that a text begins with, or 0."""
    found = _INT.match(unquote(text or ""))
    return int(found[0]) if found else 0


def leading_real(text: str | None) -> float:
    found = _REAL.match(unquote(text or ""))
    return float(found[0]) if found else 0.0


def _lines(raw: bytes):
    at = 0
    first = True
    while at < len(raw):
        end = raw.find(b"\n", at, at + LINE_LIMIT)
        if end < 0:
            if len(raw) - at >= LINE_LIMIT:
                return
            end = len(raw)
        line = raw[at:end].decode("latin-1").replace("\t", " ")
        at = end + 1
        line = re.sub(r"[^\x20-\x7E\xA0-\xFF]+$", "", line).rstrip()
        if first and line.startswith("CCSD"):
            first = False
            continue
        first = False
        yield line


def _strip_comment(line: str, quoted: bool) -> tuple[str, bool]:
    """The line up to a ``/*`` outside double quotes; is a quote open at its end?"""
    for k, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == "/" and not quoted and line[k : k + 2] == "/*":
            return line[:k].rstrip(), quoted
    return line, quoted


def _balanced(text: str) -> bool:
    bare = re.sub(r'"[^"]*"', "", text)
    return text.count('"') % 2 == 0 and all(bare.count(a) <= bare.count(b) for a, b in ("()", "{}"))


def parse_label(raw: bytes, base: str | None = None, _open: tuple[str, ...] = ()) -> LabelObject:
    """The tree of a label's bytes. ``base``: the folder that included files lie in."""
    root = LabelObject("ROOT")
    stack = [root]
    lines = _lines(raw)
    for line in lines:
        text, quoted = _strip_comment(line, False)
        if not text.strip():
            continue
        # a statement goes on until its value is there and balanced
        while "=" in text and (quoted or not text.split("=", 1)[1].strip() or not _balanced(text)):
            more = next(lines, None)
            if more is None:
                break
            more, quoted = _strip_comment(more, quoted)
            text += "\n" + more
        name, equals, value = text.partition("=")
        name, value = name.strip(), value.strip()
        if name == "END" and not equals:
            break
        if name == "OBJECT":
            child = LabelObject(unquote(value), parent=stack[-1])
            stack[-1].children.append(child)
            stack.append(child)
        elif name == "END_OBJECT":
            if len(stack) > 1:
                stack.pop()
        elif base is not None and fnmatchcase(name, INCLUDES):
            _include(stack[-1], unquote(value), base, _open)
        elif equals:
            stack[-1].keywords.append((name, value))
    return root


def _include(into: LabelObject, name: str, base: str, opened: tuple[str, ...]) -> None:
    path = files.find(files.join(base, name))
    if path is None:
        raise LabelError(f"included file {name} is not in {base}")
    if path in opened:
        raise LabelError(f"{name} includes itself")
    tree = parse_label(files.read(path), files.folder_of(path), (*opened, path))
    into.keywords += tree.keywords
    into.children += tree.children
    for child in tree.children:
        child.parent = into
