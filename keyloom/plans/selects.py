"""Selection text, ``field low high ...``, as predicates for each table.

Ranges include both ends. Ranges of one field and element are alternatives;
different fields must all hold. Limits of scaled fields are taken back to raw
values, so the stored column is compared and the filter reaches the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.odl import leading_int, leading_real
from ..sources.schema import Field
from .catalog import Catalog, CatalogError, Table


class SelectError(ValueError):
    """Selection text that can't be read."""


@dataclass(frozen=True)
class Range:
    table: Table
    field: Field
    #: Element of an array, from 1, or 0.
    element: int
    low: object
    high: object

    def target(self) -> Column:
        return element_of(self.field, self.element)


def element_of(field: Field, element: int = 0) -> Column:
    """The raw value that predicates and indexes see."""
    column = F.col(f"`{field.column}`")
    if element:
        column = F.try_element_at(column, F.lit(element))
    return bit_value(column, field) if field.bits else column


def bit_value(word: Column, field: Field) -> Column:
    b = field.bits
    value = F.shiftrightunsigned(word.cast("long"), b.shift(field.word)).bitwiseAND((1 << b.bits) - 1)
    if b.signed:
        value = F.when(value.bitwiseAND(1 << (b.bits - 1)) != 0, value - (1 << b.bits)).otherwise(value)
    return value.cast("int") if b.signed else value


def limit(field: Field, text: str) -> object:
    """A limit as a value of the stored column."""
    if field.scaled:
        raw = (leading_real(text) - field.offset) / field.scale
        if field.kind == "real":
            return raw
        # whole numbers are cut towards zero
        return max(0, int(raw)) if field.kind == "uint" else int(raw)
    if field.kind == "int":
        return leading_int(text)
    if field.kind == "uint":
        return max(0, leading_int(text))
    if field.kind == "real":
        return leading_real(text)
    # of a limit longer than the field only the field's width counts
    return text[: field.size] if field.size else text


def parse_select(text: str, catalog: Catalog) -> list[Range]:
    words = text.split()
    if len(words) % 3:
        raise SelectError(f"a selection is field, low, high: {' '.join(words[len(words) - len(words) % 3 :])} is incomplete")
    out = []
    for name, low, high in zip(words[::3], words[1::3], words[2::3], strict=True):
        found = re.fullmatch(r"([^\[\]]+)(?:\[(.*)\])?", name)
        if not found:
            raise SelectError(f"{name} is no field")
        try:
            table, field = catalog.resolve(found[1])
        except CatalogError as error:
            raise SelectError(str(error)) from error
        element = 0
        if field.dimension:
            if found[2] is None or not found[2].strip().isdigit():
                raise SelectError(f"array {name} needs one subscript")
            element = int(found[2])
            if element < 1 or 0 < field.dimension < element:
                raise SelectError(f"subscript of {name} is out of range")
        out.append(Range(table, field, element, limit(field, low), limit(field, high)))
    return out


def predicates(ranges: list[Range], table: Table) -> Column | None:
    """What a table's rows must fulfil."""
    groups: dict[tuple[str, int], list[Range]] = {}
    for r in ranges:
        if r.table is table:
            groups.setdefault((r.field.name, r.element), []).append(r)
    out: Column | None = None
    for group in groups.values():
        target = group[0].target()
        any_of: Column | None = None
        for r in group:
            inside = (target >= F.lit(r.low)) & (target <= F.lit(r.high))
            any_of = inside if any_of is None else any_of | inside
        if len(group) > 1 and table.frame is None:
            # the source takes no alternatives: it gets the range that holds them all
            any_of = (target >= F.lit(min(r.low for r in group))) & (target <= F.lit(max(r.high for r in group))) & any_of
        out = any_of if out is None else out & any_of
    return out
