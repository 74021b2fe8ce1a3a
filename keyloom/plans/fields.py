"""Field text, ``[table.]field[:bit][range] ...``, as output columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spectral import VIRTUAL, Virtual
from ..sources.schema import Field
from .catalog import Catalog, CatalogError, Table
from .selects import bit_value


class FieldError(ValueError):
    """Field text that can't be read."""


@dataclass(frozen=True)
class Span:
    """Elements low..high, from 1; None: open; ``pointer``: no brackets at all."""

    low: int | None
    high: int | None
    pointer: bool = False


@dataclass(frozen=True)
class Output:
    """One output: as typed without brackets, what it shows, and how many values (0: one, None: open)."""

    text: str
    table: Table | None
    field: Field | None
    span: Span
    virtual: Virtual | None = None

    @property
    def is_array(self) -> bool:
        if self.virtual:
            return self.virtual.channels > 1
        return bool(self.field.dimension) or (self.field.var is not None and not self.span.pointer)

    def bounds(self) -> tuple[int, int | None]:
        """First and last element shown; an open end of a variable array has no last."""
        size = self.virtual.channels if self.virtual else self.field.dimension if self.field.dimension > 0 else None
        low, high = self.span.low or 1, self.span.high
        return low, high if high is not None else size

    def names(self) -> list[str]:
        """Header names; an open array has one for all its elements."""
        if not self.is_array:
            return [self.text]
        low, high = self.bounds()
        if self.virtual and self.virtual.open_name and self.span.high is None:
            return [self.virtual.open_name]
        return [f"{self.text}[]"] if high is None else [f"{self.text}[{i}]" for i in range(low, high + 1)]


_TOKEN = re.compile(r"([^\[\]\s]+?)(?:\[([^\[\]]*)\])?")


def parse_span(inside: str | None, dimension: int, name: str) -> Span:
    if inside is None:
        return Span(None, None, pointer=True)
    inside = inside.replace(" ", "")
    found = re.fullmatch(r"(\d*)([:-]?)(\d*)", inside)
    if not found:
        raise FieldError(f"{name}[{inside}] is no range")
    low, high = (int(x) if x else None for x in (found[1], found[3]))
    if low is not None and not found[2]:
        high = low
    if low == 0 or high == 0:
        raise FieldError(f"{name}: elements count from 1")
    if dimension > 0:
        if low is not None and low > dimension:
            raise FieldError(f"{name} has {dimension} elements")
        if high is not None:
            high = min(high, dimension)
    if low is not None and high is not None and low > high:
        raise FieldError(f"{name}[{inside}] ends before it begins")
    return Span(low, high)


def parse_fields(text: str, catalog: Catalog) -> list[Output]:
    out = []
    for token in re.findall(r"[^\s\[\]]+(?:\[[^\]]*\])?", text):
        found = _TOKEN.fullmatch(token)
        if not found:
            raise FieldError(f"{token} is no field")
        name, inside = found[1], found[2]
        try:
            table, field = catalog.resolve(name)
        except CatalogError as error:
            virtual = VIRTUAL.get(name.lower())
            if virtual is None:
                raise FieldError(str(error)) from error
            span = parse_span(inside if inside is not None else "", virtual.channels if virtual.channels > 1 else 0, name)
            out.append(Output(name, None, None, span, virtual))
            continue
        out.append(Output(name, table, field, parse_span(inside, field.dimension, name)))
    if not out:
        raise FieldError("no fields")
    return out


def value_column(output: Output, of, unscaled: bool = False) -> Column:
    """The output's values; ``of(table, scan_column)`` gives the joined column."""
    field = output.field
    if field.var is not None and not output.span.pointer:
        return slice_variable(of(output.table, field.array_column), output.span)
    column = of(output.table, field.column)
    if field.bits:
        column = bit_value(column, field)
    physical = (lambda c: c.cast("double") * F.lit(field.scale) + F.lit(field.offset)) if field.scaled and not unscaled else (lambda c: c)
    if not field.dimension:
        return physical(column)
    part = slice_variable(column, output.span) if field.dimension < 0 else slice_fixed(column, output.span, field.dimension)
    return F.transform(part, physical) if field.scaled and not unscaled else part


def slice_fixed(array: Column, span: Span, dimension: int) -> Column:
    low, high = span.low or 1, span.high or dimension
    return array if (low, high) == (1, dimension) else F.slice(array, low, high - low + 1)


def slice_variable(array: Column, span: Span) -> Column:
    """A closed range has exactly its elements, null where the array lacks them; an open one what there is, or one null."""
    low = span.low or 1
    if span.high is not None:
        return F.transform(F.sequence(F.lit(low), F.lit(span.high)), lambda i: F.try_element_at(array, i))
    rest = F.slice(array, F.lit(low), F.greatest(F.size(array) - (low - 1), F.lit(0)))
    none = F.array(F.try_element_at(array, F.lit(1 << 30)))
    return F.when(F.size(rest) > 0, rest).otherwise(none)
