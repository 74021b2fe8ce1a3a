"""Sinks: tab-separated text, framed binary, and the type mask.

The executors format rows in Arrow batches. ``write_tsv`` and ``write_binary``
bring the formatted rows to one stream, partition by partition;
``write_text_files`` and ``write_binary_files`` write in parallel, one file for
each range of ascending keys.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from typing import BinaryIO, TextIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.fields import Output
from ..sources.writer import write_bytes
from .engine import Query

MISSING = "N/A"


def format_real(x: float) -> str:
    return "%.11G" % x


def _width(o: Output) -> int:
    return o.field.size if o.field is not None else 0


def format_value(x: object, o: Output) -> str:
    if x is None:
        return MISSING
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, float):
        return format_real(x)
    if isinstance(x, str):
        w = _width(o)
        return x[:w].ljust(w) if w else x
    if o.field is not None and o.field.var is not None and o.span.pointer:
        return hex(x & 0xFFFFFFFF)
    return str(x)


def header(outputs: list[Output]) -> str:
    return "\t".join(name for o in outputs for name in o.names())


def _cells(row: Iterable[object], outputs: list[Output]) -> Iterator[str]:
    for x, o in zip(row, outputs, strict=True):
        if not o.is_array:
            yield format_value(x, o)
            continue
        values = [None] if x is None else list(x)
        low, high = o.bounds()
        if high is not None and not (o.virtual and o.virtual.open_name and o.span.high is None):
            values += [None] * (high - low + 1 - len(values))
        yield from (format_value(v, o) for v in values or [None])


def _plain(outputs: list[Output]) -> list[Output]:
    """The outputs as they say how to format; tables and frames of the catalog stay behind."""
    outputs = [replace(o, table=None) for o in outputs]
    return [replace(o, virtual=replace(o.virtual, build=None)) if o.virtual else o for o in outputs]


def _formatted(query: Query, ordered: bool, one: Callable[[tuple], object], kind: str, join: Callable[[list], object] | None = None) -> DataFrame:
    """A column ``value`` of the formatted rows; ``join`` makes one value of a batch's, with the number of its ``rows``."""
    arrow = pa.string() if kind == "string" else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [one(row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if join:
                yield pa.RecordBatch.from_arrays([pa.array([join(values)], arrow), pa.array([len(values)])], names=["value", "rows"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(values, arrow)], names=["value"])

    rows = query.ordered() if ordered else query.dataframe()
    return rows.toDF(*[f"c{k}" for k in range(len(query.outputs))]).mapInArrow(run, f"value {kind}" + (", rows long" if join else ""))


def text_lines(query: Query, ordered: bool = True) -> DataFrame:
    """The rows' lines as one string column, formatted by the executors."""
    outputs = _plain(query.outputs)
    return _formatted(query, ordered, lambda row: "\t".join(_cells(row, outputs)), "string")


def write_tsv(query: Query, out: TextIO, with_header: bool = True) -> int:
    """Header and rows in key order; the number of rows."""
    if with_header:
        out.write(header(query.outputs) + "\n")
    n = 0
    for row in text_lines(query).toLocalIterator(prefetchPartitions=True):
        out.write(row["value"] + "\n")
        n += 1
    return n


def write_text_files(query: Query, folder: str, with_header: bool = True) -> None:
    """The rows in files of ascending key ranges, ``part-00000.tsv`` and so on, each with the header."""
    outputs = _plain(query.outputs)
    lines = _formatted(query, True, lambda row: ("\t".join(_cells(row, outputs)) + "\n").encode(), "binary")
    write_bytes(lines, folder, ".tsv", (header(outputs) + "\n").encode() if with_header else b"")


# -- binary --------------------------------------------------------------


def _frame(x: object, kind: str, size: int, width: int) -> bytes:
    if kind == "S":
        length = -(-max(width, 1) // size) * size
        return (x or "").encode("latin-1", "replace")[:width].ljust(length, b" ")
    if kind == "R":
        return struct.pack("=f" if size == 4 else "=d", x or 0.0)
    if kind == "U":
        packed = struct.pack("=I", (x or 0) & 0xFFFFFFFF)
    else:
        packed = struct.pack("=i", ((x or 0) + (1 << 31)) % (1 << 32) - (1 << 31))
    return packed + b"\0" * (size - 4)


def _kind(o: Output, kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(kind, T.StringType):
        return "S"
    if isinstance(kind, T.DoubleType | T.FloatType):
        return "R"
    return "U" if o.field is not None and o.field.kind == "uint" else "I"


def _open(o: Output) -> bool:
    """Is the number of values written before them?"""
    return o.is_array and o.field is not None and o.field.var is not None and (o.span.low is None or o.span.high is None)


def type_mask(query: Query, schema: T.StructType) -> str:
    """A letter for each value: I, U, R, S (as often as it has characters), V before arrays of any length."""
    out = ""
    for o, f in zip(query.outputs, schema.fields, strict=True):
        kind = _kind(o, f.dataType)
        letter = "S" * max(1, _width(o)) if kind == "S" else kind
        if not o.is_array:
            out += letter
        elif _open(o):
            out += "V" + letter
        else:
            low, high = o.bounds()
            out += letter * (high - low + 1)
    return out


def binary_frames(query: Query, size: int = 4, ordered: bool = True, whole: bool = False) -> DataFrame:
    """The rows as frames of 4 or 8 bytes in the machine's byte order: a binary ``value`` for each row, or (``whole``) for each batch."""
    if size not in (4, 8):
        raise ValueError("frames have 4 or 8 bytes")
    outputs = _plain(query.outputs)
    kinds = [_kind(o, f.dataType) for o, f in zip(query.outputs, query.dataframe().schema.fields, strict=True)]

    def one(row: tuple) -> bytes:
        out = []
        for x, o, kind in zip(row, outputs, kinds, strict=True):
            if not o.is_array:
                out.append(_frame(x, kind, size, _width(o)))
                continue
            values = [None] if x is None else list(x)
            if _open(o):
                values = [v for v in values if v is not None]
                out.append(_frame(len(values), "I", size, 0))
            else:
                low, high = o.bounds()
                values += [None] * (high - low + 1 - len(values))
            out += [_frame(v, kind, size, _width(o)) for v in values]
        return b"".join(out)

    return _formatted(query, ordered, one, "binary", b"".join if whole else None)


def write_binary(query: Query, out: BinaryIO, size: int = 4, mask: bool = False) -> int:
    """Rows in key order as frames of 4 or 8 bytes in the machine's byte order; the number of rows."""
    frames = binary_frames(query, size, whole=True)
    if mask:
        out.write(type_mask(query, query.dataframe().schema).encode() + b"\n")
    n = 0
    for row in frames.toLocalIterator(prefetchPartitions=True):
        out.write(row["value"])
        n += row["rows"]
    return n


def write_binary_files(query: Query, folder: str, size: int = 4, mask: bool = False) -> None:
    """The same in files of ascending key ranges, ``part-00000.bin`` and so on, each with the mask if wanted."""
    write_bytes(binary_frames(query, size, whole=True), folder, ".bin", type_mask(query, query.dataframe().schema).encode() + b"\n" if mask else b"")
