"""A Python data source that decodes fixed-record fragments into Arrow batches.

Each fragment is cut into ranges of rows, one input partition each, so a large
file is read by many tasks. A range is one ``numpy`` structured view; only the
columns that the options name are decoded, side files are touched only for array
columns, and fragments whose declared key range a pushed filter excludes are
skipped. ``_frag`` and ``_rec`` give a row's place in the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from . import files
from .schema import BitField, Field, Fragment, TableDef, VarData

FORMAT = "keyloom"
ROWS_PER_PARTITION = 1 << 18
BATCH_ROWS = 1 << 14
#: Rows of the blocks that indexes choose from.
BLOCK_ROWS = 1 << 12


def dump_table(table: TableDef) -> str:
    return json.dumps(asdict(table))


def restore_table(text: str) -> TableDef:
    raw = json.loads(text)
    fields = []
    for f in raw["fields"]:
        f["bits"] = BitField(**f["bits"]) if f["bits"] else None
        f["var"] = VarData(**f["var"]) if f["var"] else None
        fields.append(Field(**f))
    fragments = [Fragment(**{**f, "start_keys": tuple(f["start_keys"]), "end_keys": tuple(f["end_keys"])}) for f in raw["fragments"]]
    return TableDef(raw["entry"], raw["name"], fields, raw["keys"], fragments)


def array_type(field: Field) -> T.DataType:
    """Type of a variable array's elements; scaled mantissas are real."""
    if field.var.layout == "q15":
        return T.ArrayType(T.DoubleType())
    return T.ArrayType({"int": T.IntegerType(), "uint": T.LongType(), "real": T.DoubleType()}[field.var.kind])


def scan_schema(table: TableDef, columns: list[str] | None = None) -> T.StructType:
    """``_frag``, ``_rec`` and the scan's columns; a variable array has its pointer and ``name[]``."""
    out = [T.StructField("_frag", T.IntegerType(), False), T.StructField("_rec", T.LongType(), False)]
    for f in table.fields:
        if f.bits:
            continue
        if columns is None or f.name in columns:
            out.append(T.StructField(f.name, f.spark_type(), False))
        if f.var and (columns is None or f.array_column in columns):
            out.append(T.StructField(f.array_column, array_type(f)))
    return T.StructType(out)


_INT = re.compile(rb"\s*([-+]?\d+)")
_REAL = re.compile(rb"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def decode_text(raw: np.ndarray, kind: str) -> np.ndarray | list:
    """Characters of fixed width: strings keep their padding and end at a zero byte; numbers are what leads."""
    if kind == "string":
        if raw.dtype.itemsize and (np.char.find(raw, b"\0") >= 0).any():
            return [v.split(b"\0", 1)[0].decode("latin-1") for v in raw.tolist()]
        return np.char.decode(raw, "latin-1")
    number = np.int64 if kind == "int" else np.float64
    try:
        # most columns hold plain numbers and blanks
        values = np.char.strip(raw).astype(number)
        if not np.isfinite(values).all() or (np.char.find(raw, b"_") >= 0).any():
            raise ValueError("words and groups of digits are no numbers here")
        return values
    except ValueError:
        pattern = _INT if kind == "int" else _REAL
        return np.array([number(m[1]) if (m := pattern.match(v)) else number(0) for v in raw.tolist()], dtype=number)


#: Bytes of a side file that are read at once, about.
SIDE_SPAN = 16 << 20


def decode_var(field: Field, pointers: np.ndarray, side: pa.NativeFile | None) -> pa.Array:
    """The elements that each pointer leads to, null without any; reads the parts of the side file that the pointers span."""
    kind = pa.float64() if field.var.layout == "q15" else {"int": pa.int32(), "uint": pa.int64(), "real": pa.float64()}[field.var.kind]
    end = side.size() if side is not None else 0
    known = np.flatnonzero((pointers >= 0) & (pointers + 2 <= end))
    order = known[np.argsort(pointers[known], kind="stable")]
    sizes = np.zeros(len(pointers), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    first = 0
    while first < len(order):
        # pointers that lie within one span
        last = max(first + 1, int(np.searchsorted(pointers[order], pointers[order[first]] + SIDE_SPAN, side="right")))
        rows = order[first:last]
        values, n = _span_values(field, pointers[rows], side, end)
        sizes[rows] = n
        parts.append((np.repeat(rows, n), values))
        first = last
    owner, flat = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
    flat = flat[np.argsort(owner, kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    missing = np.ones(len(pointers), dtype=bool)
    missing[known] = False
    to_numpy = {pa.int32(): np.int32, pa.int64(): np.int64, pa.float64(): np.float64}[kind]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(to_numpy)), mask=pa.array(missing))


def _span_values(field: Field, pointers: np.ndarray, side: pa.NativeFile, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(values one after another, how many each pointer has) of ascending pointers."""
    low, kind = int(pointers[0]), np.dtype(field.var.dtype)
    count = lambda raw, at: raw[at + (field.var.count_order == ">")].astype(np.int64) | raw[at + (field.var.count_order == "<")].astype(np.int8).astype(np.int64) << 8
    read = lambda upto: np.frombuffer(side.read_at(min(upto, end) - low, low), dtype=np.uint8)
    raw = read(int(pointers[-1]) + 2)
    n_bytes = np.minimum(np.maximum(count(raw, pointers - low), 0), end - pointers - 2)
    upto = int((pointers + 2 + n_bytes).max())
    raw = raw if upto <= low + len(raw) else read(upto)
    n = n_bytes // kind.itemsize
    starts = np.repeat(pointers - low + 2, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * kind.itemsize
    values = raw[starts[:, None] + np.arange(kind.itemsize)].copy().view(kind).ravel()
    if field.var.layout != "q15":
        return values, n
    # an exponent stands before the mantissas
    heads = (np.cumsum(n) - n)[n > 0]
    exponents = np.repeat(values[heads].astype(np.float64), n[n > 0])
    mantissas = np.ones(len(values), dtype=bool)
    mantissas[heads] = False
    return (values * 2.0 ** (exponents - 15))[mantissas], np.maximum(n - 1, 0)


class RowRange(InputPartition):
    def __init__(self, frag: int, fragment: Fragment, first: int, last: int):
        self.frag, self.fragment, self.first, self.last = frag, fragment, first, last


class FragmentReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema = schema
        self.table = restore_table(options["table"])
        self.rows = int(options.get("rowsperpartition", ROWS_PER_PARTITION))
        #: Fragment -> its blocks of BLOCK_ROWS rows that are wanted; others are read whole.
        self.blocks: dict[str, list[int]] = json.loads(options.get("blocks", "{}"))
        self.bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Ranges of the leading key prune fragments by their declared keys; all filters run again in Spark."""
        leading = self.table.keys[0].lower() if self.table.keys else None
        for f in filters:
            if isinstance(f, EqualTo | GreaterThanOrEqual | LessThanOrEqual) and len(f.attribute) == 1 and f.attribute[0].lower() == leading:
                kind = "both" if isinstance(f, EqualTo) else "low" if isinstance(f, GreaterThanOrEqual) else "high"
                self.bounds.append((kind, f.attribute[0], f.value))
            yield f

    def _excluded(self, fragment: Fragment) -> bool:
        if not (fragment.start_keys and fragment.end_keys and self.bounds):
            return False
        first, last = fragment.start_keys[0], fragment.end_keys[0]
        for kind, name, value in self.bounds:
            field = self.table.find(name)
            if field is None:
                continue
            if field.kind == "string":
                # declared keys lack the padding of the stored ones
                low, high = first, last.ljust(field.size) if field.size else last + chr(0x10FFFF)
            else:
                try:
                    low, high = float(first), float(last)
                except ValueError:
                    return False
            if kind in ("both", "low") and high < value or kind in ("both", "high") and low > value:
                return True
        return False

    def _wanted(self, frag: int, rows: int) -> list[tuple[int, int]]:
        """Stretches of a fragment's rows, from its blocks."""
        if str(frag) not in self.blocks:
            return [(0, rows)]
        out: list[tuple[int, int]] = []
        for block in sorted(self.blocks[str(frag)]):
            first, last = block * BLOCK_ROWS, min(rows, (block + 1) * BLOCK_ROWS)
            if out and out[-1][1] == first:
                first = out.pop()[0]
            out.append((first, last))
        return [x for x in out if x[0] < x[1]]

    def partitions(self):
        parts = []
        for k, fragment in enumerate(self.table.fragments):
            if self._excluded(fragment):
                continue
            for first, last in self._wanted(k, fragment.rows):
                for at in range(first, last, self.rows):
                    parts.append(RowRange(k, fragment, at, min(last, at + self.rows)))
        return parts or [RowRange(0, Fragment("", 0, 0, 1), 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        fragment = partition.fragment
        if partition.first >= partition.last:
            return
        wanted = [f.name for f in self.schema.fields]
        plain = [f for f in self.table.fields if not f.bits and (f.name in wanted or f.array_column in wanted)]
        kinds = {"int": pa.int32(), "uint": pa.int64(), "real": pa.float64(), "string": pa.string()}
        record = np.dtype({"names": [f.name for f in plain], "formats": [(f.dtype, (f.dimension,)) if f.dimension else f.dtype for f in plain], "offsets": [f.start for f in plain], "itemsize": fragment.row_bytes})
        with ExitStack() as opened:
            data = opened.enter_context(files.open_input(fragment.path))
            has_side = fragment.side_file and any(f.var and f.array_column in wanted for f in plain)
            side = opened.enter_context(files.open_input(fragment.side_file)) if has_side else None
            for at in range(partition.first, partition.last, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.last - at)
                rows = np.frombuffer(data.read_at(n * fragment.row_bytes, fragment.offset + at * fragment.row_bytes), dtype=record, count=n)
                made: dict[str, pa.Array] = {"_frag": pa.array(np.full(n, partition.frag, dtype=np.int32)), "_rec": pa.array(np.arange(at, at + n, dtype=np.int64))}
                for f in plain:
                    raw = rows[f.name]
                    flat = raw.reshape(-1)
                    values = decode_text(flat, f.kind) if f.dtype.lstrip("<>").startswith("S") else flat.astype({"int": np.int32, "uint": np.int64, "real": np.float64}[f.kind])
                    array = pa.array(values, kinds[f.kind], safe=False)
                    if f.dimension:
                        array = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * f.dimension), array)
                    if f.name in wanted:
                        made[f.name] = array
                    if f.var and f.array_column in wanted:
                        made[f.array_column] = decode_var(f, flat.astype(np.int64), side)
                yield pa.RecordBatch.from_arrays([made[c] for c in wanted], names=wanted)


class FragmentSource(DataSource):
    """Options: ``table`` (a dumped TableDef), ``columns`` (JSON list), ``rowsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        columns = self.options.get("columns")
        return scan_schema(restore_table(self.options["table"]), json.loads(columns) if columns else None)

    def reader(self, schema: T.StructType) -> FragmentReader:
        return FragmentReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        from .writer import FragmentWriter

        return FragmentWriter(schema, self.options)
