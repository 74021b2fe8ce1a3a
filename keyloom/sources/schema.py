"""Tables, fields and fragments, and the label that declares them."""

from __future__ import annotations

import os
import re
import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import types as T

from . import files
from .odl import LabelError, LabelObject, leading_int, leading_real, list_values, parse_label, unit_of, unquote

#: DATA_TYPE keyword -> (kind of value, numpy letter, byte order). Fixed names of the label standard.
DATA_TYPES = {
    "MSB_INTEGER": ("int", "i", ">"),
    "SUN_INTEGER": ("int", "i", ">"),
    "MAC_INTEGER": ("int", "i", ">"),
    "INTEGER": ("int", "i", ">"),
    "MSB_UNSIGNED_INTEGER": ("uint", "u", ">"),
    "SUN_UNSIGNED_INTEGER": ("uint", "u", ">"),
    "MAC_UNSIGNED_INTEGER": ("uint", "u", ">"),
    "UNSIGNED_INTEGER": ("uint", "u", ">"),
    "LSB_INTEGER": ("int", "i", "<"),
    "PC_INTEGER": ("int", "i", "<"),
    "VAX_INTEGER": ("int", "i", "<"),
    "LSB_UNSIGNED_INTEGER": ("uint", "u", "<"),
    "PC_UNSIGNED_INTEGER": ("uint", "u", "<"),
    "VAX_UNSIGNED_INTEGER": ("uint", "u", "<"),
    "IEEE_REAL": ("real", "f", ">"),
    "SUN_REAL": ("real", "f", ">"),
    "MAC_REAL": ("real", "f", ">"),
    "REAL": ("real", "f", ">"),
    "PC_REAL": ("real", "f", "<"),
    "CHARACTER": ("string", "S", ""),
    "ASCII_INTEGER": ("int", "S", ""),
    "ASCII_REAL": ("real", "S", ""),
    "BYTE_OFFSET": ("int", "i", ">"),
    "MSB_BIT_STRING": ("uint", "u", ">"),
    "LSB_BIT_STRING": ("uint", "u", "<"),
}
_SIZES = {"i": (1, 2, 4), "u": (1, 2, 4), "f": (4, 8)}


class SchemaError(ValueError):
    """A table declaration that can't be used."""


@dataclass(frozen=True)
class BitField:
    """A part of an integer word; ``start`` counts from 1 at the word's most significant bit."""

    name: str
    start: int
    bits: int
    signed: bool = False
    alias: str | None = None

    def shift(self, word_bytes: int) -> int:
        return word_bytes * 8 - self.start - self.bits + 1


@dataclass(frozen=True)
class VarData:
    """Elements kept in a side file. ``layout``: "plain", or "q15": an exponent first, then mantissas."""

    kind: str
    dtype: str
    layout: str
    count_order: str


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    size: int = 0
    alias: str | None = None
    start: int = 0
    dtype: str = ""
    dimension: int = 0
    scale: float = 0.0
    offset: float = 0.0
    bits: BitField | None = None
    var: VarData | None = None
    #: Bytes of the word that bit fields are counted in.
    word: int = 4

    def named(self, name: str) -> bool:
        return name.lower() in (self.name.lower(), (self.alias or self.name).lower())

    @property
    def column(self) -> str:
        """The scan's column that holds the value, or the word of a bit field."""
        return self.name.split(":")[0] if self.bits else self.name

    @property
    def array_column(self) -> str:
        return self.name + "[]" if self.var else self.column

    @property
    def scaled(self) -> bool:
        # an offset without a scale is ignored
        return self.scale != 0

    def spark_type(self) -> T.DataType:
        plain = {"int": T.IntegerType(), "uint": T.LongType(), "real": T.DoubleType(), "string": T.StringType()}[self.kind]
        return T.ArrayType(plain) if self.dimension else plain


@dataclass(frozen=True)
class Fragment:
    """One data file of a table."""

    path: str
    offset: int
    rows: int
    row_bytes: int
    side_file: str | None = None
    start_keys: tuple[str, ...] = ()
    end_keys: tuple[str, ...] = ()


@dataclass
class TableDef:
    """``entry``: the name it is listed under; ``name``: the label's own name."""

    entry: str
    name: str
    fields: list[Field]
    keys: list[str]
    fragments: list[Fragment] = field(default_factory=list)

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.named(name)), None)

    def key_fields(self) -> list[Field]:
        out = []
        for key in self.keys:
            found = self.find(key)
            if found is None:
                raise SchemaError(f"key {key} of {self.name} is no column")
            out.append(found)
        return out


def _float32(text: str | None) -> float:
    """Scales and offsets are held in single precision."""
    return float(np.float32(leading_real(text)))


def _make_fields(column: LabelObject) -> list[Field]:
    """The fields of one column: itself, then its bit fields. None for an unknown type."""
    name, kind_name = unquote(column.get("NAME") or ""), unquote(column.get("DATA_TYPE") or "").upper()
    if kind_name not in DATA_TYPES:
        warnings.warn(f"column {name} has the unknown type {kind_name}; it is dropped", stacklevel=2)
        return []
    kind, letter, order = DATA_TYPES[kind_name]
    n_bytes, items = leading_int(column.get("BYTES")), leading_int(column.get("ITEMS"))
    size = n_bytes
    if items > 0:
        size = leading_int(column.get("ITEM_BYTES"))
        if not size:
            warnings.warn(f"column {name} has no ITEM_BYTES; BYTES / ITEMS is used", stacklevel=2)
            size = n_bytes // items
    if size not in _SIZES.get(letter, (size,)) or size <= 0:
        raise SchemaError(f"column {name}: {kind_name} can't have {size} bytes")
    if letter == "S" and kind != "string" and size >= 128:
        raise SchemaError(f"column {name}: numbers have fewer than 128 characters")
    var = None
    var_type = unquote(column.get("VAR_RECORD_TYPE") or "").upper()
    if kind_name == "BYTE_OFFSET":
        var = VarData("int", ">i2", "q15", ">")
    elif var_type:
        element = unquote(column.get("VAR_DATA_TYPE") or "").upper()
        if element not in DATA_TYPES or DATA_TYPES[element][1] == "S":
            raise SchemaError(f"column {name}: elements of type {element} can't be read")
        e_kind, e_letter, e_order = DATA_TYPES[element]
        width = leading_int(column.get("VAR_ITEM_BYTES"))
        if width not in _SIZES[e_letter]:
            raise SchemaError(f"column {name}: {element} can't have {width} bytes")
        layout = "q15" if "Q15" in var_type else "plain"
        var = VarData(e_kind, f"{e_order}{e_letter}{width}", layout, "<" if order == "<" and letter == "i" else ">")
    field_ = Field(
        name,
        kind,
        size,
        unquote(column.get("ALIAS_NAME") or "") or None,
        leading_int(column.get("START_BYTE")) - 1,
        f"{order}{letter}{size}",
        items if items > 0 else 0,
        _float32(column.get("SCALING_FACTOR")),
        _float32(column.get("OFFSET")),
        var=var,
        word=size,
    )
    if var and (field_.dimension or field_.scaled):
        raise SchemaError(f"column {name}: a variable array can't have ITEMS or a scale")
    out = [field_]
    if "BIT_STRING" in kind_name:
        for child in column.children:
            bit_kind = DATA_TYPES.get(unquote(child.get("BIT_DATA_TYPE") or "").upper(), ("uint",))[0]
            bit = BitField(unquote(child.get("NAME") or ""), leading_int(child.get("START_BIT")), leading_int(child.get("BITS")), bit_kind == "int", unquote(child.get("ALIAS_NAME") or "") or None)
            if not 1 <= bit.bits <= 32 or bit.shift(size) < 0:
                raise SchemaError(f"bit field {name}:{bit.name} lies outside its word")
            alias = f"{field_.alias or name}:{bit.alias or bit.name}"
            out.append(replace(field_, name=f"{name}:{bit.name}", alias=alias, bits=bit, kind="int" if bit.signed else "uint"))
    return out


def read_label(path: str) -> tuple[LabelObject, LabelObject]:
    """(whole tree, the first TABLE object in it)."""
    tree = parse_label(files.read(path), files.folder_of(files.absolute(path)))
    table = tree.find("TABLE")
    if table is None:
        raise LabelError(f"{path} declares no TABLE")
    return tree, table


def _key_list(table: LabelObject, *names: str) -> list[str]:
    value = table.get(*names)
    return list_values(value) if value else []


def load_table(path: str, entry: str) -> TableDef:
    """The table that a label declares, without fragments."""
    _, table = read_label(path)
    row_bytes, columns = leading_int(table.get("ROW_BYTES")), leading_int(table.get("COLUMNS"))
    if row_bytes <= 0:
        raise SchemaError(f"{path} has no ROW_BYTES")
    fields: list[Field] = []
    n = 0
    for child in table.children:
        made = _make_fields(child)
        n += bool(made)
        fields += made
    if n != columns:
        warnings.warn(f"{path} declares {columns} columns and describes {n}", stacklevel=2)
    name = unquote(table.get("NAME") or "") or entry
    keys = _key_list(table, "PRIMARY_KEYS", "PRIMARY_KEY", "KEYS")
    made = TableDef(entry, name, fields, keys)
    made.key_fields()
    return made


def load_fragment(path: str) -> Fragment:
    """Where the rows of a label's data lie."""
    tree, table = read_label(path)
    row_bytes, rows = leading_int(table.get("ROW_BYTES")), leading_int(table.get("ROWS"))
    record_bytes = leading_int(tree.get("RECORD_BYTES")) or row_bytes
    data, offset = path, 0
    pointer = tree.get("^TABLE") or tree.get("^" + table.kind) or table.get("^TABLE")
    detached = path.lower().endswith(".lbl")
    name = None
    if pointer is not None:
        parts = [p for p in re.split(r"[(),]", pointer) if p.strip()]
        named = [p for p in parts if re.match(r"\s*[\"']", p) or not re.match(r"\s*\d", p)]
        numbers = [p for p in parts if re.match(r"\s*\d", p)]
        name = unquote(re.sub(r"<[^>]*>", "", named[0])) if named else None
        if numbers:
            n = leading_int(numbers[0])
            offset = n - 1 if (unit_of(numbers[0]) or "").upper() == "BYTES" else (n - 1) * record_bytes
    if name:
        found = files.find(files.join(files.folder_of(path), name))
        if found is None:
            raise LabelError(f"{path} points to {name}, which isn't there")
        data = found
    elif detached:
        stem = path[:-4]
        data = next((p for end in (".dat", ".DAT", ".tab", ".TAB") if (p := files.find(stem + end))), None)
        if data is None:
            raise LabelError(f"{path} has no data file beside it")
    size = files.size(data)
    if offset + rows * row_bytes > size:
        warnings.warn(f"{data} is shorter than {rows} rows; the whole rows in it are read", stacklevel=2)
        rows = max(0, (size - offset) // row_bytes)
    side = files.find(os.path.splitext(data)[0] + ".var")
    return Fragment(
        files.absolute(data),
        offset,
        rows,
        row_bytes,
        files.absolute(side) if side else None,
        tuple(_key_list(table, "START_KEYS", "START_PRIMARY_KEY", "START_KEY")),
        tuple(_key_list(table, "END_KEYS", "STOP_PRIMARY_KEY", "STOP_KEY")),
    )
