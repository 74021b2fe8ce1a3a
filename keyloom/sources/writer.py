"""Writing tables as fragments: fixed records, side files and labels, one fragment for each partition.

Tasks write data files under names of their own; when all have ended well, the
driver writes the labels, so a task that is run again, or a job that fails, leaves
nothing that a reader would find.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import files
from .fragments import FORMAT, FragmentSource, dump_table, restore_table
from .schema import Field, TableDef

_COUNT = {"<": "<i2", ">": ">i2"}


def encode(field: Field, values: pa.Array) -> np.ndarray:
    """A column as it lies in the records."""
    if field.dimension:
        flat = encode(replace(field, dimension=0), values.flatten())
        return flat.reshape(len(values), field.dimension)
    if not field.dtype.lstrip("<>").startswith("S"):
        return values.to_numpy(zero_copy_only=False).astype(field.dtype)
    if field.kind == "string":
        raw = np.array([(v or "").encode("latin-1", "replace")[: field.size] for v in values.to_pylist()], dtype=field.dtype)
        return np.char.ljust(raw, field.size)
    texts = np.array([format(v, "d" if field.kind == "int" else ".12G") for v in values.to_pylist()], dtype="U")
    if texts.dtype.itemsize // 4 > field.size:
        raise ValueError(f"a number of {field.name} has more than {field.size} characters")
    return np.char.rjust(texts, field.size).astype(field.dtype)


def encode_var(field: Field, values: pa.ListArray, at: int) -> tuple[np.ndarray, bytes]:
    """(pointers, bytes of the side file) of a variable array's values, which will lie from ``at`` on; -1 for nulls.

    Blocks in the q15 layout come as they are kept: the exponent, then mantissas.
    """
    pointers, out, width = [], [], int(field.var.dtype[2:])
    for row in values.to_pylist():
        if row is None:
            pointers.append(-1)
            continue
        if len(row) * width > 0x7FFF:
            raise ValueError(f"a value of {field.name} has more than 32767 bytes")
        block = np.array(len(row) * width, dtype=_COUNT[field.var.count_order]).tobytes() + np.array(row, dtype=field.var.dtype).tobytes()
        pointers.append(at)
        out.append(block)
        at += len(block)
    return np.array(pointers, dtype=np.int64), b"".join(out)


@dataclass
class Written(WriterCommitMessage):
    """A data file: the partition, its name and rows, and its first and last keys."""

    part: int
    name: str
    rows: int
    first: tuple[str, ...]
    last: tuple[str, ...]


class FragmentWriter(DataSourceArrowWriter):
    """Options: ``table`` (a dumped TableDef), ``folder``."""

    def __init__(self, schema: T.StructType, options: dict):
        self.table, self.folder = restore_table(options["table"]), options["folder"]
        self.fields = [f for f in self.table.fields if not f.bits]
        self.row_bytes = max(f.start + f.size * max(1, f.dimension) for f in self.fields)
        lacking = {f.array_column if f.var else f.name for f in self.fields} - set(schema.names)
        if lacking:
            raise ValueError(f"columns {', '.join(sorted(lacking))} of {self.table.name} are not there")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        name = f"{self.table.entry}{part:05d}_{uuid.uuid4().hex[:8]}"
        record = np.dtype({"names": [f.name for f in self.fields], "formats": [(f.dtype, (f.dimension,)) if f.dimension else f.dtype for f in self.fields], "offsets": [f.start for f in self.fields], "itemsize": self.row_bytes})
        done = Written(part, name, 0, (), ())
        keys = self.table.key_fields()
        side, at = None, 0
        with files.open_output(files.join(self.folder, f"{name}.dat")) as data:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                rows = np.zeros(batch.num_rows, dtype=record)
                for f in self.fields:
                    if f.var:
                        pointers, block = encode_var(f, batch.column(f.array_column), at)
                        side = side or files.open_output(files.join(self.folder, f"{name}.var"))
                        side.write(block)
                        at += len(block)
                        rows[f.name] = pointers
                    else:
                        rows[f.name] = encode(f, batch.column(f.name))
                data.write(rows.tobytes())
                ends = [tuple(str(batch.column(k.column)[place].as_py()).rstrip() for k in keys) for place in (0, batch.num_rows - 1)]
                done.first, done.last = done.first or ends[0], ends[1]
                done.rows += batch.num_rows
        if side is not None:
            side.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        # empty partitions have no fragment, but a table has one at least
        found = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for m in [m for m in found if m.rows] or found[:1]:
            files.write(files.join(self.folder, f"{m.name}.lbl"), label_text(self.table, self.row_bytes, m).encode("latin-1"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            for end in ("dat", "var"):
                files.delete(files.join(self.folder, f"{m.name}.{end}"))


def label_text(table: TableDef, row_bytes: int, part: Written) -> str:
    """The label of one fragment."""
    words = [f for f in table.fields if not f.bits]
    lines = ["RECORD_TYPE = FIXED_LENGTH", f"RECORD_BYTES = {row_bytes}", f"FILE_RECORDS = {part.rows}", f'^TABLE = "{part.name}.dat"', "OBJECT = TABLE", f"  NAME = {table.name}"]
    lines += ["  INTERCHANGE_FORMAT = BINARY", f"  ROWS = {part.rows}", f"  COLUMNS = {len(words)}", f"  ROW_BYTES = {row_bytes}"]
    if table.keys:
        lines += [f"  PRIMARY_KEY = ({', '.join(table.keys)})"]
    if table.keys and part.rows:
        lines += [f"  {name} = ({', '.join(keys)})" for name, keys in (("START_PRIMARY_KEY", part.first), ("STOP_PRIMARY_KEY", part.last)) if all(k and k.replace(".", "").replace("-", "").isalnum() for k in keys)]
    for f in words:
        lines += ["  OBJECT = COLUMN", f"    NAME = {f.name}", *([f"    ALIAS_NAME = {f.alias}"] if f.alias else []), f"    DATA_TYPE = {type_name(f, any(b.bits and b.column == f.name for b in table.fields))}"]
        lines += [f"    START_BYTE = {f.start + 1}", f"    BYTES = {f.size * max(1, f.dimension)}", *([f"    ITEMS = {f.dimension}", f"    ITEM_BYTES = {f.size}"] if f.dimension else [])]
        lines += [f"    SCALING_FACTOR = {f.scale!r}", f"    OFFSET = {f.offset!r}"] if f.scaled else []
        if f.var:
            lines += [f"    VAR_RECORD_TYPE = {'Q15' if f.var.layout == 'q15' else 'VAX_VARIABLE_LENGTH'}", f"    VAR_DATA_TYPE = {_ORDERS[f.var.dtype[0], f.var.kind == 'real']}_{_KINDS[f.var.kind]}", f"    VAR_ITEM_BYTES = {f.var.dtype[2:]}"]
        for b in (x.bits for x in table.fields if x.bits and x.column == f.name):
            lines += ["    OBJECT = BIT_COLUMN", f"      NAME = {b.name}", *([f"      ALIAS_NAME = {b.alias}"] if b.alias else []), f"      BIT_DATA_TYPE = {'MSB_INTEGER' if b.signed else 'MSB_UNSIGNED_INTEGER'}", f"      START_BIT = {b.start}", f"      BITS = {b.bits}", "    END_OBJECT"]
        lines += ["  END_OBJECT"]
    return "\r\n".join([*lines, "END_OBJECT", "END", ""])


_ORDERS = {(">", False): "MSB", ("<", False): "PC", (">", True): "IEEE", ("<", True): "PC"}
_KINDS = {"int": "INTEGER", "uint": "UNSIGNED_INTEGER", "real": "REAL"}


def type_name(field: Field, has_bits: bool) -> str:
    """The DATA_TYPE of a column."""
    order, letter = field.dtype[0], field.dtype.lstrip("<>")[0]
    if letter == "S":
        return {"string": "CHARACTER", "int": "ASCII_INTEGER", "real": "ASCII_REAL"}[field.kind]
    if has_bits:
        return "MSB_BIT_STRING" if order == ">" else "LSB_BIT_STRING"
    if field.kind == "real":
        return "IEEE_REAL" if order == ">" else "PC_REAL"
    return ("MSB_" if order == ">" else "LSB_") + _KINDS[field.kind]


def laid_out(fields: list[Field]) -> list[Field]:
    """The fields one after another; bit fields lie where their word does."""
    at, place, out = 0, {}, []
    for f in fields:
        if f.bits:
            out.append(replace(f, start=place[f.column], size=f.word, dtype=""))
            continue
        place[f.name] = at
        out.append(replace(f, start=at, word=f.size))
        at += f.size * max(1, f.dimension)
    return out


def write_fragments(df: DataFrame, folder: str, table: TableDef, fragments: int | None = None) -> None:
    """Write ``df`` as fragments of a table below ``folder``, in ranges of ascending keys.

    Columns are named as the scan names them: ``name[]`` holds a variable array.
    A table without keys keeps the frame's partitions.
    """
    spark = df.sparkSession
    spark.dataSource.register(FragmentSource)
    keys = [F.col(f"`{k.column}`") for k in table.key_fields()]
    if keys:
        df = (df.repartitionByRange(fragments, *keys) if fragments else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    elif fragments:
        df = df.coalesce(fragments)
    df.write.format(FORMAT).mode("append").option("table", dump_table(table)).option("folder", folder).save()


class BytesWriter(DataSourceArrowWriter):
    """Options: ``folder``, ``ending``, ``first`` (hexadecimal: what each file begins with)."""

    def __init__(self, options: dict):
        self.folder, self.ending, self.first = options["folder"], options["ending"], bytes.fromhex(options.get("first", ""))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        done = Written(part, f"_part-{part:05d}-{uuid.uuid4().hex[:8]}", 0, (), ())
        with files.open_output(files.join(self.folder, done.name)) as out:
            out.write(self.first)
            for batch in iterator:
                for value in batch.column("value"):
                    out.write(value.as_buffer())
                done.rows += batch.num_rows
        return done

    def commit(self, messages: list[Written | None]) -> None:
        found = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        rows = [m for m in found if m.rows] or found[:1]
        for k, m in enumerate(rows):
            files.rename(files.join(self.folder, m.name), files.join(self.folder, f"part-{k:05d}{self.ending}"))
        self.abort([m for m in found if m not in rows])

    def abort(self, messages: list[Written | None]) -> None:
        for m in filter(None, messages):
            files.delete(files.join(self.folder, m.name))


class BytesSink(DataSource):
    """Writes the column ``value`` to files as it is."""

    @classmethod
    def name(cls) -> str:
        return "keyloom-bytes"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("value", T.BinaryType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> BytesWriter:
        return BytesWriter(self.options)


def write_bytes(df: DataFrame, folder: str, ending: str, first: bytes = b"") -> None:
    """The values of a binary column ``value``, one after another: a file for each partition, in their order."""
    df.sparkSession.dataSource.register(BytesSink)
    df.write.format(BytesSink.name()).mode("append").option("folder", folder).option("ending", ending).option("first", first.hex()).save()
