"""Collections of tables: from directories, list files, single files or Parquet.

A catalog keeps its tables in order, since a field without a table name belongs
to the first table that has it.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from ..sources.fragments import FORMAT, FragmentSource, dump_table
from ..sources.schema import BitField, Field, SchemaError, TableDef, load_fragment, load_table

LIST_NAMES = ("DATASET", "DATASET.LST", "DATASET.TXT")
#: Names of Parquet files that a plan may list to leave them out.
MOST_FILES = 10_000
_ENDINGS = (".dat", ".tab", ".lbl")


class CatalogError(ValueError):
    """A collection or a name in it that can't be resolved."""


@dataclass
class Table:
    """A table and how to scan it.

    ``order``: columns that give the order of records within equal keys, for
    tables that aren't fragments; those of Parquet files have the order of their
    files and rows without it. ``unique``: the keys are known to be unique.
    """

    definition: TableDef
    frame: DataFrame | None = None
    order: tuple[str, ...] = ()
    unique: bool = False
    #: Does the frame read files, so that its rows have places?
    placed: bool = False

    @property
    def name(self) -> str:
        return self.definition.name

    def files(self) -> list[str]:
        """The files that hold the table, as places name them."""
        if self.frame is None:
            return [f.path for f in self.definition.fragments]
        # the frame lists URIs, rows know plain paths
        return sorted(re.sub("^file:/+", "file:/", unquote(f)) for f in self.frame.inputFiles())

    def scan(self, spark: SparkSession, columns: list[str], blocks: dict[str, list[int]] | None = None, places: bool = False) -> DataFrame:
        """The named scan columns, with those that give the order of records.

        ``blocks``: files of which only these blocks of BLOCK_ROWS rows are wanted;
        more may be read. ``places``: with ``_file`` and ``_rec``, a row's place in it.
        """
        if self.frame is not None:
            frame = self.frame
            gone = [f for f, some in (blocks or {}).items() if not some]
            if 0 < len(gone) <= MOST_FILES:
                frame = frame.where(~F.col("_metadata.file_path").isin(gone))
            own = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_rec")] if places or (self.placed and not self.order) else []
            names = list(dict.fromkeys([*columns, *self.order]))
            return frame.select(*[F.col(f"`{c}`") for c in names], *own)
        spark.dataSource.register(FragmentSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = spark.read.format(FORMAT).option("table", dump_table(self.definition)).option("columns", json.dumps(columns))
        if blocks is not None:
            reader = reader.option("blocks", json.dumps({str(k): blocks[f.path] for k, f in enumerate(self.definition.fragments) if f.path in blocks}))
        df = reader.load()
        return df.withColumn("_file", F.get(F.from_json(F.lit(json.dumps(self.files())), "array<string>"), F.col("_frag"))) if places else df

    @property
    def record_order(self) -> tuple[str, ...]:
        if self.frame is None:
            return ("_frag", "_rec")
        return self.order or (("_file", "_rec") if self.placed else ())


def data_files(folder: str, prefix: str) -> list[str]:
    """A table's label files in the order of their names, case aside.

    Of a data file and a label of the same stem, only the label counts; dangling
    links are left out.
    """
    found: dict[str, str] = {}
    for name in files.names(folder):
        stem, end = os.path.splitext(name)
        if end.lower() in _ENDINGS and name.lower().startswith(prefix.lower()) and (stem.lower() not in found or end.lower() == ".lbl"):
            found[stem.lower()] = files.join(folder, name)
    return sorted(found.values(), key=lambda p: files.name_of(p).lower())


def table_name_of(path: str) -> str:
    """What a file's name says before its first digit or dot."""
    name = re.split(r"[\d.]", files.name_of(path), maxsplit=1)[0]
    return name or files.name_of(path)


@dataclass
class Catalog:
    tables: list[Table] = field(default_factory=list)

    # -- building ---------------------------------------------------------

    def add_files(self, entry: str, paths: list[str]) -> None:
        """Fragments of a table; a table that is there already takes them in, in the order of their names."""
        if not paths:
            raise CatalogError(f"no files for table {entry}")
        same = next((t for t in self.tables if t.definition.entry.lower() == entry.lower() and t.frame is None), None)
        if same is None:
            same = Table(load_table(paths[0], entry))
            self.tables.append(same)
        fragments = same.definition.fragments + [load_fragment(f) for f in paths]
        same.definition.fragments = sorted(fragments, key=lambda f: files.name_of(f.path).lower())

    @classmethod
    def from_files(cls, paths: list[str]) -> Catalog:
        """One table of the files named, called after the first of them."""
        made = cls()
        made.add_files(table_name_of(paths[0]), list(paths))
        return made

    @classmethod
    def load(cls, path: str) -> Catalog:
        """A list file, or a directory that holds one.

        Each line names a table of the list's directory, ``dir/table``, or with a
        closing ``/`` another collection; names are relative to the list's place.
        """
        made = cls()
        made._load(path.replace("\\", "/"), ())
        return made

    def _load(self, path: str, opened: tuple[str, ...]) -> None:
        if files.is_folder(path):
            found = next((p for n in LIST_NAMES if (p := files.find(files.join(path, n)))), None)
            if found is None:
                raise CatalogError(f"{path} has no {' or '.join(LIST_NAMES)}")
            path = found
        elif not files.exists(path):
            raise CatalogError(f"{path} doesn't exist")
        path = files.absolute(path)
        if path in opened:
            raise CatalogError(f"{path} lists itself")
        folder = files.folder_of(path)
        lines = [line.strip().replace("\\", "/") for line in files.read(path).decode("latin-1").splitlines()]
        for line in filter(None, lines):
            if line.endswith("/"):
                self._load(files.join(folder, line), (*opened, path))
                continue
            inner, _, name = line.rpartition("/")
            place = files.join(folder, inner) if inner else folder
            self.add_files(name, data_files(place, name) if files.is_folder(place) else [])

    def add_frame(
        self,
        name: str,
        frame: DataFrame,
        keys: list[str] | None = None,
        aliases: dict[str, str] | None = None,
        scales: dict[str, tuple[float, float]] | None = None,
        bits: dict[str, list[BitField]] | None = None,
        dimensions: dict[str, int] | None = None,
        order: list[str] | None = None,
        unique: bool = False,
        placed: bool = False,
    ) -> Catalog:
        """A table that is a DataFrame. Array columns without a dimension are variable arrays.

        ``order`` decides which record of equal keys is the first; without it the
        keys must be unique.
        """
        aliases, scales, bits, dimensions = aliases or {}, scales or {}, bits or {}, dimensions or {}
        fields: list[Field] = []
        for column in frame.schema.fields:
            kind = column.dataType
            element = kind.elementType if isinstance(kind, T.ArrayType) else kind
            names = {T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "real", T.DoubleType: "real", T.StringType: "string"}
            label = names.get(type(element), "other")
            scale, offset = scales.get(column.name, (0.0, 0.0))
            word = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4}.get(type(element), 8)
            made = Field(column.name, label, 0, aliases.get(column.name), scale=_single(scale), offset=_single(offset), dimension=dimensions.get(column.name, 0), word=min(word, 4))
            if isinstance(kind, T.ArrayType) and not made.dimension:
                made = replace(made, dimension=-1)
            fields.append(made)
            for b in bits.get(column.name, []):
                fields.append(replace(made, name=f"{column.name}:{b.name}", alias=f"{made.alias or column.name}:{b.alias or b.name}", bits=b, kind="int" if b.signed else "uint"))
        keys = keys or []
        if keys and not order and not unique and not placed:
            raise CatalogError(f"table {name}: give an order of records, or say that its keys are unique")
        self.tables.append(Table(TableDef(name, name, fields, list(keys)), frame, tuple(order or ()), unique, placed))
        return self

    def add_parquet(self, spark: SparkSession, name: str, path: str | list[str], **options) -> Catalog:
        """As ``add_frame``; several paths are one table, whose records have the order of their files without ``order``."""
        paths = [path] if isinstance(path, str) else list(path)
        return self.add_frame(name, spark.read.parquet(*paths), placed=True, **options)

    def register_views(self, spark: SparkSession) -> None:
        """Every table as a temporary view of its own name."""
        for t in self.tables:
            columns = [c for f in t.definition.fields if not f.bits for c in ([f.name, f.array_column] if f.var else [f.name])]
            t.scan(spark, list(dict.fromkeys(columns))).createOrReplaceTempView(t.name)

    # -- names ------------------------------------------------------------

    def resolve(self, name: str) -> tuple[Table, Field]:
        """``[table.]field``: the first table, in order, that has the name or alias."""
        label, dot, rest = name.partition(".")
        for t in self.tables:
            if dot and t.name.lower() == label.lower() and (found := t.definition.find(rest)):
                return t, found
        if not dot:
            for t in self.tables:
                if found := t.definition.find(name):
                    return t, found
        raise CatalogError(f"no field {name}")

    def check_keyless(self) -> None:
        if len(self.tables) > 1 and (none := [t.name for t in self.tables if not t.definition.keys]):
            raise SchemaError(f"table {none[0]} has no keys, so it must be the only table")


def _single(x: float) -> float:
    import numpy as np

    return float(np.float32(x))
