"""Queries: filter each table, keep the first record of each key, join naturally, project.

    result = order by keys (join on shared keys over the tables named of first per full key (filter(table)))

Tables without keys are scanned alone, duplicates kept. The plan is declared with
the DataFrame API: filters stand below the first-per-key window so they reach the
scan, only needed columns are read, and Spark picks the joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Table
from ..plans.fields import FieldError, Output, Span, parse_fields, slice_fixed, value_column
from ..plans.keys import KeyOrderError, canonical_keys, key_sequence
from ..plans.selects import Range, parse_select, predicates
from .index import Indexes


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row, by ``order``, of each distinct ``keys``.

    A rank of at most 1 lets Spark drop most rows before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


@dataclass
class Query:
    """A planned query: ``joined`` has the columns, ``outputs`` say how they are shown."""

    joined: DataFrame
    outputs: list[Output]
    values: list[Column]
    order: list[str]

    def _named(self) -> list[Column]:
        seen: dict[str, int] = {}
        out = []
        for o, value in zip(self.outputs, self.values, strict=True):
            n = seen[o.text.lower()] = seen.get(o.text.lower(), 0) + 1
            out.append(value.alias(o.text if n == 1 else f"{o.text}#{n}"))
        return out

    def dataframe(self) -> DataFrame:
        """One column for each output, in no order; arrays stay arrays, missing elements are null."""
        return self.joined.select(*self._named())

    def ordered(self) -> DataFrame:
        """The same in ascending order of keys, or of records for a table without keys."""
        return self.joined.orderBy(*self.order).select(*self._named())

    def flattened(self) -> DataFrame:
        """Arrays of a fixed range as one column for each element, named ``field[i]``."""
        out = []
        for o, value in zip(self.outputs, self._named(), strict=True):
            low, high = o.bounds() if o.is_array else (0, 0)
            if not o.is_array or high is None:
                out.append(value)
                continue
            names = o.names() if len(o.names()) > 1 or low == high else [f"{o.text}[{i}]" for i in range(low, high + 1)]
            out += [F.try_element_at(value, F.lit(k + 1)).alias(name) for k, name in enumerate(names)]
        return self.joined.select(*out)


class Engine:
    """Plans and runs queries over a catalog. With ``indexes``, scans leave out the blocks that hold none of the selected records."""

    def __init__(self, spark: SparkSession, catalog: Catalog, indexes: Indexes | None = None):
        self.spark, self.catalog, self.indexes = spark, catalog, indexes

    def query(self, fields: str, select: str = "", unscaled: bool = False) -> DataFrame:
        return self.plan(fields, select, unscaled).dataframe()

    def plan(self, fields: str, select: str = "", unscaled: bool = False) -> Query:
        ranges = parse_select(select, self.catalog)
        self.catalog.check_keyless()
        outputs = parse_fields(fields, self.catalog)
        needs = self._virtual_needs(outputs)
        named = {id(o.table) for o in [*outputs, *needs.values()] if o.table} | {id(r.table) for r in ranges}
        tables = [t for t in self.catalog.tables if id(t) in named]
        wanted = {id(t): self._columns(t, [*outputs, *needs.values()], ranges) for t in tables}
        joined, place, order = self._join(tables, wanted, ranges)
        of = lambda table, column: F.col(f"`{place[id(table), column.lower()]}`")
        values = [self._virtual(o, needs, of) if o.virtual else value_column(o, of, unscaled) for o in outputs]
        return Query(joined, outputs, values, order)

    def _virtual_needs(self, outputs: list[Output]) -> dict[str, Output]:
        out: dict[str, Output] = {}
        for o in outputs:
            for need in o.virtual.needs if o.virtual else ():
                try:
                    out[need] = parse_fields(need, self.catalog)[0]
                except FieldError as error:
                    raise FieldError(f"{o.text} needs {need}: {error}") from error
        return out

    @staticmethod
    def _virtual(o: Output, needs: dict[str, Output], of) -> Column:
        # whole arrays go in as they are, null where there is none
        value = o.virtual.build(*[of(needs[n].table, needs[n].field.array_column) if n.endswith("[]") else value_column(needs[n], of) for n in o.virtual.needs])
        if o.virtual.channels == 1:
            return value
        low, high = o.bounds()
        if o.virtual.open_name and o.span.high is None:
            # as many as the radiances have, at least one
            rest = F.slice(value, F.lit(low), F.greatest(F.size(value) - low + 1, F.lit(0)))
            return F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit(None).cast("double")))
        if o.virtual.open_name:
            return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.try_element_at(value, i))
        return slice_fixed(value, Span(low, high), o.virtual.channels)

    @staticmethod
    def _columns(table: Table, outputs: list[Output], ranges: list[Range]) -> list[str]:
        """Scan columns that a query touches, keys included."""
        out = [key.column for key in table.definition.key_fields()]
        for o in outputs:
            if o.table is table:
                out.append(o.field.column if o.field.var is None or o.span.pointer else o.field.array_column)
        out += [r.field.column for r in ranges if r.table is table]
        return list(dict.fromkeys(out))

    def _rows(self, table: Table, columns: list[str], ranges: list[Range]) -> DataFrame:
        """A table's filtered rows, the first of each key only."""
        own = [r for r in ranges if r.table is table]
        blocks = self.indexes.blocks(own) if self.indexes is not None and own else None
        df = table.scan(self.spark, columns, blocks)
        if (condition := predicates(ranges, table)) is not None:
            df = df.where(condition)
        keys = [F.col(f"`{k.column}`") for k in table.definition.key_fields()]
        if keys and not table.unique:
            df = first_per_key(df, keys, [F.col(f"`{c}`") for c in table.record_order])
        return df

    def _join(self, tables: list[Table], wanted: dict[int, list[str]], ranges: list[Range]) -> tuple[DataFrame, dict[tuple[int, str], str], list[str]]:
        """(joined rows, name of each table's column in them, columns to order by)."""
        place: dict[tuple[int, str], str] = {}
        if len(tables) == 1 and not tables[0].definition.keys:
            t = tables[0]
            df = self._rows(t, wanted[id(t)], ranges)
            return df, {(id(t), c.lower()): c for c in wanted[id(t)]}, list(t.record_order) or [df.columns[0]]
        numbers = canonical_keys(tables)
        sequence = key_sequence(numbers)
        types: dict[int, str] = {}
        frames = []
        for t, own in zip(tables, numbers, strict=True):
            df = self._rows(t, wanted[id(t)], ranges)
            key_of = {k.column.lower(): n for k, n in zip(t.definition.key_fields(), own, strict=True)}
            columns = []
            for c in wanted[id(t)]:
                n = key_of.get(c.lower())
                name = f"k{n}" if n is not None else f"t{len(frames)}.{c}"
                place[id(t), c.lower()] = name
                columns.append(F.col(f"`{c}`").alias(name))
                if n is not None:
                    types.setdefault(n, df.schema[c].dataType.simpleString())
                    types[n] = _wider(types[n], df.schema[c].dataType.simpleString())
            frames.append((df.select(*columns), set(own)))
        frames = [(df.withColumns({f"k{n}": F.col(f"k{n}").cast(types[n]) for n in own}), own) for df, own in frames]
        joined, have = frames.pop(0)
        while frames:
            at = next((k for k, (_, own) in enumerate(frames) if own & have), None)
            if at is None:
                raise KeyOrderError("a table shares no key with the others")
            df, own = frames.pop(at)
            joined = joined.join(df, [f"k{n}" for n in sorted(own & have)], "inner")
            have |= own
        return joined, place, [f"k{n}" for n in sequence]


_RANK = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def _wider(a: str, b: str) -> str:
    if a == b:
        return a
    if a in _RANK and b in _RANK:
        return max(a, b, key=_RANK.index)
    raise KeyOrderError(f"keys of types {a} and {b} can't be joined")
