"""Secondary indexes: values with the places of their records, selections by them, counts, and statistics.

An index is a Parquet table of ``(file, rec, number, value, text)``, one value
column for each kind, sorted by value within each file of the index, so row-group
statistics prune a range lookup. Beside it lies the list of the files it covers:
those that were added to the table, or written anew, later are not indexed, and
are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Table
from ..plans.fields import parse_fields
from ..plans.selects import Range, element_of, parse_select
from ..sources import files
from ..sources.fragments import BLOCK_ROWS
from ..sources.schema import Field, SchemaError

INDEX_SCHEMA = "file string, rec bigint, number bigint, value double, text string"
#: Blocks of a selection that come to the driver; a selection of more is no reason to leave any out.
MOST_BLOCKS = 100_000


class IndexError_(ValueError):
    """A field that can't be indexed, or a count without any selection."""


def _value_name(field: Field) -> str:
    return {"string": "text", "real": "value"}.get(field.kind, "number")


class Indexes:
    """The indexes of a catalog, kept at a path. ``spark`` reads and writes them."""

    def __init__(self, spark: SparkSession, catalog: Catalog, path: str):
        self.spark, self.catalog, self.path = spark, catalog, path

    # -- building ---------------------------------------------------------

    def _entries(self, table: Table, field: Field, element: int) -> DataFrame:
        own = _value_name(field)
        kinds = {"number": "bigint", "value": "double", "text": "string"}
        value = element_of(field, element)
        columns = [(value if name == own else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
        return table.scan(self.spark, [field.column], places=True).select(F.col("_file").alias("file"), F.col("_rec").cast("bigint").alias("rec"), *columns)

    def _folder(self, table: str, field: str, element: int) -> str:
        return f"{self.path}/table={table}/field={field.replace(':', '.')}/element={element}"

    def build(self, fields: str) -> None:
        """Index each field, or each ``array[i]``; an index that is there already is written anew."""
        made = []
        for o in parse_fields(fields, self.catalog):
            if o.virtual or o.field.var:
                raise IndexError_(f"{o.text} has no values of its own to index")
            if not o.table.definition.keys:
                raise IndexError_(f"{o.table.name} has no keys, so it has no indexes")
            if o.table.frame is not None and not o.table.placed:
                raise IndexError_(f"{o.table.name} is read from no files, so its records have no places")
            element = 0
            if o.field.dimension:
                if o.span.pointer or o.span.low is None or o.span.low != o.span.high:
                    raise IndexError_(f"{o.text} is an array: index one element")
                element = o.span.low
            made.append((o.table, o.field, element))
        for table, field, element in made:
            folder, own = self._folder(table.name, field.name, element), _value_name(field)
            covered = self.spark.createDataFrame(self._versions(table), "file string, version string")
            entries = self._entries(table, field, element)
            entries.repartitionByRange(own).sortWithinPartitions(own, "file", "rec").write.mode("overwrite").parquet(f"{folder}/entries")
            covered.coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")

    def _read(self, r: Range) -> tuple[DataFrame, set[str]] | None:
        """(entries, files covered) of the index of a selection's field."""
        folder = self._folder(r.table.name, r.field.name, r.element)
        if not self._exists(folder):
            return None
        covered = {tuple(row) for row in self.spark.read.parquet(f"{folder}/files").select("file", "version").collect()}
        return self.spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/entries"), {f for f, _ in covered & set(self._versions(r.table))}

    @staticmethod
    def _versions(table: Table) -> list[tuple[str, str]]:
        """The table's files, with what changes when a fragment is written anew; Parquet files aren't."""
        if table.frame is not None:
            return [(f, "") for f in table.files()]
        return [(f.path, files.version(f.path)) for f in table.definition.fragments]

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    # -- using ------------------------------------------------------------

    @staticmethod
    def _groups(ranges: list[Range]) -> list[list[Range]]:
        groups: dict[tuple[str, int], list[Range]] = {}
        for r in ranges:
            groups.setdefault((r.field.name, r.element), []).append(r)
        return list(groups.values())

    @staticmethod
    def _inside(group: list[Range]) -> Column:
        own = F.col(_value_name(group[0].field))
        return reduce(lambda a, b: a | b, [own.between(F.lit(r.low), F.lit(r.high)) for r in group])

    def _selected(self, ranges: list[Range]) -> tuple[DataFrame, set[str]] | None:
        """((file, rec) of the records that fulfil the selections, files covered by all indexes that serve them); None without any index."""
        parts, covered = [], None
        for group in self._groups(ranges):
            if (found := self._read(group[0])) is None:
                continue
            entries, own = found
            covered = own if covered is None else covered & own
            parts.append(entries.where(self._inside(group)).select("file", "rec"))
        if covered is None:
            return None
        # a record stands once in an index: nothing is counted twice
        return reduce(lambda a, b: a.join(b, ["file", "rec"]), parts), covered

    def lookup(self, select: str, table: str) -> DataFrame:
        """(file, rec) of a table's records that fulfil the selections by indexes: alternatives within a field, all fields."""
        found = self._selected([r for r in parse_select(select, self.catalog) if r.table.name.lower() == table.lower()])
        if found is None:
            raise IndexError_(f"no index of {table} serves the selections")
        return found[0]

    def blocks(self, ranges: list[Range]) -> dict[str, list[int]] | None:
        """For each file of the ranges' table that indexes cover, its blocks of BLOCK_ROWS rows that may hold selected records."""
        out: dict[str, set[int]] = {}
        for group in self._groups(ranges):
            if (found := self._read(group[0])) is None:
                continue
            entries, covered = found
            block = F.floor(F.col("rec") / BLOCK_ROWS).cast("bigint").alias("block")
            rows = entries.where(self._inside(group)).select("file", block).distinct().limit(MOST_BLOCKS + 1).collect()
            if len(rows) > MOST_BLOCKS:
                continue
            own: dict[str, set[int]] = {f: set() for f in covered}
            for r in rows:
                if r["file"] in own:
                    own[r["file"]].add(r["block"])
            out |= {f: some & out.get(f, some) for f, some in own.items()}
        return {f: sorted(some) for f, some in out.items()} if out else None

    def rough_count(self, select: str) -> DataFrame:
        """One row: the table with the fewest records by its indexes, their number, and what share of its files is indexed.

        Files without an index add nothing; it counts records, not joined rows.
        """
        ranges = parse_select(select, self.catalog)
        if not ranges:
            raise IndexError_("a count needs selections")
        counts = []
        for table in {id(r.table): r.table for r in ranges}.values():
            found = self._selected([r for r in ranges if r.table is table])
            n = found[0].agg(F.count(F.lit(1)).alias("records")) if found is not None else self.spark.range(1).select(F.lit(0).cast("bigint").alias("records"))
            share = 100.0 * len(found[1]) / max(1, len(table.files())) if found is not None else 0.0
            counts.append(n.select(F.lit(table.name).alias("table"), "records", F.lit(share).alias("indexed_percent")))
        every = reduce(DataFrame.unionByName, counts)
        # one row for each table of the selections
        return every.orderBy("records", "table").limit(1)

    def statistics(self) -> DataFrame:
        """(table, field, element, records, distinct_values, fragments, indexed_percent, encoding) of every index.

        ``encoding``: the layouts that the files' values call for: "ordered" (each
        value once, in the order of records), "unique" (each once), "runs" (equal
        values in few stretches of records) or "repeated".
        """
        if not self._exists(self.path):
            raise SchemaError(f"{self.path} has no indexes")
        # table, field and element are folders of the path
        every = self.spark.read.option("basePath", self.path).schema(INDEX_SCHEMA + ", `table` string, field string, element int").parquet(f"{self.path}/table=*/field=*/element=*/entries")
        value = F.coalesce(F.col("text"), F.col("number").cast("string"), F.col("value").cast("string")).alias("v")
        entries = every.select("table", "field", "element", "file", "rec", "number", "value", "text", value)
        own = ["table", "field", "element"]
        # a file's entries are one task's worth: files are what tables are cut into
        records = Window.partitionBy(*own, "file").orderBy("rec")
        rows = entries.withColumns({"step": F.coalesce(F.col("text") > F.lag("text").over(records), F.col("number") > F.lag("number").over(records), F.col("value") > F.lag("value").over(records), F.lit(True)), "same": F.col("v") == F.lag("v").over(records)})
        per_file = rows.groupBy(*own, "file").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("d"), F.min(F.col("step").cast("int")).alias("steps"), F.count_if(~F.coalesce("same", F.lit(False))).alias("runs")
        )
        # four bytes for each record and two more, against eight for each run
        layout = F.when((F.col("n") == F.col("d")) & (F.col("steps") == 1), "ordered").when(F.col("n") == F.col("d"), "unique").when(F.col("n") + 2 <= 2 * F.col("runs"), "repeated").otherwise("runs")
        shapes = per_file.groupBy(*own).agg(F.array_join(F.array_sort(F.collect_set(layout)), ",").alias("encoding"), F.count(F.lit(1)).alias("fragments"))
        stats = entries.groupBy(*own).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("v").alias("distinct_values")).join(shapes, own)
        known = {t.name: max(1, len(t.files())) for t in self.catalog.tables if t.frame is None or t.placed}
        of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map()
        share = F.least(F.lit(100.0), 100.0 * F.col("fragments") / F.coalesce(F.try_element_at(of, F.col("table")), F.col("fragments")))
        return stats.withColumn("indexed_percent", share)
