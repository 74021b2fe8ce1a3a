"""Selections over streams: the range predicates are stateless, so a stream is filtered as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.catalog import Catalog
from ..plans.fields import parse_fields, value_column
from ..plans.selects import parse_select, predicates


def select_stream(stream: DataFrame, fields: str, select: str = "", name: str = "stream", **options) -> DataFrame:
    """``fields`` of the stream's rows that fulfil ``select``; duplicates stay, as in a table without keys.

    ``options`` are those of ``Catalog.add_frame`` but for keys, which a stream can't be reduced by.
    """
    catalog = Catalog().add_frame(name, stream, **options)
    table = catalog.tables[0]
    outputs = parse_fields(fields, catalog)
    condition = predicates(parse_select(select, catalog), table)
    rows = stream if condition is None else stream.where(condition)
    columns = [value_column(o, lambda _, c: rows[c]).alias(o.text) for o in outputs if o.field is not None]
    return rows.select(*columns)
