"""Array functions that sources and queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def q15(block: Column) -> Column:
    """Values of an exponent-first block of whole numbers: ``m * 2 ** (e - 15)`` for each m after the exponent e."""
    factor = F.pow(F.lit(2.0), F.element_at(block, 1) - 15)
    return F.when(F.size(block) > 0, F.transform(F.slice(block, F.lit(2), F.greatest(F.size(block) - 1, F.lit(0))), lambda m: m * factor))
