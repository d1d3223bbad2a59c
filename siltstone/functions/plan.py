"""Helpers that shape plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with costly columns that are computed once: as a generator's output, they are not put in place of their uses,
    which the optimiser else does with what a later filter or projection reads."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__computed")
    return rows.select("*", made).select(*rows.columns, "__computed.*")
