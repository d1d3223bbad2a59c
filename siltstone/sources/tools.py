"""External programs as a step of a plan: a command for each row, and what it prints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.sources.reports import run_tool


def run_tools(rows: DataFrame, key: str, timeout: float) -> DataFrame:
    """(key, output) of rows (key, argv); output is null where the program is missing, does not start or takes too long.
    The programs must be installed where the executors run; a task runs its rows' programs one after another."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "output": pd.Series([run_tool(list(a), timeout) if a is not None else None for a in b["argv"]], dtype=object)})

    return rows.select(key, "argv").mapInPandas(run, f"`{key}` {kind}, output string")
