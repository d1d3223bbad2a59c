"""Code metrics of a repository: the scan joined with the tools' reports, and the rates derived from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import per_kloc
from siltstone.sources import reports

FAMILIES = {"ruff": reports.ruff, "bandit": reports.bandit, "eslint": reports.eslint, "jscpd": reports.jscpd}
PER_KLOC = ("ruff_issues", "ruff_bug_issues", "ruff_style_issues", "ruff_fixable", "bandit_issues", "eslint_issues", "eslint_errors", "eslint_warnings", "eslint_fixable_errors", "eslint_fixable_warnings")


def compose(scan: DataFrame, tool_reports: DataFrame, key: str) -> DataFrame:
    """scan with the fields of every tool; tool_reports has key and a report string in a column for each tool. Missing data is null."""
    measured = reports.lizard(tool_reports, "lizard")
    parsed = measured.select(key, *reports.LIZARD, *[f(F.col(name)).alias(name) for name, f in FAMILIES.items()]).select(key, *[f"{name}.*" for name in FAMILIES], *reports.LIZARD)
    out = scan.join(parsed, key, "left")
    return out.select("*", *[per_kloc(F.col(c), F.col("loc_total")).alias(f"{c}_per_kloc") for c in PER_KLOC])
