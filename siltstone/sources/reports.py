"""Reports of external analysers as columns: each function maps a report string to a struct, null where there is no data."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.plan import computed

BUG_CODES = "^(F|E9|B|S|RUF)"  # fixed values
ESLINT = {"errorCount": "eslint_errors", "warningCount": "eslint_warnings", "fatalErrorCount": "eslint_fatal_errors", "fixableErrorCount": "eslint_fixable_errors", "fixableWarningCount": "eslint_fixable_warnings"}


def _list(report: Column, path: str = "$") -> Column:
    return F.try_variant_get(F.try_parse_json(report), path, "array<variant>")


def ruff(report: Column) -> Column:
    found = _list(report)
    code = lambda v: F.coalesce(F.try_variant_get(v, "$.code", "string"), F.lit(""))
    n = lambda test: F.size(F.filter(found, test)).cast("bigint")
    bugs = n(lambda v: code(v).rlike(BUG_CODES))
    fixable = n(lambda v: F.coalesce(~F.is_variant_null(F.try_variant_get(v, "$.fix", "variant")), F.lit(False)))
    total = F.size(found).cast("bigint")
    return F.when(found.isNotNull(), F.struct(total.alias("ruff_issues"), bugs.alias("ruff_bug_issues"), (total - bugs).alias("ruff_style_issues"), fixable.alias("ruff_fixable")))


def bandit(report: Column) -> Column:
    found = _list(report, "$.results")
    high = F.size(F.filter(found, lambda v: F.coalesce(F.try_variant_get(v, "$.issue_severity", "string") == "HIGH", F.lit(False)))).cast("bigint")
    return F.when(found.isNotNull(), F.struct(F.size(found).cast("bigint").alias("bandit_issues"), high.alias("bandit_high_severity")))


def eslint(report: Column) -> Column:
    found = _list(report)
    total = lambda key: F.aggregate(found, F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(F.try_variant_get(v, f"$.{key}", "bigint"), F.lit(0).cast("bigint")))
    sums = {name: total(key) for key, name in ESLINT.items()}
    return F.when(found.isNotNull(), F.struct((sums["eslint_errors"] + sums["eslint_warnings"]).alias("eslint_issues"), *[c.alias(k) for k, c in sums.items()]))


def jscpd(report: Column) -> Column:
    v = F.try_parse_json(report)
    dup, lines = (F.try_variant_get(v, f"$.statistics.total.{k}", "bigint") for k in ("duplicatedLines", "lines"))
    return F.when(dup.isNotNull() & lines.isNotNull(), F.struct(dup.alias("jscpd_duplicate_lines"), lines.alias("jscpd_total_lines"), F.when(lines > 0, dup / lines).alias("jscpd_duplicate_rate")))


#: What is read of a complexity report; a report that does not parse leaves its text in the last column.
CPPNCSS = "measure array<struct<_type: string, labels: struct<label: array<string>>, item: array<struct<value: array<string>>>>>, _corrupt_record string"
LIZARD = ("lizard_avg_ccn", "lizard_max_ccn", "lizard_functions", "lizard_ccn_p50", "lizard_ccn_p90", "lizard_ccn_p99", "lizard_nloc_p90")


def interpolated(xs: Column, q: float) -> Column:
    """The q-quantile of a sorted array of numbers, linear between neighbours; null for less than two."""
    k = (F.size(xs) - 1) * F.lit(q)
    lo = F.floor(k).cast("int")
    a, b = F.try_element_at(xs, lo + 1), F.try_element_at(xs, F.least(lo + 2, F.size(xs)))
    return F.when(F.size(xs) >= 2, a + (b - a) * (k - lo))


def functions(rows: DataFrame, report: str) -> DataFrame:
    """rows with nlocs and ccns: the sorted figures of the functions in each row's XML report, empty where there is none.

    Each report is parsed once, by Spark's XML reader, and nothing is shuffled: a report lists its own functions. The first
    measure of type Function counts, its lines of code under NCSS or else NLOC. A function with too few values or an nloc
    that is no whole number is left out; one whose ccn alone is none keeps its nloc.
    """
    whole = lambda v, at: F.try_element_at(v, F.col(at)).try_cast("bigint")
    place = lambda *names: F.coalesce(*[F.nullif(F.array_position("__m.labels.label", n).cast("int"), F.lit(0)) for n in names])
    whole_report = F.rtrim(F.col(report), F.lit(" \t\r\n")).endswith("</cppncss>")  # the reader does not look beyond the root's end
    parsed = computed(rows, __x=F.from_xml(F.when(whole_report, F.col(report)), F.lit(CPPNCSS), {"mode": "PERMISSIVE"}))
    measure = F.when(F.col("__x._corrupt_record").isNull(), F.try_element_at(F.filter("__x.measure", lambda m: m["_type"] == "Function"), F.lit(1)))
    placed = computed(computed(parsed, __m=measure), __at=F.struct(place("NCSS", "NLOC").alias("nloc"), place("CCN").alias("ccn")))
    values = F.filter("__m.item.value", lambda v: F.size(v) >= F.greatest("__at.nloc", "__at.ccn"))
    pairs = F.filter(F.transform(values, lambda v: F.struct(whole(v, "__at.nloc").alias("nloc"), whole(v, "__at.ccn").alias("ccn"))), lambda p: p["nloc"].isNotNull())
    found = computed(placed, __p=F.when(F.col("__at.nloc").isNotNull() & F.col("__at.ccn").isNotNull(), pairs))
    side = lambda c: F.coalesce(F.array_sort(F.array_compact(F.col(f"__p.{c}"))), F.array().cast("array<bigint>"))
    return computed(found, nlocs=side("nloc"), ccns=side("ccn")).drop("__x", "__m", "__at", "__p")


def lizard(rows: DataFrame, report: str) -> DataFrame:
    """rows with the LIZARD fields: mean, largest and count of complexity, and percentiles from two functions on; all null
    for a report without functions."""
    n = F.size("ccns")
    several = lambda c: F.when(n >= 2, c)
    mean = F.aggregate("ccns", F.lit(0).cast("bigint"), lambda a, v: a + v) / n
    fields = (mean, F.array_max("ccns"), n.cast("bigint"), *(interpolated(F.col("ccns"), q) for q in (0.5, 0.9, 0.99)), several(F.floor(interpolated(F.col("nlocs"), 0.9))))
    return functions(rows, report).withColumns({name: F.when(n > 0, c) for c, name in zip(fields, LIZARD)}).drop("ccns", "nlocs")


def tool_families(language: Column) -> Column:
    """Which tools run on a repository of that primary language."""
    low = F.lower(language)
    return F.when(low == "python", F.array(F.lit("ruff"), F.lit("bandit"))).when(low.isin("javascript", "typescript", "jsx", "tsx"), F.array(F.lit("eslint"))).otherwise(F.array().cast("array<string>"))


def run_tool(argv: list[str], timeout: float) -> str | None:
    """Standard output of an external tool; None when it is missing, fails to start or takes too long."""
    try:
        return subprocess.run(argv, capture_output=True, text=True, timeout=timeout).stdout
    except (OSError, subprocess.TimeoutExpired):
        return None
