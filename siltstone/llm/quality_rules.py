"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores one failure bit per rule beside the measurements. A policy
is a named, versioned mask: a document is kept when none of the policy's bits is set. Ablations come from the counts of
masked bit patterns alone, so a new policy or a what-if never reads a text again. A ledger kept under a path is opened by it
later; it says which rules its bits stand for, so a policy that names others is refused.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import each_row, staged

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BEYOND = re.compile("[^\x00-\x7f]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_cased")

#: Rule name -> SQL over the measurements, true where the document fails. The position is the rule's bit; append only.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 2 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "shouting": "n_cased >= 100 AND 10 * n_upper > 6 * n_cased",
}
BASE = ("too_few_words", "repeated_windows")
POLICIES = {"v1": BASE, "v2": tuple(RULES)}
LEDGER_SCHEMA = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)


#: The ledger's column of bits carries the rules that they stand for, name and condition in order of bits.
RULES_KEY = "rules"


def rules_of(rows: DataFrame) -> dict[str, str]:
    """The rules that a ledger's bits stand for; today's where it does not say."""
    told = rows.schema["fail_bits"].metadata.get(RULES_KEY)
    return dict(json.loads(told)) if told else RULES


def mask_of(version: str, rules: dict[str, str] | None = None) -> int:
    """The bits of a policy. Refused where the ledger (rules) lacks a rule that the policy names, or had another condition for it."""
    rules = RULES if rules is None else rules
    lacking = [r for r in POLICIES[version] if rules.get(r) != RULES[r]]
    if lacking:
        raise ValueError(f"the ledger was made without, or with other conditions for: {', '.join(lacking)}")
    return sum(1 << list(rules).index(r) for r in POLICIES[version])


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text; words are runs of other than space and \\x09-\\x0D."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    gaps = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    data = text.encode("utf-8", "surrogatepass")
    n_upper = len(data) - len(data.translate(None, UPPER))
    n_lower = len(data) - len(data.translate(None, LOWER))
    if len(data) > len(text):
        beyond = Counter(BEYOND.findall(text))
        n_upper += sum(k for c, k in beyond.items() if c.isupper())
        n_lower += sum(k for c, k in beyond.items() if c.islower())
    return n, len(text) - gaps, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), n_upper, n_upper + n_lower


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the measurements, and fail_bits (bit i: rule i of RULES fails).

    A null text has no words; it fails only too_few_words. Null or repeated ids and rows are carried as they are, other
    columns are ignored, an empty table gives an empty ledger. Written once to path, which open_ledger reads later, else below
    spark.checkpoint.dir, and read from there; a path that holds a ledger already is an error.
    No shuffle; a text is held alone, whatever its length.
    """

    def run(batches):
        for b in batches:
            cols = list(zip(*(measure(t) for _, t in each_row(b)))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *MEASURES])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, LEDGER_SCHEMA)
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0)).cast("bigint")
    told = rows.select("*", bits.alias("fail_bits", metadata={RULES_KEY: json.dumps(list(RULES.items()))}))
    if path is None:
        return staged(told, "quality-ledger")
    told.write.parquet(path)
    return open_ledger(docs.sparkSession, path)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that was written to path, with the rules of its time; no text is read."""
    return spark.read.parquet(path)


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Add kept: no rule of that policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(mask_of(version, rules_of(rows))) == 0)


def ablations(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents kept if that rule alone were left out of the policy.

    The ledger is first counted by masked pattern (at most 2**rules rows), so the work after the scan does not grow.
    """
    rules = rules_of(rows)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(mask_of(version, rules)).alias("bits")).agg(F.count("*").alias("n"))
    names = list(rules)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[version]])).alias("r")
    return patterns.select("bits", "n", each).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
