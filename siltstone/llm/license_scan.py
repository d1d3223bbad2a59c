"""Licence scan: base phrases, and an exact set-similarity join of text blocks with licence templates.

DataFrame functions only. A block is a line of the text; it matches a template when it holds at least `threshold` of the
template's distinct words. A notice wrapped over lines is found by windows of as many consecutive words as the template
has, looked at only in texts that hold enough of its words in all; a window is a block of its own when it holds more of
them than every line it touches. Tokens are put in global order, rarest first, by their counts over the blocks of all
documents. A block reaches the threshold only if it has need distinct words of the templates' (length filter), and the
first word in that order that it shares with a template is among the template's first |T| - need + 1 (prefix filter) and
leaves need words, itself included, in the block (positional filter); what passes is verified exactly.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import staged

#: Phrase (consecutive words) -> label. Fixed values.
BASE_PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
#: Label -> template text. A parameter of fixed size; its words bound what is broadcast.
TEMPLATES = {
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither digit nor letter, without the line feed.
SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) not in "\n0123456789" + UPPER + LOWER)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    score is the best containment of a matching block, 1 with a base phrase, else 0; blocks lists (block, label, containment)
    of every match; a wrapped notice has the number of its first line, and the best windows that do not overlap are given.
    Null and empty texts have no words and no labels; null or repeated ids and equal rows are each answered by themselves
    (rows are told apart by a key given when they are staged); of windows that tie, the first counts. Other columns are
    ignored; an empty table gives no rows. A very long text is one row until its blocks are exploded. Blocks of one
    document never meet in one task except as that document's own matches.
    """
    sets = {label: list(dict.fromkeys(words_of(t))) for label, t in templates.items()}
    sets = {label: t for label, t in sets.items() if t}
    vocab = F.array(*[F.lit(w) for w in sorted({w for t in sets.values() for w in t})]).cast("array<string>")
    need = {label: max(1, math.ceil(threshold * len(t) - 1e-9)) for label, t in sets.items()}
    width = {label: len(words_of(templates[label])) for label in sets}

    plain = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    rows = docs.select(F.col(id_col).alias("doc_id"), plain.alias("__plain"))
    line = F.trim(F.regexp_replace("__plain", "[ \\n]+", " "))
    rows = rows.withColumn("__line", line)
    n_words = F.when(F.col("__line") == "", 0).otherwise(F.length("__line") - F.length(F.replace("__line", F.lit(" "), F.lit(""))) + 1).cast("bigint")

    def places(phrase: tuple[str, ...]) -> F.Column:
        w = F.split("__line", " ")
        shifted = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(len(phrase))])
        hit = lambda s: reduce(lambda a, b: a & b, [s[f"w{i}"] == p for i, p in enumerate(phrase)])
        starts = F.filter(F.transform(shifted, lambda s, i: F.when(hit(s), i.cast("bigint"))), lambda i: i.isNotNull())
        return F.when(F.contains("__line", F.lit(" ".join(phrase))), starts).otherwise(F.array().cast("array<bigint>"))

    for k, phrase in enumerate(BASE_PHRASES):
        rows = rows.withColumn(f"__at{k}", places(phrase))
    found = [F.col(f"__at{k}") for k in range(len(BASE_PHRASES))]
    every = F.concat(*found)
    base = F.filter(F.array(*[F.when(F.size(at) > 0, F.lit(label)) for at, label in zip(found, BASE_PHRASES.values())]), lambda x: x.isNotNull())

    def block(text: F.Column, i: F.Column) -> F.Column:
        return F.struct(i.cast("bigint").alias("block"), F.array_intersect(F.split(text, " +"), vocab).alias("toks"))

    blocks = F.filter(F.transform(F.split("__plain", "\n"), block), lambda b: F.size(b["toks"]) > 0)
    held = F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["toks"])))
    near = reduce(lambda a, b: a | b, [F.size(F.array_intersect(held, F.array(*map(F.lit, t)))) >= need[label] for label, t in sets.items()], F.lit(False))
    # (line, word) of all words, then the place of those that templates have; only for texts that may hold a template.
    words = F.flatten(F.transform(F.split("__plain", "\n"), lambda x, i: F.transform(F.filter(F.split(x, " +"), lambda w: w != ""), lambda w: F.struct(i.cast("bigint").alias("line"), w.alias("tok")))))
    numbered = F.transform(words, lambda x, i: F.struct(i.alias("pos"), x["line"].alias("line"), x["tok"].alias("tok")))
    places_of = F.when(near & F.contains("__plain", F.lit("\n")), F.filter(numbered, lambda x: F.array_contains(vocab, x["tok"])))
    kept = staged(
        rows.select(
            F.monotonically_increasing_id().alias("__rid"), "doc_id", n_words.alias("n_words"), F.size(every).cast("bigint").alias("n_base"),
            F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), base.alias("__base"), blocks.alias("__blocks"), places_of.alias("__places"),
        ),
        "license-rows",
    )
    each = kept.select("__rid", F.explode("__blocks").alias("b")).select("__rid", "b.*")
    counts = dict(each.select(F.explode("toks").alias("tok")).groupBy("tok").count().collect())  # at most one row per template word

    rank = {w: i for i, w in enumerate(sorted({w for t in sets.values() for w in t}, key=lambda w: (counts.get(w, 0), w)))}
    prefixes = [(w, label, len(t), need[label], t) for label, t in sets.items() for w in sorted(t, key=rank.get)[: len(t) - need[label] + 1]]
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(prefixes, "tok string, label string, size int, need int, words array<string>"))
    places = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]) if rank else F.create_map().cast("map<string,int>")
    in_order = F.array_sort(F.transform("toks", lambda w: F.struct(F.try_element_at(places, w).alias("rank"), w.alias("tok"))))
    least = min(need.values(), default=1)
    # A block's own prefix: past it, fewer distinct words are left than the least that any template needs.
    first = F.slice(in_order, 1, F.greatest(F.size("toks") - least + 1, F.lit(0)))
    hits = each.filter(F.size("toks") >= least).select("__rid", "block", "toks", F.posexplode(first).alias("pos", "at")).select("__rid", "block", "toks", "pos", "at.tok").join(table, "tok")
    hits = hits.filter(F.size("toks") - F.col("pos") >= F.col("need"))
    shared = F.size(F.array_intersect("toks", "words"))
    hits = hits.filter(shared >= F.col("need")).select("__rid", F.struct("block", "label", (shared / F.col("size")).alias("containment")).alias("m"))
    per_doc = hits.unionByName(wrapped(kept, sets, need, width)).groupBy("__rid").agg(F.array_sort(F.collect_set("m")).alias("blocks"))
    out = kept.join(per_doc, "__rid", "left")
    found_labels = F.coalesce(F.col("blocks.label"), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("__base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("__base", found_labels))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "blocks",
    )


def wrapped(kept: DataFrame, sets: dict[str, list[str]], need: dict[str, int], width: dict[str, int]) -> DataFrame:
    """(__rid, m) of windows over line breaks that hold more of a template than each line they touch."""
    given = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, t)).alias("words"), F.lit(need[label]).alias("need"), F.lit(width[label]).alias("width")) for label, t in sets.items()])
    if not sets:
        return kept.sparkSession.createDataFrame([], "__rid bigint, m struct<block: bigint, label: string, containment: double>")
    each = kept.filter("__places IS NOT NULL").select("__rid", "__blocks", "__places", F.explode(given).alias("t")).select("__rid", "__blocks", "t.*", F.filter("__places", lambda x: F.array_contains(F.col("t.words"), x["tok"])).alias("at"))
    each = each.filter(F.size(F.array_distinct("at.tok")) >= F.col("need"))

    def window(x, i):
        inside = F.filter(F.slice("at", i + 1, F.col("width")), lambda y: y["pos"] < x["pos"] + F.col("width"))
        return F.struct(x["pos"].alias("pos"), x["line"].alias("line"), F.array_max(F.transform(inside, lambda y: y["line"])).alias("last"), F.size(F.array_distinct(F.transform(inside, lambda y: y["tok"]))).alias("n"))

    # The rows of a text stay as arrays up to here; the filter is over a generated column, so windows are counted once.
    found = each.select("__rid", "__blocks", "label", "words", "need", "width", F.explode(F.transform("at", window)).alias("w")).filter("w.n >= need AND w.last > w.line")
    lines = F.filter("__blocks", lambda b: (b["block"] >= F.col("w.line")) & (b["block"] <= F.col("w.last")))
    best = F.coalesce(F.array_max(F.transform(lines, lambda b: F.size(F.array_intersect(b["toks"], F.col("words"))))), F.lit(0))
    found = found.filter(F.col("w.n") > best)
    order = F.struct((-F.col("w.n")).alias("less"), F.col("w.pos").alias("pos"), F.col("w.line").alias("line"))
    by_text = found.groupBy("__rid", "label").agg(F.array_sort(F.collect_list(order)).alias("all"), F.first("width").alias("width"), F.first(F.size("words")).alias("size"))
    apart = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["pos"] - x["pos"]) < F.col("width")), acc).otherwise(F.concat(acc, F.array(x))))
    one = by_text.select("__rid", "label", "size", F.explode(apart).alias("w"))
    return one.select("__rid", F.struct(F.col("w.line").alias("block"), "label", (-F.col("w.less") / F.col("size")).alias("containment")).alias("m"))


def oracle_sql(threshold: float = 0.8) -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{label}', {quoted(dict.fromkeys(words_of(t)))})" for label, t in TEMPLATES.items())
    word = r"[0-9a-z\x{80}-\x{10FFFF}]+"
    hit = lambda p: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
    places = ", ".join(f"list_filter(range(len(w)), lambda i: {hit(p)}) AS at{k}" for k, p in enumerate(BASE_PHRASES))
    base = ", ".join(f"CASE WHEN len(at{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE_PHRASES.values()))
    every = "list_concat(list_concat(at0, at1), at2)"
    return f"""
WITH t(label, words) AS (VALUES {rows}),
d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '{word}') AS w FROM d),
p AS (SELECT doc_id, low, w, {places} FROM w),
q AS (SELECT doc_id, len(w) AS n_words, {every} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{word}')) AS b FROM d),
m AS (SELECT doc_id, label, max(len(list_intersect(words, b)) / len(words)) AS score FROM l, t WHERE len(list_intersect(words, b)) >= greatest(1, ceil({threshold} * len(words) - 1e-9)) GROUP BY ALL),
g AS (SELECT doc_id, list(label) AS found, max(score) AS score FROM m GROUP BY doc_id)
SELECT q.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM q LEFT JOIN g USING (doc_id)
"""
