"""Source trees: which files count, their language, their comments and identifiers, and the per-repository scan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siltstone.functions import text as T
from siltstone.functions.plan import computed
from siltstone.sources import lexer

# Fixed values.
SKIP_DIRS = ("node_modules", "vendor", ".git", ".hg", ".svn", "dist", "build", ".venv", "venv", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target")
SKIP_NAMES = (".min.", ".bundle.")
MAX_BYTES = 1_048_576
PRIMARY = (
    "python", "javascript", "typescript", "jsx", "tsx", "go", "rust", "ruby", "java", "kotlin", "scala", "swift", "c", "c++", "c#", "php", "shell", "bash",
    "lua", "r", "perl", "haskell", "ocaml", "elixir", "erlang", "dart", "julia", "groovy", "objective-c", "clojure",
)
EXTENSIONS = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "jsx", "tsx": "tsx", "go": "go", "rs": "rust", "rb": "ruby", "java": "java", "kt": "kotlin",
    "scala": "scala", "swift": "swift", "c": "c", "h": "c", "cpp": "c++", "cc": "c++", "hpp": "c++", "cs": "c#", "php": "php", "sh": "shell", "bash": "bash", "lua": "lua", "r": "r",
    "pl": "perl", "hs": "haskell", "ml": "ocaml", "ex": "elixir", "exs": "elixir", "erl": "erlang", "dart": "dart", "jl": "julia", "groovy": "groovy", "m": "objective-c", "clj": "clojure",
    "css": "css", "html": "html", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "sql": "sql",
}

SLICE_BYTES = 1 << 20  #: of contents that are lexed at once: only so many tokens are Python strings at a time
_LEXED = StructType([StructField("comments", ArrayType(StringType())), StructField("identifiers", ArrayType(StringType())), StructField("comment_nloc", LongType())])
_JOINED = StructType([StructField("comments", StringType()), StructField("names", StringType()), StructField("comment_nloc", LongType())])


def _slices(content: pa.Array, language: pa.Array) -> Iterator[list[tuple[list[str], list[str], int]]]:
    """What the lexer tells of a batch's files, for some SLICE_BYTES of contents at a time."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(content), 0).cast(pa.int64())).to_numpy()
    at, before = 0, 0
    while at < len(content):
        to = max(at + 1, int(ends.searchsorted(before + SLICE_BYTES, "right")))
        yield [lexer.told(c, k) for c, k in zip(content.slice(at, to - at).to_pylist(), language.slice(at, to - at).to_pylist())]
        at, before = to, int(ends[to - 1])


def _lexed(content: pa.Array, language: pa.Array, names: list[str], made) -> pa.Array:
    """A struct of names for each file, its lists as made(), put together slice by slice."""
    parts = [pa.StructArray.from_arrays([made(c), made(n), pa.array(lines, pa.int64())], names) for c, n, lines in (zip(*told) for told in _slices(content, language))]
    return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays([made([]), made([]), pa.array([], pa.int64())], names)


@F.arrow_udf(_LEXED)
def _by_lexer(content: pa.Array, language: pa.Array) -> pa.Array:
    return _lexed(content, language, ["comments", "identifiers", "comment_nloc"], lambda lists: pa.array(lists, pa.list_(pa.string())))


@F.arrow_udf(_JOINED)
def _joined_by_lexer(content: pa.Array, language: pa.Array) -> pa.Array:
    return _lexed(content, language, ["comments", "names", "comment_nloc"], lambda lists: pa.array(["\n".join(x) for x in lists], pa.string()))


def _markup(content: Column, language: Column) -> tuple[Column, Column, Column]:
    """Whether a file is markup, its comments then, and the lines that they span."""
    markup = F.coalesce(language.isin("html", "markdown"), F.lit(False))
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?s)<!--.*?-->"), F.lit(0))
    lines = F.aggregate(found, F.lit(0).cast("bigint"), lambda n, c: n + F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1)
    return markup, found, lines


def lexed(content: Column | str, language: Column | str) -> Column:
    """comments, identifiers and comment_nloc of a file. Markup has neither strings nor names to tell apart, so a pattern
    does; the lexers get only the other files' contents."""
    content, language = (F.col(c) if isinstance(c, str) else c for c in (content, language))
    markup, found, lines = _markup(content, language)
    own = F.struct(found.alias("comments"), F.array().cast("array<string>").alias("identifiers"), lines.alias("comment_nloc"))
    return F.when(markup, own).otherwise(_by_lexer(F.when(~markup, content), language))


def lexed_texts(content: Column | str, language: Column | str) -> Column:
    """lexed() with a file's comments, and its identifiers (names), each joined to one text by line breaks."""
    content, language = (F.col(c) if isinstance(c, str) else c for c in (content, language))
    markup, found, lines = _markup(content, language)
    own = F.struct(F.array_join(found, "\n").alias("comments"), F.lit("").alias("names"), lines.alias("comment_nloc"))
    return F.when(markup, own).otherwise(_joined_by_lexer(F.when(~markup, content), language))


def tokens(files: DataFrame, content: str = "content", language: str = "language") -> DataFrame:
    """files without content, a row for each comment and identifier: kind, text, first_line, last_line, and nth:
    1 for the first of its kind and text in its file, 2 for the next."""
    kept = [f for f in files.schema if f.name != content]
    schema = StructType([*kept, *[StructField(k, t()) for k, t in (("kind", StringType), ("text", StringType), ("first_line", LongType), ("last_line", LongType), ("nth", LongType))]])

    def rows(batches):
        for b in batches:
            rest = b.select([f.name for f in kept])
            for at, found in lexer.token_rows(b.column(content), b.column(language)):
                yield pa.RecordBatch.from_arrays([*rest.take(at).columns, *found], names=schema.names)

    return files.mapInArrow(rows, schema)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of one repository's files below path, whatever is skipped neither listed nor read."""
    from siltstone.sources.tree_source import read_trees

    return read_trees(spark, path, single=True).select(F.concat(F.lit(path.rstrip("/") + "/"), F.col("path")).alias("path"), "length", "content")


def wanted(path: Column) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in SKIP_DIRS])) & ~name.contains(SKIP_NAMES[0]) & ~name.contains(SKIP_NAMES[1])


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(table, ext)


def primary_language(files: DataFrame, keys: list[str], language: str = "language") -> DataFrame:
    """The most frequent language that counts as one, the first by name among ties, for each key."""
    n = files.filter(F.col(language).isin(*PRIMARY)).groupBy(*keys, language).agg(F.count("*").alias("n"))
    best = F.min_by(F.col(language), F.struct((-F.col("n")).alias("n"), F.col(language).alias("l")))
    return files.select(*keys).distinct().join(n.groupBy(*keys).agg(best.alias("primary_language")), keys, "left")


def scan(files: DataFrame, keys: list[str], lexicon: dict[str, list[str]], top: int = 30) -> DataFrame:
    """Per repository (keys): lines, files, comment lines, lexicon and emoji hits in comments and identifiers, debt markers,
    and the top emoji.

    Every file is lexed and searched once: it becomes a row with its own figures and one for each of its glyphs, and both
    kinds are summed by repository and glyph before the shuffle.
    """
    rows = computed(files.select(*keys, T.nonblank_lines(F.col("content")).alias("loc"), lexed_texts("content", "language").alias("t")), comments=F.col("t.comments"), names=F.col("t.names"))
    hits = lambda c: F.size(T.lexicon_hits(F.col(c), F.lit("en"), lexicon))
    found = computed(rows, in_comments=T.emoji(F.col("comments")), in_names=T.emoji(F.col("names")), comment_hits=hits("comments"), name_hits=hits("names"), markers=T.marker_count(F.col("comments")))
    figures = {
        "loc_total": F.col("loc"), "files_scanned": F.lit(1), "comment_nloc": F.col("t.comment_nloc"), "comment_profanity_hits": F.col("comment_hits"), "identifier_profanity_hits": F.col("name_hits"),
        "comment_emoji_hits": F.size("in_comments"), "identifier_emoji_hits": F.size("in_names"), "tech_debt_markers": F.col("markers"),
    }
    none = F.lit(None).cast("string")
    own = F.struct(none.alias("glyph"), *[c.cast("bigint").alias(k) for k, c in figures.items()])
    one = lambda g: F.struct(g.alias("glyph"), *[(F.lit(1) if k == "files_scanned" else F.lit(0)).cast("bigint").alias(k) for k in figures])
    each = found.select(*keys, F.explode(F.concat(F.array(own), F.transform(F.concat("in_comments", "in_names"), one))).alias("f")).select(*keys, "f.*")
    summed = each.groupBy(*keys, "glyph").agg(*[F.sum(k).alias(k) for k in figures])
    mine, order = F.col("glyph").isNull(), F.struct((-F.col("files_scanned")).alias("less"), F.col("glyph").alias("key"))
    ranked = F.slice(F.array_sort(F.collect_list(F.when(~mine, order))), 1, top)  # a repository's distinct glyphs: no more than the grammar has
    entries = F.array_sort(F.transform(ranked, lambda e: F.struct(e["key"].alias("key"), (-e["less"]).alias("value"))))
    out = summed.groupBy(*keys).agg(*[F.sum(F.when(mine, F.col(k))).alias(k) for k in figures], F.map_from_entries(entries).alias("emoji_top"))
    return out.withColumn("comment_to_code_ratio", F.when(F.col("loc_total") > 0, F.col("comment_nloc") / F.col("loc_total"))).select(*keys, *figures, "comment_to_code_ratio", "emoji_top")
