"""Hand-written cases of comments, strings and nesting for each family of languages."""

import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.sources import lexer, tree

CASES = {
    "rust": ('/* a /* b */ in */ fn f<\'a>(x: &\'a str) { r#"no // "x" "#; \'"\'; "//"; } // end', ["/* a /* b */ in */", "// end"], ["fn", "f", "x", "str"]),
    "haskell": ("{- a {- b -} c -} x' = y --> z -- note\n-- | doc\ns = \"{- no -}\"", ["{- a {- b -} c -}", "-- note", "-- | doc"], ["x'", "y", "z", "s"]),
    "ocaml": ('(* a (* b *) "*)" c *) let x\' = {q|(* no *)|q} \'"\' "(*" (* z *)', ['(* a (* b *) "*)" c *)', "(* z *)"], ["let", "x'"]),
    "kotlin": ('/* /* */ */ val s = """// no\n"quote" """; val c = \'"\' // yes', ["/* /* */ */", "// yes"], ["val", "s", "val", "c"]),
    "swift": ("/** a /* b\n*/ */ let n", ["/** a /* b\n*/ */"], ["let", "n"]),
    "julia": ("#= a #= b =# c =# f # tail\n\"#\" x'", ["#= a #= b =# c =#", "# tail"], ["f", "x"]),
    "javascript": ("let r = /[/'\"]\\/*x/g; a / b / c; // one\n`t ${ a + `in ${b} /* no */` } // no` /* two */ x = y\n/ 2; return /'/", ["// one", "/* two */"], ["let", "r", "a", "b", "c", "a", "b", "x", "y", "return"]),
    "typescript": ("f(`}${ {k: '}'} }`); // c", ["// c"], ["f", "k"]),
    "python": ("x = '#no' # yes\n'''# no\n''' ; r\"\\\" # no\" #", ["# yes", "#"], ["x", "r"]),
    "c++": ('auto s = R"q(/* " no)" )q"; /* a /* b */ c // d', ["/* a /* b */", "// d"], ["auto", "s", "c"]),
    "c": ('char *s = "/* no \\" */"; /* open', ["/* open"], ["char", "s"]),
    "go": ("s := `// no\n\" ` // yes", ["// yes"], ["s"]),
    "c#": ('var p = @"c:\\"; // yes', ["// yes"], ["var", "p"]),
    "lua": ('--[==[ a ]] -- b\n]==] x = [[-- no]] -- end\n--[ c', ["--[==[ a ]] -- b\n]==]", "-- end", "--[ c"], ["x"]),
    "shell": ("echo a#b '# no' \"$x # no\" # yes", ["# yes"], ["echo", "a", "b"]),
    "perl": ("$#a; # yes\n=pod\nsome\n=cut\nmy $x", ["# yes", "=pod\nsome\n=cut"], ["a", "my", "x"]),
    "ruby": ("=begin\nx\n=end\nputs \"#{y}\" # c", ["=begin\nx\n=end", "# c"], ["puts"]),
    "sql": ("SELECT '--''no' -- yes\n/* b */ FROM \"t--\"", ["-- yes", "/* b */"], ["SELECT", "FROM"]),
    "clojure": ('(def a-b \\; "x;\ny") ; c', ["; c"], ["def", "a-b"]),
    "erlang": ("f() -> $%, 'a%b', \"%\". % yes", ["% yes"], ["f"]),
    "php": ("<?php $a = '//'; # one\n// two\n/* three */", ["# one", "// two", "/* three */"], ["php", "$a"]),
    "html": ("<p>a <!-- b\n--> c", ["<!-- b\n-->"], []),
    "css": ("a-b { c: 'x' } /* d */", ["/* d */"], ["a-b", "c"]),
    "yaml": ("a: b#c # d", ["# d"], ["a", "b", "c"]),
    "json": ('{"a": 1}', [], []),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_language(language):
    text, comments, names = CASES[language]
    got = lexer.told(text, language)
    assert got[0] == comments and got[1] == names and got[2] == sum(c.count("\n") + 1 for c in comments)


def test_every_language_takes_anything_in_linear_time():
    odd = ["", None, "'" * 60_000, '"' * 60_000, "/*" * 60_000, "(*" * 60_000, "{-" * 60_000, "`${" * 40_000, "/" * 60_000, "\\" * 60_000, "--[" * 40_000, "x" * 200_000, "=begin\n" * 20_000, "r#" * 40_000, "é\x00\ud83d😀" * 20_000]
    began = time.process_time()
    for language in [*lexer.LANGUAGES, "unknown", None]:
        for text in odd:
            comments, names, lines = lexer.told(text, language)
            assert lines >= len(comments)
    assert time.process_time() - began < 60


def test_table_function(spark):
    rows = spark.createDataFrame([(i, k, CASES[k][0]) for i, k in enumerate(sorted(CASES))] + [(99, None, "x"), (98, "rust", None)], "id int, language string, content string")
    got = tree.tokens(rows).orderBy("id", "first_line").collect()
    for i, k in enumerate(sorted(CASES)):
        mine = [r for r in got if r["id"] == i]
        assert sorted(r["text"] for r in mine if r["kind"] == "comment") == sorted(CASES[k][1]) and sorted(r["text"] for r in mine if r["kind"] == "identifier") == sorted(CASES[k][2])
        assert all(r["last_line"] - r["first_line"] == r["text"].count("\n") and 1 <= r["first_line"] <= CASES[k][0].count("\n") + 1 for r in mine)
    assert not [r for r in got if r["id"] > 97]
    swift = [(r["text"], r["first_line"], r["last_line"]) for r in got if r["id"] == sorted(CASES).index("swift")]
    assert swift[0][1:] == (1, 2) and ("let", 2, 2) in swift


def test_column_and_table_function_agree(spark):
    rows = spark.createDataFrame([(i, k, CASES[k][0]) for i, k in enumerate(sorted(CASES))], "id int, language string, content string")
    by_column = {r["id"]: tuple(r["t"]) for r in rows.select("id", tree.lexed("content", "language").alias("t")).collect()}
    spans = tree.tokens(rows).filter("kind = 'comment'").groupBy("id").agg(F.sum(F.col("last_line") - F.col("first_line") + 1).alias("n"))
    assert {i: v[2] for i, v in by_column.items() if v[2]} == {r["id"]: r["n"] for r in spans.collect()}


def test_a_batch_is_lexed_in_bounded_memory():
    """A batch of many files holds the tokens of a few of them as Python strings at a time; results are those of each file."""
    texts = [f"def f{i}(a, b): # note {i}\n" + "name value other = thing\n" * 100 for i in range(3000)] + [None, ""]
    content, language = pa.array(texts), pa.array(["python"] * (len(texts) - 2) + ["python", None])
    tracemalloc.start()
    got = tree._by_lexer.func(content, language)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    joined = tree._joined_by_lexer.func(content, language)
    for i in (0, 1, 1499, 2999, 3000, 3001):
        comments, names, lines = lexer.told(texts[i], "python")
        assert got[i].as_py() == {"comments": comments, "identifiers": names, "comment_nloc": lines}
        assert joined[i].as_py() == {"comments": "\n".join(comments), "names": "\n".join(names), "comment_nloc": lines}
    assert len(got) == len(joined) == len(texts) and len(tree._by_lexer.func(content[:0], language[:0])) == 0


def test_rows_tell_first_occurrences(spark):
    """Rows say how manieth of its kind and text a token is in its file, so that distinct ones are counted without their texts."""
    rows = spark.createDataFrame([(1, "rust", "a b a // a\n a // a"), (2, "rust", "a"), (3, None, "a")], "id int, language string, content string")
    got = sorted((r["id"], r["kind"], r["text"], r["nth"], r["first_line"]) for r in tree.tokens(rows).collect())
    assert got == [(1, "comment", "// a", 1, 1), (1, "comment", "// a", 2, 2), (1, "identifier", "a", 1, 1), (1, "identifier", "a", 2, 1), (1, "identifier", "a", 3, 2), (1, "identifier", "b", 1, 1), (2, "identifier", "a", 1, 1)]
    many = pa.array(["x " * (lexer.TOKENS + 5), None, "y"])
    parts = list(lexer.token_rows(many, pa.array(["rust", "rust", "rust"])))
    assert [len(at) for at, _ in parts] == [lexer.TOKENS, 6] and parts[1][0].to_pylist() == [0] * 5 + [2] and parts[1][1][4].to_pylist() == [lexer.TOKENS + k for k in range(1, 6)] + [1]
