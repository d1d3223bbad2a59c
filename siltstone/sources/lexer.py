"""Comments and identifiers of source text: a state machine over the tokens of each language, with a stack for what nests.

It is a lexer, not a grammar: it knows which characters open and close comments, strings, raw strings, regular expressions
and templates, and whether they nest. lex() serves a column function and rows of tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import functions as F

COMMENT, NAME = "comment", "identifier"
NAMES = r"[^\W\d]\w*"
DOUBLE, SINGLE = r'"(?:\\[\s\S]|[^"\\\n])*"?', r"'(?:\\[\s\S]|[^'\\\n])*'?"
DOUBLE_LINES, SINGLE_LINES = r'"(?:\\[\s\S]|[^"\\])*"?', r"'(?:\\[\s\S]|[^'\\])*'?"
TRIPLE = r'"""(?:\\[\s\S]|[^\\])*?(?:"""|\Z)', r"'''(?:\\[\s\S]|[^\\])*?(?:'''|\Z)"
CHAR = r"'(?:\\[^'\n]*|[^'\\\n])'"


@dataclass(frozen=True)
class Language:
    """line: patterns of comments up to the line's end; block: pairs that open and close a comment; nests: whether they do;
    strings: patterns of what holds neither comments nor names, tried in order before comments; quoted: strings inside
    comments hide what closes them; regex: a slash after no value opens a literal; template: backquotes hold code in ${}."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    nests: bool = False
    strings: tuple[str, ...] = (DOUBLE, SINGLE)
    names: str = NAMES
    quoted: bool = False
    regex: bool = False
    template: bool = False


C = (("/*", "*/"),)
_SCRIPT = Language((r"//",), C, names=r"[^\W\d][\w$]*|\$[\w$]*", regex=True, template=True)
_PYTHON = Language((r"#",), strings=(*TRIPLE, DOUBLE, SINGLE))
_BRACES = Language((r"//",), C, strings=(TRIPLE[0], DOUBLE, CHAR, SINGLE))
_NESTED = Language((r"//",), C, True, (TRIPLE[0], DOUBLE, CHAR))
_PLAIN = Language((r"//",), C, strings=(DOUBLE, SINGLE))
LANGUAGES = {
    "python": _PYTHON, "toml": _PYTHON, "elixir": _PYTHON, "r": Language((r"#",), strings=(DOUBLE_LINES, SINGLE_LINES)),
    "ruby": Language((r"#",), ((r"^=begin\b", r"^=end\b[^\n]*"),), strings=(DOUBLE_LINES, SINGLE_LINES)),
    "perl": Language((r"(?<!\$)#",), ((r"^=[a-z]\w*", r"^=cut\b[^\n]*"),), strings=(DOUBLE_LINES, SINGLE_LINES)),
    "julia": Language((r"#(?!=)",), (("#=", "=#"),), True, (TRIPLE[0], DOUBLE_LINES, CHAR)),
    "shell": Language((r"(?<![^\s;&|()])#",), strings=(DOUBLE_LINES, r"'[^']*'?")), "bash": Language((r"(?<![^\s;&|()])#",), strings=(DOUBLE_LINES, r"'[^']*'?")),
    "yaml": Language((r"(?<!\S)#",)),
    "javascript": _SCRIPT, "typescript": _SCRIPT, "jsx": _SCRIPT, "tsx": _SCRIPT,
    "rust": Language((r"//",), C, True, (r'b?r(?P<hashes>#*)"[\s\S]*?(?:"(?P=hashes)|\Z)', DOUBLE_LINES, CHAR, r"'[^\W\d]\w*")),
    "kotlin": _NESTED, "scala": _NESTED, "swift": _NESTED, "dart": Language((r"//",), C, True, (*TRIPLE, DOUBLE, SINGLE)),
    "c": _PLAIN, "objective-c": _PLAIN, "c++": Language((r"//",), C, strings=(r'R"(?P<mark>[^\s()\\]{0,16})\([\s\S]*?(?:\)(?P=mark)"|\Z)', DOUBLE, SINGLE)),
    "c#": Language((r"//",), C, strings=(r'"{3,}[\s\S]*?(?:"{3,}|\Z)', r'\$?@\$?"(?:""|[^"])*"?', DOUBLE, CHAR)),
    "java": _BRACES, "groovy": Language((r"//",), C, strings=(*TRIPLE, DOUBLE, SINGLE)), "go": Language((r"//",), C, strings=(r"`[^`]*`?", DOUBLE, CHAR)),
    "php": Language((r"//", r"#(?!\[)"), C, strings=(DOUBLE_LINES, SINGLE_LINES), names=r"\$?[^\W\d]\w*"), "css": Language((), C, names=r"[^\W\d][\w-]*"),
    "lua": Language((r"--(?!\[=*\[)",), ((r"--\[(?P<level>=*)\[", r"\](?P=level)\]"),), strings=(r"\[(?P<long>=*)\[[\s\S]*?(?:\](?P=long)\]|\Z)", DOUBLE, SINGLE)),
    "haskell": Language((r"--+(?![!#$%&*+./<=>?@\\^|~:-])",), (("{-", "-}"),), True, (DOUBLE, CHAR), names=r"[^\W\d][\w']*"),
    "sql": Language((r"--",), C, strings=(r"'(?:''|[^'])*'?", r'"(?:""|[^"])*"?')),
    "clojure": Language((r";",), strings=(r"\\.", DOUBLE_LINES), names=r"[^\W\d][\w*+!?-]*"), "erlang": Language((r"%",), strings=(r"\$\\?.", DOUBLE_LINES, SINGLE_LINES)),
    "ocaml": Language((), (("(*", "*)"),), True, (r"\{(?P<tag>[a-z_]*)\|[\s\S]*?(?:\|(?P=tag)\}|\Z)", DOUBLE_LINES, CHAR), names=r"[^\W\d][\w']*", quoted=True),
    "html": Language((), (("<!--", "-->"),), strings=(), names=""), "markdown": Language((), (("<!--", "-->"),), strings=(), names=""),
}

REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
IN_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
#: After these a slash divides; after other words, as after an operator, it opens a regular expression.
VALUE_ENDS = frozenset(")]}")
NO_VALUE = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())


@cache
def _machine(name: str) -> tuple[re.Pattern, list[tuple[str, re.Pattern | None]]]:
    """The pattern of a language's tokens, and for each kind of block its closing and, where it nests, opening patterns."""
    k = LANGUAGES[name]
    fixed = lambda p: p if p.startswith(("^", "--", r"\]")) else re.escape(p)
    parts = [f"(?P<string>{'|'.join(k.strings)})"] if k.strings else []
    parts += [f"(?P<block{i}>{fixed(a)})" for i, (a, _) in enumerate(k.block)]
    parts += [f"(?P<line>(?:{'|'.join(k.line)})[^\\n]*)"] if k.line else []
    parts += [f"(?P<name>{k.names})"] if k.names else []
    parts += [r"(?P<mark>[`{}])"] if k.template else []
    parts += [r"(?P<slash>/)"] if k.regex else []
    if k.block and k.strings and name in ("ocaml", "haskell", "lua", "julia"):  # what opens a block could open a string or a line
        parts.insert(0, parts.pop(1))
    ends = []
    for a, b in k.block:
        inner = [f"(?P<close>{fixed(b)})"] + ([f"(?P<open>{fixed(a)})"] if k.nests else []) + ([f"(?P<string>{'|'.join(k.strings)})"] if k.quoted else [])
        ends.append((b, re.compile("|".join(inner), re.M) if "(?P=" not in b else None))
    return re.compile("|".join(parts), re.M), ends


def _block_end(text: str, m: re.Match, closing: str, inner: re.Pattern | None) -> int:
    """Where the comment that m opens ends: past the close of the same depth, or the text's end."""
    if inner is None:  # the close repeats part of the opening
        end = text.find(f"]{m['level']}]", m.end())
        return len(text) if end < 0 else end + 2 + len(m["level"])
    depth, at = 1, m.end()
    while depth:
        n = inner.search(text, at)
        if n is None:
            return len(text)
        depth += 1 if n.lastgroup == "open" else -1 if n.lastgroup == "close" else 0
        at = n.end()
    return at


def _template_end(text: str, at: int) -> tuple[int, bool]:
    """Past the end of the template text from at, and whether code begins there."""
    while True:
        n = IN_TEMPLATE.search(text, at)
        if n is None:
            return len(text), False
        at = n.end()
        if n[0] in ("`", "${"):
            return at, n[0] == "${"


def lex(text: str | None, language: str | None) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the comments and identifiers in order; nothing for an unknown language. An unclosed comment or
    raw string reaches to the end. The time is linear in the text."""
    if not text or language not in LANGUAGES:
        return
    pattern, ends = _machine(language)
    k = LANGUAGES[language]
    at, last_end, value, braces = 0, 0, False, []  # braces: depth of { in each open ${
    while True:
        m = pattern.search(text, at)
        if m is None:
            return
        start, at = m.span()
        if not k.regex and m.lastgroup == "name":  # most tokens
            yield NAME, start, at
            continue
        if k.regex:
            gap = text[last_end:start].rstrip()
            value = gap[-1] in VALUE_ENDS or gap[-1].isdigit() if gap else value
        if k.names and m["name"] is not None:
            yield NAME, start, at
            value = text[start:at] not in NO_VALUE
        elif k.line and m["line"] is not None:
            yield COMMENT, start, at
        elif k.regex and m["slash"] is not None:
            literal = None if value else REGEX.match(text, start)
            at, value = (literal.end(), True) if literal else (at, False)
        elif k.template and m["mark"] is not None:
            if m[0] == "{":
                value = False
                if braces:
                    braces[-1] += 1
            elif m[0] == "}" and braces and braces[-1]:
                braces[-1] -= 1
                value = True
            elif m[0] == "`" or braces:
                if m[0] == "}":
                    braces.pop()
                at, code = _template_end(text, at)
                value = not code
                if code:
                    braces.append(0)
            else:
                value = False
        else:
            block = next((i for i in range(len(ends)) if m[f"block{i}"] is not None), None)
            if block is not None:
                at = _block_end(text, m, *ends[block])
                yield COMMENT, start, at
            else:
                value = True
        last_end = at
        if at == start:
            at += 1


def told(text: str | None, language: str | None) -> tuple[list[str], list[str], int]:
    """(comments, identifiers, lines that comments span)."""
    comments, names = [], []
    for kind, a, b in lex(text, language):
        (comments if kind == COMMENT else names).append(text[a:b])
    return comments, names, sum(c.count("\n") + 1 for c in comments)


TOKENS = 1 << 14  #: rows of tokens that leave Python at once
_TOKEN = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())


def token_rows(text: pa.Array, language: pa.Array) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """A row for each comment and identifier of a batch's files, TOKENS at a time: the places of their files in the batch,
    and kind, text, first and last line, counted from 1, and the how manieth of its kind and text in its file a token is."""
    held: tuple[list, ...] = ([], [], [], [], [], [])

    def told():
        out = pa.array(held[0], pa.int64()), [pa.array(c, t) for c, t in zip(held[1:], _TOKEN)]
        for c in held:
            c.clear()
        return out

    at, kinds, texts, first, last, nth = held
    for i in range(len(text)):
        body, line, upto = text[i].as_py(), 1, 0
        met: dict[str, dict[str, int]] = {COMMENT: {}, NAME: {}}
        for kind, a, b in lex(body, language[i].as_py()):
            line += body.count("\n", upto, a)
            at.append(i)
            kinds.append(kind)
            token = body[a:b]
            texts.append(token)
            before = met[kind]
            before[token] = n = before.get(token, 0) + 1
            nth.append(n)
            first.append(line)
            if kind == COMMENT:  # a name holds no line break
                line += body.count("\n", a, b)
            last.append(line)
            upto = b
            if len(at) >= TOKENS:
                yield told()
    if at:
        yield told()
