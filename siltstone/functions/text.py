"""Text scoring as column expressions: tokens, leetspeak, lexicons, emoji, markers, language, bots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEET_FROM, LEET_TO = "4103$5@!", "aioessai"
LANGUAGE_ALIASES = {"nb": "no", "nn": "no"}
MIN_DETECT_CHARS = 20
MARKERS = r"\b(TODO|FIXME|HACK|XXX)\b"
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
BOT_LOGINS = (
    "dependabot", "dependabot-preview", "renovate", "renovate-bot", "github-actions", "greenkeeper", "pyup-bot", "whitesource-bolt",
    "whitesource-bolt-for-github", "scala-steward", "snyk-bot", "depfu", "imgbot", "allcontributors", "stale", "codecov", "codecov-io",
    "mergify", "semantic-release-bot", "fossabot", "houndci-bot",
)
BOT_PATTERN = "(bot|dependabot|renovate|github-actions|greenkeeper)"

_PICTOGRAPH = r"(?:[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F7E0}-\x{1F7EB}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{1F004}\x{1F0CF}\x{1F170}\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F201}\x{1F202}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}\x{2600}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{2934}\x{2935}\x{3030}\x{303D}\x{3297}\x{3299}\x{203C}\x{2049}\x{2122}\x{2139}\x{00A9}\x{00AE}\x{24C2}][\x{FE0F}]?[\x{1F3FB}-\x{1F3FF}]?(?:[\x{E0020}-\x{E007E}]+\x{E007F})?)"
#: A flag, a keycap, or pictographs joined by zero-width joiners, each taken as one unit.
EMOJI = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_PICTOGRAPH}(?:\x{{200D}}{_PICTOGRAPH}|\x{{200D}}[\x{{2640}}\x{{2642}}]\x{{FE0F}}?)*"

#: Every emoji of the grammar holds one of these.
EMOJI_NEEDS = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{20E3}\x{2122}\x{2139}\x{2194}-\x{3299}\x{1F004}-\x{1FAFF}]"


#: What no emoji of the grammar holds: runs of it go before the search, as a blank parts what they parted.
EMOJI_LACKS = r"[^0-9#*\x{00A9}\x{00AE}\x{200D}\x{203C}-\x{3299}\x{FE0F}\x{1F004}-\x{1FAFF}\x{E0020}-\x{E007F}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens in order: letters, numerals, underscores, and apostrophes inside (the matches of TOKEN)."""
    return _split_words(F.lower(text))


def _split_words(low: Column) -> Column:
    """TOKEN's matches by cutting between them, which is cheaper than matching each: apostrophes at a word's ends go first."""
    bare = F.when(F.contains(low, F.lit("'")), F.regexp_replace(low, r"(?<![\p{L}\p{N}_'])'+|'+(?![\p{L}\p{N}_'])", " ")).otherwise(low)
    return F.array_remove(F.split(bare, r"[^\p{L}\p{N}_']+"), "")


def leet(text: Column) -> Column:
    return F.translate(F.lower(text), LEET_FROM, LEET_TO)


def word_set(text: Column) -> Column:
    """Distinct tokens of the text as written and with leetspeak undone; the second pass is for texts that it can change."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike("[4103$5@!]"), F.array_union(tokens(text), _split_words(leet(text)))).otherwise(F.array_distinct(tokens(text)))


def language_code(lang: Column) -> Column:
    return reduce(lambda out, kv: F.when(lang == kv[0], F.lit(kv[1])).otherwise(out), LANGUAGE_ALIASES.items(), lang)


def lexicon_hits(text: Column, lang: Column, lexicon: dict[str, list[str]]) -> Column:
    """Sorted distinct words of the text that the lexicon lists for its language or for English."""
    english = lexicon.get("en", [])
    words = F.array(*[F.lit(w) for w in sorted(set(english))]).cast("array<string>")
    for code in sorted(set(lexicon) - {"en"}):
        both = sorted({*english, *lexicon[code]})
        words = F.when(language_code(lang) == code, F.array(*[F.lit(w) for w in both]).cast("array<string>")).otherwise(words)
    return F.array_sort(F.array_intersect(word_set(text), words))


#: Scripts that settle a language, in the order in which they are tried. Kana goes before Han, Persian letters before Arabic.
SCRIPTS = {"ko": r"\x{1100}-\x{11FF}\x{AC00}-\x{D7A3}", "ja": r"\x{3041}-\x{30FF}", "zh": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}", "th": r"\x{0E01}-\x{0E5B}", "hi": r"\x{0900}-\x{097F}", "ru": r"\x{0400}-\x{04FF}", "fa": r"\x{067E}\x{0686}\x{0698}\x{06AF}\x{06CC}\x{06A9}", "ar": r"\x{0600}-\x{06FF}"}
#: Shares of a script's characters among all from which it settles the language, as one in so many.
SCRIPT_SHARE = {"ja": 20, "fa": 20}
#: Common words of the languages that share the Latin script.
COMMON_WORDS = {
    "cs": ["a", "se", "na", "je", "že", "to", "s", "z", "jsem", "pro", "ale", "jako", "není", "byl", "které"],
    "da": ["og", "det", "er", "ikke", "en", "til", "på", "af", "som", "jeg", "med", "har", "vi", "blev", "efter"],
    "de": ["der", "die", "und", "nicht", "das", "ist", "ein", "eine", "mit", "auch", "auf", "für", "von", "den", "zu", "im"],
    "en": ["the", "and", "of", "to", "is", "in", "that", "for", "it", "with", "this", "was", "on", "are", "not", "or"],
    "eo": ["la", "kaj", "estas", "en", "de", "mi", "ne", "por", "tio", "kun", "sed", "li", "ili", "al", "oni"],
    "es": ["que", "los", "del", "una", "el", "y", "en", "por", "con", "las", "para", "es", "se", "como", "un", "de", "la"],
    "fi": ["ja", "on", "ei", "se", "että", "oli", "hän", "mutta", "kun", "niin", "ovat", "tämä", "sen", "myös", "joka"],
    "fr": ["les", "des", "est", "et", "une", "le", "la", "du", "dans", "pour", "pas", "sur", "que", "un", "de", "par"],
    "hu": ["a", "az", "és", "hogy", "nem", "egy", "van", "volt", "meg", "csak", "ez", "de", "is", "mint", "ki"],
    "it": ["che", "il", "di", "non", "per", "una", "sono", "con", "del", "della", "è", "gli", "nel", "anche", "un"],
    "nl": ["de", "het", "een", "en", "van", "niet", "dat", "op", "te", "zijn", "voor", "met", "maar", "ook", "er"],
    "nb": ["og", "det", "er", "ikke", "en", "til", "på", "av", "som", "jeg", "med", "har", "vi", "ble", "etter", "fra"],
    "pl": ["i", "w", "nie", "na", "się", "z", "do", "to", "że", "jest", "o", "jak", "ale", "po", "dla"],
    "pt": ["que", "não", "o", "os", "um", "uma", "do", "da", "em", "para", "com", "é", "por", "mas", "ao"],
    "sv": ["och", "det", "är", "inte", "en", "till", "på", "av", "som", "jag", "med", "har", "vi", "ett", "efter"],
    "tr": ["ve", "bir", "bu", "için", "de", "da", "çok", "ile", "ne", "değil", "var", "gibi", "daha", "olarak", "ama"],
}


def detect_language(text: Column, hint: Column | None = None, common: dict[str, list[str]] = COMMON_WORDS) -> Column:
    """One of 24 language codes, by rule: English for short texts; else the first script that holds its share of the
    characters; else the language whose common words the text holds most of, English if it is among the best or none is
    found, then the first code. The hint wins where given; Norwegian's codes become one."""
    every = F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in sorted({w for v in common.values() for w in v})]))
    counted = F.transform(F.array(every), lambda f: F.array(*[F.struct(F.size(F.array_intersect(f, F.array(*[F.lit(w) for w in v]))).alias("n"), F.lit(0 if k != "en" else 1).alias("first"), F.lit(-i).alias("order"), F.lit(k).alias("code")) for i, (k, v) in enumerate(sorted(common.items()))]))[0]
    best = F.transform(F.array(F.array_max(counted)), lambda m: F.when(m["n"] > 0, m["code"]).otherwise("en"))[0]
    held = lambda k: F.length(text) - F.length(F.regexp_replace(text, f"[{SCRIPTS[k]}]", ""))
    by_script = best
    for k in reversed(SCRIPTS):
        by_script = F.when(held(k) * SCRIPT_SHARE.get(k, 4) >= F.length(text), F.lit(k)).otherwise(by_script)
    guess = F.when(F.coalesce(F.length(text), F.lit(0)) < MIN_DETECT_CHARS, F.lit("en")).when(text.rlike(r"[\x{0400}-\x{D7A3}]"), by_script).otherwise(best)
    guess = language_code(guess)
    return guess if hint is None else F.coalesce(language_code(hint), guess)


def normalise_emoji(glyph: Column) -> Column:
    """Without skin tones and variation selectors."""
    return F.regexp_replace(glyph, r"[\x{1F3FB}-\x{1F3FF}\x{FE0F}]", "")


def emoji(text: Column) -> Column:
    """Emoji in order with repeats, normalised, nothing empty. Texts without a character that every emoji needs one of are
    not searched, and in the others only what an emoji can hold is."""
    found = F.regexp_extract_all(F.regexp_replace(text, EMOJI_LACKS, " "), F.lit(EMOJI), F.lit(0))
    glyphs = F.filter(F.transform(found, normalise_emoji), lambda g: g != "")
    return F.when(F.coalesce(text.rlike(EMOJI_NEEDS), F.lit(False)), glyphs).otherwise(F.array().cast("array<string>"))


def marker_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(MARKERS))


def is_bot(login: Column, kind: Column | None = None, logins: tuple[str, ...] = BOT_LOGINS, pattern: str = BOT_PATTERN) -> Column:
    low = F.lower(login)
    by_name = low.endswith("[bot]") | low.isin(*logins) | login.rlike(f"(?i){pattern}")
    out = F.coalesce(by_name & (login != ""), F.lit(False))
    return out if kind is None else F.coalesce(kind == "Bot", F.lit(False)) | out


def nonblank_lines(content: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"[ \t\r\x0B\f]", "") != ""))


def iso_time(value: Column) -> Column:
    return F.try_to_timestamp(value)


def per_kloc(count: Column, loc: Column) -> Column:
    return F.when(loc > 0, count / (loc / F.lit(1000.0)))


def rate(part: Column, total: Column) -> Column:
    """part / total as a double, 0 where there is no total."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))
