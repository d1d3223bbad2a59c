"""A language model of character n-grams: profiles are counted over labelled texts by Spark, cut to each language's most
frequent n-grams, and texts are scored against the whole table in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST, PROFILE = 4, 3000  #: characters of an n-gram; n-grams that a language's profile keeps
PIECE = 1 << 16  #: characters of a text that are counted at once
MOST_KEYS = 200_000  #: words or n-grams that a task holds
MOST_CELLS = 4 << 20  #: words times languages whose sums a worker keeps, before it starts again
TOGETHER = 1 << 18  #: characters of texts whose new words are looked up together
GAPS, WORD = re.compile(r"[\W\d_]+"), re.compile(r"[^\W\d_]+")
#: For texts of Latin-1: each letter stands for itself, all else for a blank.
LATIN = bytes(k if WORD.match(chr(k)) else 32 for k in range(256))


def words(text: str | None) -> Counter:
    """How often each word of lower-cased letters occurs. Long texts are counted piece by piece."""
    out: Counter = Counter()
    at = 0
    while text and at < len(text):
        gap = GAPS.search(text, at + PIECE)  # a piece ends between words
        end = gap.end() if gap else len(text)
        low = text[at:end].lower()
        try:
            out.update(low.encode("latin-1").translate(LATIN).decode("latin-1").split())
        except UnicodeEncodeError:
            out.update(WORD.findall(low))
        at = end
    return out


def grams_of(word: str, longest: int = LONGEST) -> list[str]:
    """The n-grams of up to longest characters of a word bounded by one blank on each side, but for the blank alone."""
    bounded = f" {word} "
    out = list(word)
    for size in range(2, longest + 1):
        out += [bounded[k : k + size] for k in range(len(bounded) - size + 1)]
    return out


def grams_in(words: list[str], longest: int = LONGEST) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of many words, and of every occurrence the place of its n-gram and of its word."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters, small = np.unique(codes, return_inverse=True)  # a blank is the least
    if len(letters) ** longest >= 1 << 63:
        each = [grams_of(w, longest) for w in words]
        place = {g: i for i, g in enumerate(dict.fromkeys(chain.from_iterable(each)))}
        return list(place), np.array([place[g] for g in chain.from_iterable(each)], np.int64), np.repeat(np.arange(len(words)), [len(x) for x in each])
    blank = small == 0
    word = np.cumsum(blank) - 1
    grams, places, owners, keys = [], [], [], np.zeros(len(small), np.int64)
    whole = ~blank  # no blank between an n-gram's first and last character
    for size in range(1, min(longest, len(small)) + 1):
        keys = keys[: len(small) - size + 1] * len(letters) + small[size - 1 :]
        if size > 2:
            whole = whole[: len(keys)] & ~blank[size - 2 : size - 2 + len(keys)]
        elif size == 2:
            whole = np.ones(len(keys), bool)
        found, place = np.unique(keys[whole], return_inverse=True)
        spelt = letters[found[:, None] // len(letters) ** np.arange(size - 1, -1, -1) % len(letters)].astype("<u4")
        places.append(place + len(grams))
        owners.append(word[: len(keys)][whole])
        grams += np.ascontiguousarray(spelt).view(f"<U{size}").ravel().tolist()
    return grams, np.concatenate(places), np.concatenate(owners)


def grams(text: str | None, longest: int = LONGEST) -> Counter:
    """How often each n-gram of up to longest characters occurs in a text's words."""
    out: Counter = Counter()
    for word, n in words(text).items():
        for g in grams_of(word, longest):
            out[g] += n
    return out


def _summed(batches, add) -> Iterator[pa.RecordBatch]:
    """Rows (lang, key, n) of counters by language that add(counters, batch) fills; handed on whenever they hold many keys."""
    known: dict[str, Counter] = {}

    def told():
        for lang, c in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", "key", "n"])
        known.clear()

    for b in batches:
        for _ in add(known, b):
            if sum(map(len, known.values())) > MOST_KEYS:
                yield from told()
    yield from told()


def profiles(docs: DataFrame, text: str = "text", label: str = "lang", longest: int = LONGEST, keep: int = PROFILE) -> DataFrame:
    """(lang, gram, n, total): each language's keep most frequent n-grams (ties by the n-gram) and all of its counts, over
    every labelled row. Words are counted first, and each distinct word's n-grams once; both counts are summed in each task
    and before the shuffle; a null label or text counts for nothing."""

    def counted(batches):
        def add(known, b):
            for t, lang in zip(b.column(0), b.column(1)):
                known.setdefault(lang.as_py(), Counter()).update(words(t.as_py()))
                yield

        return _summed(batches, add)

    def cut(batches):
        def add(known, b):
            by_lang: dict[str, list[tuple[str, int]]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                by_lang.setdefault(lang, []).append((word, n))
            for lang, held in by_lang.items():
                found, place, word = grams_in([w for w, _ in held], longest)
                n = np.array([n for _, n in held], np.int64)[word]
                sums = np.zeros(len(found), np.int64)
                np.add.at(sums, place, n)
                known.setdefault(lang, Counter()).update(dict(zip(found, sums.tolist())))
                yield

        return _summed(batches, add)

    schema = "lang string, key string, n bigint"
    rows = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(text, label).mapInArrow(counted, schema)
    distinct = rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    summed = distinct.mapInArrow(cut, schema).groupBy("lang", F.col("key").alias("gram")).agg(F.sum("n").alias("n"))
    total = summed.groupBy("lang").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return summed.withColumn("place", place).filter(F.col("place") <= keep).drop("place").join(total, "lang")


class WordSums:
    """What words add to a text's score, a row for each; row 0 is for those without a known n-gram. Bounded: it is emptied
    when full, and a copy sent to a worker starts empty."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, 0))
        self.used = 0

    def __reduce__(self):
        return WordSums, ()

    def learn(self, counts: list[Counter], model: LanguageModel) -> None:
        """Keep what is needed of the words of some texts."""
        if len(self.at) > MOST_KEYS or len(self.sums) * len(model.languages) > MOST_CELLS:
            self.at, self.sums = {}, np.zeros((0, 0))
        new = list({w: None for c in counts for w in c if w not in self.at})
        if not len(self.sums):
            self.sums, self.used = np.zeros((1024, len(model.languages))), 1
        if not new:
            return
        found, place, word = grams_in(new)
        rows = np.array([model.rows.get(g, -1) for g in found], np.int64)[place]
        word, rows = word[rows >= 0], rows[rows >= 0]
        held, place = np.unique(word, return_inverse=True)
        while self.used + len(held) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        for k in range(len(model.languages)):
            self.sums[self.used : self.used + len(held), k] = np.bincount(place, model.weighted[rows, k], len(held))
        at = np.zeros(len(new), np.int64)
        at[held] = np.arange(self.used, self.used + len(held))
        self.used += len(held)
        self.at.update(zip(new, at.tolist()))


@dataclass
class LanguageModel:
    """Log-probabilities of the profiles' n-grams, a row for each n-gram and a column for each language."""

    languages: list[str]
    rows: dict[str, int]
    table: np.ndarray
    known: WordSums = field(default_factory=WordSums, repr=False, compare=False)

    @cached_property
    def weighted(self) -> np.ndarray:
        """The table's rows times their n-grams' lengths."""
        lengths = np.zeros(len(self.rows))
        for g, i in self.rows.items():
            lengths[i] = len(g)
        return self.table * lengths[:, None]

    @classmethod
    def of(cls, profile: DataFrame) -> LanguageModel:
        """The model of profiles, collected: at most PROFILE rows for each language."""
        found = profile.orderBy("lang", "gram").collect()
        languages = sorted({r["lang"] for r in found})
        rows = {g: i for i, g in enumerate(sorted({r["gram"] for r in found}))}
        totals = {r["lang"]: r["total"] for r in found}
        table = np.tile(np.array([np.log(0.5 / totals[x]) for x in languages]), (len(rows), 1)) if rows else np.zeros((0, 0))
        for r in found:
            table[rows[r["gram"]], languages.index(r["lang"])] = np.log(r["n"] / r["total"])
        return cls(languages, rows, table)

    def guesses(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """guess() of each text; the words of some are looked up together."""
        out, at = [], 0
        while at < len(texts):
            counts, size = [], 0
            while at < len(texts) and size < TOGETHER:
                counts.append(words(texts[at]))
                size += len(texts[at] or "")
                at += 1
            self.known.learn(counts, self)
            out += map(self._of, counts)
        return out

    def _of(self, counts: Counter) -> tuple[str | None, float]:
        at = np.array(list(map(self.known.at.__getitem__, counts)), np.int64)
        if not at.any():
            return None, 0.0
        z = (np.fromiter(counts.values(), float, len(counts))[:, None] * self.known.sums[at]).sum(0) / LONGEST**2
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())

    def guess(self, text: str | None) -> tuple[str | None, float]:
        """(language, its probability among the model's); null and 0 for a text without a known n-gram. Longer n-grams count
        for more, as they tell more; the sum is tempered, as n-grams overlap."""
        return self.guesses([text])[0]


def detected(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with language and confidence; null and 0 where nothing is known of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: PROFILE n-grams a language

    @F.arrow_udf("struct<language: string, confidence: double>")
    def told(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 1000):
            out += shared.value.guesses(texts.slice(at, 1000).to_pylist())
        return pa.StructArray.from_arrays([pa.array([g for g, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())], ["language", "confidence"])

    return docs.withColumn("__told", told(F.col(text))).select("*", "__told.language", "__told.confidence").drop("__told")


def confusion(guessed: DataFrame, label: str = "lang") -> DataFrame:
    """(label, language, n)."""
    return guessed.groupBy(F.col(label).alias("label"), "language").agg(F.count("*").alias("n"))


def share_right(guessed: DataFrame, label: str = "lang") -> Column:
    return F.avg((F.col(label) == F.coalesce("language", F.lit(""))).cast("double"))
