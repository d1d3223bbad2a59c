"""The n-gram model: held-out accuracy on the table's labels, short texts, and profiles against a plain count."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import language

SF = "/root/testdata/sf0.01"


def test_profiles_count_every_labelled_text(spark):
    rows = [("the cat, the hat", "en"), ("THE 9 end", "en"), ("le chat", "fr"), (None, "fr"), ("x", None), ("", "en"), ("le " * 40_000, "fr")]
    got = language.profiles(spark.createDataFrame(rows, "text string, lang string"), keep=50).collect()
    want = defaultdict(Counter)
    for t, lang in rows:
        if t is not None and lang:
            for word in "".join(c if c.isalpha() else " " for c in t.lower()).split():
                b = f" {word} "
                for size in range(1, 5):
                    want[lang].update(b[k : k + size] for k in range(len(b) - size + 1))
    for c in want.values():
        c.pop(" ")
    best = {(lang, g): n for lang, c in want.items() for g, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:50]}
    assert {(r["lang"], r["gram"]): r["n"] for r in got} == best
    assert {r["lang"]: r["total"] for r in got} == {lang: sum(c.values()) for lang, c in want.items()}


def test_held_out_accuracy(spark):
    """Fitted on four fifths of the documents: whole texts, and pieces of 20 to 60 characters, of the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").filter("lang IS NOT NULL")
    model = language.LanguageModel.of(language.profiles(docs.filter("doc_id % 5 <> 0")))
    held = docs.filter("doc_id % 5 = 0")
    whole = language.detected(held, model).agg(language.share_right(held).alias("right")).first()["right"]
    size = (F.pmod(F.xxhash64("doc_id"), F.lit(41)) + 20).cast("int")
    short = held.withColumn("text", F.substr("text", F.lit(1), size)).filter("length(text) >= 20")
    told = language.detected(short, model)
    few = told.agg(language.share_right(held).alias("right"), F.count("*").alias("n")).first()
    print("held-out accuracy: whole", whole, "short", few["right"], few["n"])
    assert whole >= 0.97 and few["right"] >= 0.9 and few["n"] > 100


def test_what_is_not_known(spark):
    model = language.LanguageModel.of(language.profiles(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string")))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "\u4e00\u4e8c")], "id int, text string")
    got = {r["id"]: (r["language"], r["confidence"]) for r in language.detected(rows, model).collect()}
    assert got[1] == got[2] == got[3] == got[5] == (None, 0.0) and got[4][0] == "en" and 0.5 < got[4][1] <= 1
    none = language.LanguageModel.of(language.profiles(rows.limit(0).withColumn("lang", F.lit("en"))))
    assert language.detected(rows, none).filter("language IS NULL").count() == 5
    assert [tuple(r) for r in language.confusion(language.detected(rows.withColumn("lang", F.lit("en")), model).filter("id = 4")).collect()] == [("en", "en", 1)]


def test_words_are_cut_once_and_score_as_their_ngrams(spark, monkeypatch):
    """A text's score is the sum over its n-grams, told by its words; a word that was met is not cut again."""
    texts = ["the cat, the hat", "le chat d'été", "THE 9 end x", "le " * 40_000, "一二 the", "İx a’b", None, "", "12 !"]
    model = language.LanguageModel.of(language.profiles(spark.createDataFrame([(t, ("en", "fr")[i % 2]) for i, t in enumerate(texts)], "text string, lang string")))

    def plain(text):
        held = [(model.table[model.rows[g]], n * len(g)) for g, n in language.grams(text).items() if g in model.rows]
        if not held:
            return None, 0.0
        z = sum(row * n for row, n in held) / language.LONGEST**2
        p = np.exp(z - z.max())
        return model.languages[int(p.argmax())], float(p.max() / p.sum())

    cut = []
    whole = language.grams_in
    monkeypatch.setattr(language, "grams_in", lambda words, *more: cut.extend(words) or whole(words, *more))
    for _ in range(3):
        got = model.guesses(texts)
        assert [g for g, _ in got] == [plain(t)[0] for t in texts] and all(abs(p - plain(t)[1]) < 1e-9 for t, (_, p) in zip(texts, got))
    assert sorted(cut) == sorted({w for t in texts for w in language.words(t)})
    for words in (["a"], ["the", "été", "中文字", "x" * 70]):
        found, place, word = whole(words)
        assert Counter((found[g], w) for g, w in zip(place.tolist(), word.tolist())) == Counter((g, i) for i, w in enumerate(words) for g in language.grams_of(w))
