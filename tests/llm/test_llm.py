"""The training-data operators against brute force, on planted rows and on the small tables."""

import random
from array import array
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from siltstone.llm import chunked_bpe, exact_dedup, importance, license_scan, packing, quality_rules, shingle_dedup, simhash, suffix_dedup, token_files, tokens, toxicity  # noqa: E402
from siltstone.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards boil a very odd potion of herbs. "
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "Hello  world"), (5, "Hello world"), (6, "x" * 70_000), (7, PASSAGE + "tail one"), (8, "head two " + PASSAGE), (None, PASSAGE), (9, PASSAGE * 3),
    (9, PASSAGE * 3), (10, "Licensed under the Apache License,\nVersion 2.0.\nall rights reserved cc by cc-by"), (11, "naïve café ²³ ½ \x1f odd line 数字 ΣΑΣ <|endoftext|> <|startoftext|>"),
    (12, "###\n###\n### $$$"), (13, "\x00nul é́ ǅ"), (14, "a b c a b c a b c"), (15, " lead and   trail  \n\n x"), (16, "y" * 49), (17, "y" * 50), (18, "y" * 51),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", -1, "clash", 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, length int")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", [*sorted(QUERIES), "pipeline"])
def test_empty_tables(spark, tmp_path, small, name):
    import corpus_pipeline

    small.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert (QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, str(tmp_path)).collect() == []


def test_pipeline_on_odd_rows(spark, odd):
    """Every stage keeps the columns, takes all forms of rows, and leaves what it must."""
    import corpus_pipeline

    labels = spark.createDataFrame([(7, 1, 0), (9, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert texts_of(importance.resampled(odd, labels.limit(0))) and Counter(texts_of(importance.resampled(odd, labels.limit(0)))) == Counter(ODD)
    kept = importance.resampled(odd, labels, share=0.5)
    want = {(r["doc_id"], r["n_grams"]) for r in importance.importance_resample(odd, labels, share=0.5).filter("kept").collect()}
    assert {(i, len(importance.buckets_of(t))) for i, t in texts_of(kept)} == want
    docs = odd
    for stage in (corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        before = Counter(i for i, _ in texts_of(docs))
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "odd")
        assert docs.columns == odd.columns and Counter(i for i, _ in texts_of(docs)) <= before
    assert None in {i for i, _ in texts_of(docs)}
    pieces_fit(corpus_pipeline.packed(spark, docs, SF).collect())


def test_bit_filter_and_without(spark):
    from siltstone.llm import common

    hashes = spark.range(3000).select((common.F.col("id") * 7919 - 5_000_000).alias("h"))
    marked = common.BitFilter(hashes, "t").mark(spark.range(-6_000_000, 6_000_000, 997).toDF("h").unionByName(hashes), common.F.col("h"), "may")
    assert marked.join(hashes, "h").filter("NOT may").isEmpty() and marked.join(hashes, "h", "left_anti").filter("may").count() < 1500
    assert common.BitFilter(hashes.limit(0), "none").mark(hashes, common.F.col("h"), "may").filter("may").isEmpty()
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (None, "a", 2), (None, None, 3), (2, "", 4)], "doc_id int, text string, th int")
    gone = spark.createDataFrame([(1, "b"), (None, "")], "doc_id bigint, t string").select("doc_id", common.F.xxhash64("t").alias("th"))
    assert sorted(r["th"] for r in common.without(docs, gone, "t").collect()) == [0, 2, 4]


def test_workers_give_memory_back():
    """An operator that drops the worker's caches closes the encoders, too."""
    import gc
    import weakref

    from siltstone.llm import chunked_bpe, common

    path = tokens.file_of("byte_bpe_50k.json")
    enc, chunks = tokens.encoder(path), chunked_bpe.opened(path)[0]
    assert enc.encode("some words") and list(chunks.encode_all(["some words"]))
    held = weakref.ref(enc), weakref.ref(chunks)
    del enc, chunks
    common.drop_caches()
    gc.collect()
    assert not any(h() for h in held)
    assert tokens.encoder(path).encode("some words")


def test_packing_tables_need_no_python_worker(spark):
    from siltstone.llm import packing

    for rows in ([(1, 2, 3), (4, 5, 6)], []):
        table = packing._table(spark, rows, [("class", packing.pa.int32()), ("low", packing.pa.int64()), ("high", packing.pa.int64())])
        assert table.dtypes == [("class", "int"), ("low", "bigint"), ("high", "bigint")] and [tuple(r) for r in table.collect()] == rows
        assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert rows_of(got, *want.columns) == Counter(want.fetchall())


def test_filter_audit_sql(spark):
    """The SQL of op13 reads labels as well as documents."""
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL["op13_filter_audit"])
    assert rows_of(QUERIES["op13_filter_audit"](spark, SF), *want.columns) == Counter(want.fetchall())


def bare(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup(spark, odd):
    got = exact_dedup.exact_dedup(odd)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for i, t in ODD:
        g = groups[bare(t)]
        best = min(g)
        want[(i, best[3], len(g), sha256(bare(t).encode()).hexdigest())] += 1
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = rows_of(got.filter("kept"), "doc_id", "text_sha256")
    assert kept == Counter((min(g)[3], sha256(t.encode()).hexdigest()) for t, g in groups.items())  # one row of each text


def test_deduplicated_leaves_no_copy(spark, odd):
    rows = [(9, "a b"), (9, "a b"), (9, "ab"), (None, "c"), (None, "c"), (-(1 << 63), "d"), (5, "d"), (7, None), (8, ""), (6, " e"), (6, "e ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, digest int")
    for frame in (docs, odd):
        got = texts_of(exact_dedup.deduplicated(frame))
        assert sorted(bare(t) for _, t in got) == sorted({bare(t) for _, t in texts_of(frame)})
        assert exact_dedup.deduplicated(frame).columns == frame.columns
    assert {(i, t) for i, t in texts_of(exact_dedup.deduplicated(docs))} >= {(9, "a b"), (None, "c"), (-(1 << 63), "d"), (7, None)}


def test_digest_index_persists(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    path = f"file://{tmp_path}/index"
    say = lambda rows, index, batch: rows_of(exact_dedup.exact_dedup(make(rows), index, batch), "doc_id", "keep_id", "kept")
    one, two = [(1, "a b"), (2, "ab"), (3, "c")], [(7, "a  b"), (8, "d")]
    first = Counter([(1, 1, True), (2, 1, False), (3, 3, True)])
    assert say(one, exact_dedup.DigestIndex(spark, path, buckets=4), "one") == first
    index = exact_dedup.DigestIndex(spark, path)
    assert index.buckets == 4
    second = Counter([(7, 1, False), (8, 8, True)])
    assert say(two, index, "two") == second
    for _ in range(2):  # a batch that runs again, alone or after others, decides as before and adds nothing
        assert say(two, index, "two") == second and say(one, index, "one") == first
        assert index.read().count() == 3
    assert say(one, index, "three") == Counter([(1, 1, False), (2, 1, False), (3, 3, False)])
    small = index.compacted(f"file://{tmp_path}/compacted")
    assert small.read().count() == 3 and say([(9, "a b"), (10, "new")], small, "four") == Counter([(9, 1, False), (10, 10, True)])
    plan = index.missing(make([(1, "x")]).select(exact_dedup.digest_of(exact_dedup.F.col("text")).alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    index.close()


def test_license_scan(odd):
    got = {r["doc_id"]: r for r in license_scan.license_scan(odd).collect() if r["doc_id"]}
    assert (got[10]["n_base"], got[10]["first_word"], got[10]["last_word"]) == (3, 8, 13)
    assert got[10]["base_labels"] == "cc-by,reserved" and got[1]["labels"] == "" and got[1]["first_word"] is None
    assert got[4]["n_words"] == 2 and license_scan.license_scan(odd).count() == len(ODD)


def test_license_blocks_by_brute_force(spark, small):
    got = license_scan.license_scan(small).collect()
    text = dict(texts_of(small))
    for r in got:
        want = set()
        for k, line in enumerate(text[r["doc_id"]].split("\n")):
            b = set(license_scan.words_of(line))
            for label, t in license_scan.TEMPLATES.items():
                t = set(license_scan.words_of(t))
                if len(t & b) >= 0.8 * len(t) - 1e-9:
                    want.add((k, label))
        assert {(m["block"], m["label"]) for m in r["blocks"] or []} == want


def test_quality_rules(spark, odd, small):
    for docs in (odd, small):
        got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.ledger(docs).collect()}
        for i, t in texts_of(docs):
            import re

            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            c = Counter(zip(w, w[1:], w[2:]))
            inside = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
            seen, dup = set(), 0
            for line in t.split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", line):
                    dup += line in seen
                    seen.add(line)
            assert (i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(inside)) in got
    def cased(t):
        return sum(c.isupper() for c in t), sum(c.isupper() or c.islower() for c in t)

    loud = spark.createDataFrame([(1, "ALLES WIRD GUT ß " * 20), (2, "alles klein " * 20), (3, "ÀÉÎ ΣΑΣ ǅ ﬁ 数字 " * 12), (4, None)], "doc_id bigint, text string")
    for docs in (loud, odd, small):
        text = dict(texts_of(docs))
        for r in quality_rules.apply_policy(quality_rules.ledger(docs)).collect():
            t = text[r["doc_id"]] or ""
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            assert (r["n_upper"], r["n_cased"], r["n_lines"]) == (*cased(t), len(lines))
            fails = [
                r["n_words"] < 50, 100 * r["n_repeat_words"] > 50 * r["n_words"], 10 * r["n_symbols"] > 2 * r["n_words"], len(lines) >= 4 and 2 * r["n_dup_lines"] > len(lines),
                r["word_chars"] > 25 * r["n_words"], r["word_chars"] < 2 * r["n_words"], r["n_cased"] >= 100 and 10 * r["n_upper"] > 6 * r["n_cased"],
            ]
            assert r["fail_bits"] == sum(1 << k for k, f in enumerate(fails) if f) and r["kept"] == (not any(fails))
    assert [r["fail_bits"] >> 6 & 1 for r in quality_rules.ledger(loud).orderBy("doc_id").collect()] == [1, 0, 0, 0]
    ledger = quality_rules.ledger(small)
    bits = [r["fail_bits"] for r in ledger.collect()]
    mask = quality_rules.mask_of("v2")
    for r in quality_rules.ablations(ledger).collect():
        bit = 1 << list(quality_rules.RULES).index(r["rule"])
        assert r["n_failed"] == sum(bool(b & bit) for b in bits) and r["n_kept_without"] == sum((b & mask & ~bit) == 0 for b in bits)


def test_toxicity_recall(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.theta) > 0).all()
    truth = labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth")
    got = toxicity.score(docs, model).join(truth, "doc_id").select("toxic", "truth").collect()
    caught = [r["toxic"] for r in got if r["truth"]]
    clean = [r["toxic"] for r in got if not r["truth"]]
    assert np.mean(caught) > 0.88 and np.mean(clean) < 0.02  # about 6 % of the labels are noise


def test_toxicity_against_brute_force(spark, odd):
    rng = np.random.default_rng(2)
    words = [f"w{k}x" for k in range(30)]
    docs = [sorted(set(rng.choice(words, 12).tolist() + (["vile", "vilest"] if k % 3 == 0 else []))) for k in range(120)]
    toxic = np.array([k % 3 == 0 for k in range(120)], dtype=int)
    model = toxicity.fit_ordinal(docs, toxic)
    rows, names = toxicity.indexed(docs)
    ratios = toxicity.contrast(rows, len(names), toxic, 3)
    grades = toxicity.grade_labels(rows, ratios, toxic)
    assert (grades > 0).tolist() == toxic.astype(bool).tolist() and grades.max() <= 3
    vocab = sorted(model.weights)
    held = np.array([[any(f == v for w in d for f in toxicity.word_features(w)) for v in vocab] for d in docs], dtype=float)

    def loss(w, theta):
        out = 0.0
        for x, g in zip(held @ w, grades):
            upto = [0.0, *(1 / (1 + np.exp(-(t - x))) for t in theta), 1.0]
            out -= np.log(max(upto[g + 1] - upto[g], 1e-12))
        return out / len(docs) + 0.5 * 1e-4 * float(w @ w)

    w, theta = np.array([model.weights[v] for v in vocab]), model.theta
    best = loss(w, theta)
    for _ in range(60):  # no step near by is better by more than the fit's tolerance
        assert loss(w + rng.normal(0, 0.05, len(w)), np.sort(theta + rng.normal(0, 0.05, len(theta)))) > best - 2e-3
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id bigint, text string")
    for r in toxicity.score(frame, model).collect():
        z = float(held[r["doc_id"]] @ w)
        upto = np.array([0.0, *(1 / (1 + np.exp(-(t - z))) for t in theta), 1.0])
        p = np.diff(upto)
        assert abs(r["expected_severity"] - p @ np.arange(4)) < 1e-9 and r["grade"] == p.argmax() and abs(r["p_toxic"] - (1 - p[0])) < 1e-9
    got = toxicity.score(odd, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD) and len({r["p_toxic"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    repeated = frame.select((toxicity.F.col("doc_id") % 10).alias("doc_id"), "text")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(10)] + [(0, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    sample, y = toxicity.labelled_sample(repeated, labels, "toxic", 100)
    assert len(sample) == 10 and sum(y) == 6  # one row for each id, its greatest label


def test_importance_against_brute_force(spark, odd):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choices(["good", "fine", "Text", "!!", "12", "bad", "junk"], k=rng.randint(0, 60)))) for k in range(80)] + list(ODD)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    raw, aim = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, t in rows:
        c = np.bincount(importance.buckets_of(t), minlength=importance.BUCKETS)
        raw += c
        if i is not None and i < 60 and i % 4 == 0:
            aim += c
    ratio = np.log((aim + 1) / (aim.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    got = importance.importance_resample(docs, labels, share=0.4).collect()
    want = Counter((i, len(importance.buckets_of(t)), round(float(ratio[importance.buckets_of(t)].sum()), 9)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_grams"], round(r["log_weight"], 9)) for r in got) == want
    noise = {r[0]: r[1] for r in docs.select("doc_id", importance.gumbel(importance.F.coalesce("doc_id", importance.F.lit(-1)), 7)).collect()}
    assert all(abs(r["score"] - r["log_weight"] - noise[r["doc_id"]]) < 1e-9 for r in got)
    assert 0.2 < np.mean([v for v in noise.values()]) < 1.0  # the mean of standard Gumbel noise is 0.577
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0, r["n_grams"]))
    k = int(np.ceil(0.4 * len(rows)))
    assert Counter((r["doc_id"], r["n_grams"]) for r in got if r["kept"]) == Counter((r["doc_id"], r["n_grams"]) for r in order[:k])


def test_importance(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = importance.importance_resample(docs, labels.filter("doc_id % 2 = 0"))
    rows = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"]]) > 0.97
    assert np.mean([r["kept"] for r in rows if not r["quality"]]) < 0.25
    table = got.select("score", "kept").collect()
    assert min(r["score"] for r in table if r["kept"]) >= max(r["score"] for r in table if not r["kept"])


def pieces_fit(rows):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQUENCE
    return by_doc, by_seq


def test_packing(spark, small):
    rows = packing.pack(small, keep_ids=True).collect()
    by_doc, by_seq = pieces_fit(rows)
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts_of(small):
        ids = array("I", [*tk.encode(t, add_special_tokens=False).ids, 1]).tobytes()
        got = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in got) == ids and all(crc32(r["ids"]) == r["ids_crc32"] for r in got)
    total = sum(r["length"] for r in rows)
    assert total / (len(by_seq) * packing.SEQUENCE) > 0.95


def test_packing_patterns():
    rng = np.random.default_rng(0)
    sizes = packing.class_sizes()
    for demand in (rng.integers(0, 400, len(sizes)), np.eye(1, len(sizes), 0, dtype=int)[0] * 5000, rng.integers(0, 2, len(sizes))):
        patterns, uses = packing.solve_patterns(sizes, demand, packing.SEQUENCE)
        assert (sum((p * n for p, n in zip(patterns, uses)), np.zeros(len(sizes), int)) == demand).all()
        assert all(p @ sizes <= packing.SEQUENCE for p in patterns)
        assert uses.sum() <= 1.04 * -(-int(demand @ sizes) // packing.SEQUENCE) + 2


def test_packing_odd(odd):
    rows = packing.pack(odd).collect()
    pieces_fit(rows)
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(i for i, _ in ODD)


def test_token_files(spark, odd, small):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (odd, small):
        rows = sorted(token_files.token_files(docs).collect(), key=lambda r: r["start"])
        want = defaultdict(list)
        for i, t in texts_of(docs):
            want[i].append(crc32(array("I", [*tk.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()))
        got, at = defaultdict(list), 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
            got[r["doc_id"]].append(r["ids_crc32"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert ids == sorted(ids)


def brute_suffix(rows):
    span, out = suffix_dedup.SPAN, []
    docs = [(suffix_dedup.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in docs:
        for k in range(len(b) - span + 1):
            s = b[k : k + span]
            least[s] = min(i, least.get(s, i))
    for (i, b), (own, _) in zip(docs, rows):
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if least[b[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((own, len(b), sum(gone), spans, sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup(spark, odd, small):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for docs in (odd, small):
        assert rows_of(suffix_dedup.suffix_dedup(docs), *cols) == brute_suffix(texts_of(docs))


def test_suffix_dedup_hard(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abé "), 7)) for _ in range(30)]
    rows = []
    for i in range(120):
        parts = [str(w) for w in rng.choice(words, int(rng.integers(0, 40)))]
        rows.append((int(i), "".join(parts) + "z" * int(rng.integers(0, 120))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for group in (4 << 20, 300):  # parts of long documents and many buckets
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        monkeypatch.setattr(suffix_dedup, "PART", group // 2)
        got = rows_of(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute_suffix(rows)


def test_suffix_dedup_with_one_string_in_every_document(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcd", k=rng.randint(0, 60))) + "=the same 16 b..=" * (1 + i % 3) + "".join(rng.choices("abcd", k=rng.randint(0, 60)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    monkeypatch.setattr(suffix_dedup, "GROUP", 300)
    monkeypatch.setattr(suffix_dedup, "PART", 150)
    for most in (1 << 17, 8):  # ranges alone, and ranges cut by a hash
        monkeypatch.setattr(suffix_dedup, "MOST_SPLITTERS", most)
        got = rows_of(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute_suffix(rows)


def test_local_tree_loses_no_pair(monkeypatch):
    rng = np.random.default_rng(8)
    points = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([points, points ^ np.uint64(5), points[:100] ^ np.uint64(1 << 40)]))
    monkeypatch.setattr(simhash, "BRUTE", 50)
    mine = np.flatnonzero(rng.random(len(points)) < 0.6)
    got = {(int(i), int(j)) for i, near in simhash.near_pairs(points, mine, np.arange(len(points))) for j in near}
    close = np.bitwise_count(points[mine][:, None] ^ points[None, :]) <= 3
    assert got == {(int(mine[i]), int(j)) for i, j in zip(*np.nonzero(close))}


def brute_simhash(rows):
    prints = []
    for i, t in rows:
        w = [x for x in (t or "").encode().lower().replace(b"\x0b", b" ").split()]
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    todo, comp = set(range(len(rows))), [0] * len(rows)
    while todo:
        reach, front = set(), {next(iter(todo))}
        while front:
            reach |= front
            front = {j for j in todo - reach for k in front if (prints[j] ^ prints[k]).bit_count() <= 3}
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        for j in reach:
            comp[j] = min(ids, default=None)
        todo -= reach
    return Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comp))


def test_simhash(spark, odd, small):
    for docs in (odd, small):
        assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == brute_simhash(texts_of(docs))


def test_simhash_tree_loses_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:
        x = int(b)
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64))
            fps.append(x)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    monkeypatch.setattr(simhash, "SHARD_BASE", 3)
    monkeypatch.setattr(simhash, "BLOCK", 25)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.star_edges(frame)).collect()}
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.where(close, label[None, :], len(fps)).min(1)
        if (new == label).all():
            break
        label = new
    groups, got = defaultdict(set), defaultdict(set)
    for x, l in zip(fps.view(np.int64).tolist(), label.tolist()):
        groups[l].add(x)
        got[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_chunked_bpe(spark, odd, small):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, small):
        want = Counter()
        for i, t in texts_of(docs):
            ids = tk.encode(t or "", add_special_tokens=False).ids
            back = tk.decode(ids, skip_special_tokens=False)
            want[(i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest())] += 1
        assert rows_of(chunked_bpe.encode_decode(docs, digests=True), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_chunks_are_shared_and_joined(spark):
    enc, _ = chunked_bpe.opened(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    for alphabet in (
        ["the", " and", "  ", "\n", "'s", "ing", "42", "##", " é", "x", ". ", "_", "-_", "''", "'", "\x00", "\t"],
        ["数字", "は", "。", " α", "βγ", "שלום ", "हिन्दी", "😀", "👩\u200d💻", "e\u0301", "²", "½", "'s", "1", " ", "\u3000", "\u2028", "، ", "_'", "ǅ", "\x1f"],
    ):
        for _ in range(200):
            text = "".join(rng.choice(alphabet, int(rng.integers(1, 1500))))
            assert enc.encode(text) == enc.base.whole(text)
    for shared in (" ".join(f"word{i % 97}x{i}" for i in range(3000)), "".join(f"数{i}は文字、" for i in range(2000))):
        before = enc.hits
        enc.encode("one start " + shared), enc.encode("another way to begin it " + shared)
        assert enc.hits - before > 20


def test_long_texts_without_white_space_take_time_in_proportion():
    import time

    enc, dec = chunked_bpe.opened(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "数字文本漢語", "ab+/"):
        text = "".join(rng.choices(letters, k=400_000))
        began = time.time()
        want = enc.base.whole(text)
        library, began = time.time() - began, time.time()
        got = enc.encode(text)
        assert got == want and time.time() - began < 4 * library + 2
        assert dec.decode(array("I", got)) == text


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    by_doc, _ = pieces_fit(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert set(by_doc) == {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_grouped_encoding_equals_the_library(name):
    e = tokens.Encoder(tokens.file_of(name))
    rng = random.Random(5)
    parts = ["'", "'s", "don't", " ", "  ", "\n", "\t\n ", "\x1c", "\u00a0", "a", "Word", " word", "_", "__", "12", "!", "?!'", "</w>", "<|endoftext|>", "\u0301", "\u00e9", "\u4e2d\u6587", "\u0130", "\u0149", "\u0120", "\U0001f600"]
    texts = [None, "", *parts, *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000)), " ".join(f"w{i}x" for i in range(30_000))]
    want = [e.whole(t or "") for t in texts]
    assert list(e.encode_all(texts)) == want
    assert list(e.encode_all(texts)) == want  # from memory
    assert list(e.encode_all([])) == []


def brute_similar(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {b""})
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, least.get(top(i))) for i, (d, _) in enumerate(rows))


def test_pipeline_near_duplicates_by_brute_force(spark, odd, small):
    import corpus_pipeline

    rng = random.Random(7)
    rows = []
    for k in range(30):  # chains of edited copies, so that groups reach past one similarity to their first member
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 200))]
        for _ in range(8):
            rows.append((1000 + len(rows), " ".join(words)))
            words[rng.randrange(len(words))] = f"n{len(rows)}"
    edited = spark.createDataFrame(rows, "doc_id bigint, text string")
    for docs in (odd, small, edited):
        want = brute_similar(texts_of(docs))
        assert rows_of(shingle_dedup.near_duplicates(docs), "doc_id", "component_id") == want
        stay = Counter({(d,): n for (d, c), n in want.items() if d is None or d == c})
        assert rows_of(corpus_pipeline.near_duplicates(spark, docs, SF), "doc_id") == stay


def test_shingle_hashes(monkeypatch):
    rng = random.Random(6)
    texts = ["", "  ", "one", "a b c d", "a b c d e", " A  b\tC d\n\ne f ", "é É ß"] + [" ".join(rng.choices("abcdef", k=rng.randint(1, 300))) for _ in range(50)]
    plain = [shingle_dedup.shingle_hashes(t) for t in texts]
    seen: dict = {}
    for t, h in zip(texts, plain):
        w = t.encode().lower().split()
        parts = [b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(h) == len(parts)
        for x, y in zip(h.tolist(), parts):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    monkeypatch.setattr(shingle_dedup, "PART", 7)  # long texts in parts
    assert all((shingle_dedup.shingle_hashes(t) == h).all() for t, h in zip(texts, plain))


def test_sketches_never_rule_out_a_pair():
    rng = np.random.default_rng(12)
    sets = []
    for size in (1, 3, 200, 255, 256, 257, 300, 2000, 2100, 9000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.append(base[: int(size * 0.95) + 1], rng.integers(0, 1 << 63, size // 20, dtype=np.uint64))), np.unique(base[: int(size * 0.8) + 1])]
    sketch, n = shingle_dedup.Sketches([shingle_dedup.sketch_of(s) for s in sets]), np.array([len(s) for s in sets])
    every = np.arange(len(sets))
    for i, s in enumerate(sets):
        open_, like = shingle_dedup._alike(sketch, n, i, every, 0.8)
        both = np.array([len(np.intersect1d(s, v)) for v in sets])
        alike = both >= 0.8 * (n[i] + n - both) - 1e-9
        assert (open_ | ~alike).all() and (open_ | ~like).all() and open_.sum() <= alike.sum() + 2


def test_near_duplicates_in_large_lists(spark, monkeypatch):
    """One passage in many texts, a large group of near copies, and lists cut into many blocks."""
    rng = random.Random(13)
    base, rows = [f"w{rng.randint(0, 300)}" for _ in range(90)], []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(120, 200):
        rows.append((k, " ".join([*base[:40], *(f"x{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 14)))])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_similar(rows)
    for block in (16_384, 7):
        monkeypatch.setattr(shingle_dedup, "BLOCK", block)
        assert rows_of(shingle_dedup.near_duplicates(docs), "doc_id", "component_id") == want


def test_license_notices_wrapped_over_lines(spark):
    rng = random.Random(11)
    wrapped = {}
    for k, (label, t) in enumerate(license_scan.TEMPLATES.items()):
        w = t.split()
        cut = len(w) // 2
        wrapped[k] = (label, 1, "intro line\n" + " ".join(w[:cut]) + "\n" + " ".join(w[cut:]) + "\nnext line")
        thirds = [w[: len(w) // 3], w[len(w) // 3 : 2 * len(w) // 3], w[2 * len(w) // 3 :]]
        wrapped[100 + k] = (label, 0, "\n".join(" * " + " ".join(x) for x in thirds))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in wrapped.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    for i, (label, line, _) in wrapped.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
        assert (line, label, 1.0) in {(m["block"], m["label"], m["containment"]) for m in got[i]["blocks"]}

    vocab = sorted({w for t in license_scan.TEMPLATES.values() for w in license_scan.words_of(t)})
    rows = []
    for i in range(150):  # pieces of templates with words left out, broken anywhere
        words = []
        for t in rng.choices(list(license_scan.TEMPLATES.values()), k=3):
            words += [w for w in license_scan.words_of(t) if rng.random() > 0.1] + rng.choices([*vocab, "x", "y", "z"], k=rng.randint(0, 4))
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)))
    got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        every, want = license_scan.words_of(text), {}
        for label, t in license_scan.TEMPLATES.items():
            t, width = set(license_scan.words_of(t)), len(license_scan.words_of(t))
            parts = [license_scan.words_of(x) for x in text.split("\n")] + [every[k : k + width] for k in range(len(every))]
            best = max(len(t & set(x)) for x in parts)
            if best >= 0.8 * len(t) - 1e-9:
                want[label] = best / len(t)
        best = defaultdict(float)
        for m in got[i]["blocks"] or []:
            best[m["label"]] = max(best[m["label"]], m["containment"])
        assert best == want


def test_quality_ledger_is_found_again(spark, small, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    made = {tuple(r) for r in quality_rules.ledger(small, path=path).collect()}
    again = quality_rules.open_ledger(spark, path)
    assert {tuple(r) for r in again.collect()} == made and quality_rules.rules_of(again) == quality_rules.RULES
    with pytest.raises(Exception, match="(?i)exists"):
        quality_rules.ledger(small, path=path)
    monkeypatch.setitem(quality_rules.RULES, "long_lines", "n_words > 40 * n_lines")
    monkeypatch.setitem(quality_rules.POLICIES, "v3", ("too_few_words", "long_lines"))
    assert quality_rules.apply_policy(again, "v2").filter("kept").count() == sum(r[-1] == 0 for r in made)
    with pytest.raises(ValueError, match="long_lines"):
        quality_rules.apply_policy(again, "v3")
    monkeypatch.setitem(quality_rules.RULES, "symbols", "n_symbols > n_words")
    with pytest.raises(ValueError, match="symbols"):
        quality_rules.ablations(again, "v2")


def test_base_failed(spark, small):
    want = {r["doc_id"]: r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"] for r in quality_rules.ledger(small).collect()}
    rows = quality_rules.apply_policy(quality_rules.ledger(small))
    base = rows["fail_bits"].bitwiseAND(quality_rules.mask_of("v1")) != 0
    assert {r["doc_id"]: r["b"] for r in rows.select("doc_id", base.alias("b")).collect()} == want and True in want.values() and False in want.values()


def test_quality_ledger_reads_the_texts_once(spark, small, tmp_path):
    small.write.parquet(f"{tmp_path}/documents.parquet")
    rows = quality_rules.ledger(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    (tmp_path / "documents.parquet").rename(tmp_path / "gone")
    assert quality_rules.apply_policy(rows, "v1").count() == small.count()
    assert quality_rules.ablations(rows, "v2").count() == len(quality_rules.RULES)
