"""Personal data, spelling variants and the filter audit against brute force, on planted rows and on the small tables."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import duckdb
import numpy as np
import pytest

from siltstone.llm import filter_audit, shingle_dedup, simhash, spelling_variants, weak_pii
from siltstone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SMALL = f"{SF}/documents.parquet"


def frame(spark, texts):
    rows = [(i, t, None if i == 3 else "en", "s", -1, "clash", 7, 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, bits int, n int")


# Personal data.

CARD = "4539148803436467"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRICKY = [
    "a@b@c.d a@b.c@d.e x@y.z.w- @a.b a..b@c.d.. é@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.3 1.2.3 9.9.9.9é", f"{CARD} 4539 1488-0343 6467 4539  1488 {CARD}1 0000000000000000 1-2-3",
    "+1 (555) 123-4567 +1 +12 34 +1234567 +123456789012345678 ++44 20 7946 0958- +1..2", "", None, "mail: a.b+c%d@ex-ample.co.uk, ip 10.0.0.1; 😀 é@ü x@y.z 😀 +49 30 123456",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_of_tricky_and_random_texts():
    rng = np.random.default_rng(5)
    texts = [*TRICKY, *("".join(rng.choice(list("a@.-1 2+()é_9"), 80)) for _ in range(3000)), *("".join(rng.choice(list("0123456789 -."), 60)) for _ in range(1000))]
    for t in texts:
        assert [f"{weak_pii.KINDS[k]}:{s}:{e}" for k, s, e in weak_pii.base_spans(t or "")] == brute_base(t), t


def test_personal_data_rows(spark):
    rows = QUERIES["op11_weak_pii"](spark, SF).collect()
    texts = dict(spark.read.parquet(SMALL).select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        got = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(got) and len(got) == len(want) + r["n_added"]
        assert got == sorted(got, key=lambda x: (list(BASE).index(x.split(":")[0]), int(x.split(":")[1])))


FURTHER = [
    "call me on (555) 123-4567 tonight", "tel 030-123-4567 or so", "phone: 0044 20 7946 0958", "write to jane.doe [at] mail [dot] org please", "contact bob at example dot com", "host 10[.]0[.]0[.]1 is down",
    "server 2001:db8::8a2e:370:7334 answers", "amex card 3782-822463-10005 expires", f"visa 4539.1488.0343.6467 ok",
]
CLEAN = ["on 2024-01-15 at 12:30:45 we met", "version 10.2.33 of 1234567 lines", "sha 9f86d081884c7d659a2feaa0c55ad015", "pages 1200-1300, 15/03/2021", "order 5731080387325257 was sent", "look at this. Then dot it", "std::vector<int> a::b", "1 2 3 4 5 6 7 8 9", "token = \"e03422dad6b454724135a384f69b\""]


def test_spans_beyond_the_base_and_clean_texts(spark):
    base = [(i, f"note {i}: reach us at user{i}@mail{i}.example.com or +1 (555) 555-{1000 + i} from 10.1.2.{i % 256}, card 4539 1488 0343 6467 x") for i in range(200)]
    found = weak_pii.personal_data(frame(spark, [*base, *((1000 + i, t) for i, t in enumerate(FURTHER)), *((2000 + i, t) for i, t in enumerate(CLEAN * 3)), *((3000 + i, t) for i, t in enumerate(TRICKY)), (4000, None), (None, "x@y.zz"), (None, "x@y.zz")]))
    got = defaultdict(list)
    for r in found.collect():
        got[r["doc_id"]].append(r["spans"])
    assert [len(got[1000 + i][0]) for i in range(len(FURTHER))] == [1] * len(FURTHER)
    assert [(i, got[2000 + i]) for i in range(3 * len(CLEAN)) if got[2000 + i][0]] == []
    assert got[4000] == [[]] and [len(s) for s in got[None]] == [1, 1]
    for i, t in enumerate(TRICKY):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[3000 + i][0] if s["base"]] == brute_base(t)


def test_reliability_finds_a_bad_labeler_and_redaction_hides(spark):
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    good = lambda share: np.where(rng.random(4000) < share, np.where(truth, 1, 2), np.where(truth, 2, 1))
    votes = np.stack([good(0.95), good(0.9), good(0.85), good(0.5), good(0.9), np.zeros(4000, int)], 1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = weak_pii.reliability(patterns, n.astype(float))
    right = model.table[1, :, 1] / (model.table[1, :, 1] + model.table[1, :, 2])
    assert abs(model.prior - truth.mean()) < 0.03 and right[0] > 0.9 and right[3] < 0.6
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97
    docs = frame(spark, [(1, "ask a.b@c.de or +1 555 123 4567 😀"), (2, None), (4, "nothing")])
    hidden = weak_pii.redacted(docs, weak_pii.train(weak_pii.scanned(docs)))
    assert hidden.columns == docs.columns and {r["doc_id"]: r["text"] for r in hidden.collect()} == {1: "ask <email> or <phone> 😀", 2: None, 4: "nothing"}


@pytest.mark.parametrize("text", ["x" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 200_000, "a@" * 100_000, "+1 " * 100_000, " at a dot" * 30_000, "::" * 150_000, "(1" * 100_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    weak_pii.spans_of(text)
    assert time.process_time() - began < 5


# Spelling variants.


def brute_variants(rows):
    low = str.maketrans(spelling_variants.UPPER, spelling_variants.LOWER)
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    letters = spelling_variants.LOWER + "".join(map(chr, range(0xC0, 0x100)))
    out = {}
    for w in n:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters}
        near = {x for x in near if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = (n[w], len(near), form, n.get(form))

    def root(w):
        while out[w][2]:
            w = out[w][2]
        return w

    return {(w, *v, root(w)) for w, v in out.items()}


def variants(rows):
    return [(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows.collect()]


PLANTED = {"receive": 700, "recieve": 3, "receiv": 30, "receives": 140, "receivees": 28, "receiveesx": 5, "aaaaaaa": 60, "aaaaaa": 12, "aaaaaaaa": 300, "naïveté": 50, "naïvetè": 10, "naiveté": 9, "ÀÉÎõü÷×": 5, "ÀÉÎõü÷ÿ": 25, "bounded": 25, "boundee": 25, "bounde": 5, "short": 99}


def planted(spark):
    text = "|".join(w for w, n in PLANTED.items() for _ in range(n))
    return frame(spark, [(1, text.upper().replace("Ï", "ï") + "x" * 50_000), (2, text), (3, None), (4, ""), (None, "receive receiver receiver"), (None, "receiver receiver receiver"), (None, "receiver receiver receiver"), (5, "boundary " * 7)])


@pytest.mark.parametrize("mask", [-1, 0xFF, 0])
def test_spelling_variants_of_planted_words(spark, mask):
    docs = planted(spark)
    got = variants(spelling_variants.spelling_variants(docs, mask))
    assert len(got) == len(set(got)) and set(got) == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {w: root for w, *_, root in got}["receiveesx"] == "receive"


def test_spelling_variants_of_the_table(spark):
    docs = spark.read.parquet(SMALL)
    got = variants(QUERIES["op12_spelling_variants"](spark, SF))
    assert set(got) == brute_variants([(r["doc_id"], r["text"]) for r in docs.collect()]) and len(got) == len(set(got))


def test_a_run_of_keys_may_be_cut_by_batches(spark):
    docs = planted(spark)
    want = set(variants(spelling_variants.spelling_variants(docs)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert set(variants(spelling_variants.spelling_variants(docs))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Filter audit.


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    by_part = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        fails = {k for k, f in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t])) if f}
        by_part[lang or ""].append((i, fails))
    out, shapley = {}, Counter()
    for part, docs in by_part.items():
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [i for i, fails in left if f in fails]
                failing = [fails for _, fails in docs if f in fails]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(x == {f} for x in failing), sum(i in good for i in gone), sum(i in toxic for i in gone)]
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(rows):
    return [(r["part"], r["filter_order"], r["step"], *(r[c] for c in filter_audit.COUNTS), r["shapley"]) for r in rows.collect()]


def test_filter_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150))
    texts = [(1, None), (2, ""), (3, long), (4, long), (5, long), (None, long), (None, long), (5, long), (6, "AB " * 120), (7, long.upper()), (8, long + " #"), (9, "#"), (10, "a\x1fb \x0b\x0c\r\n c"), (11, long + "É" * 40), (12, "x " * 70_000)]
    docs = frame(spark, texts).withColumn("lang", pytest.importorskip("pyspark.sql.functions").expr("CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN '' WHEN doc_id = 8 THEN 'de' ELSE lang END"))
    labels = [(3, 1, 0), (4, 0, 1), (4, 1, 0), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    got = audited(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))
    assert len(got) == len(set(got)) and set(got) == brute_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], labels)


def test_filter_audit_of_the_table(spark):
    got = audited(QUERIES["op13_filter_audit"](spark, SF))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert set(got) == set(con.sql(ORACLE_SQL["op13_filter_audit"]).fetchall()) == brute_audit(con.sql("SELECT doc_id, text, lang FROM documents").fetchall(), con.sql("SELECT doc_id, quality, toxic FROM labels").fetchall())


# Near-duplicates at scale: many dense shards, lists of mutually different sets.


def test_hundreds_of_dense_shards(spark, monkeypatch):
    """As many shards as tens of millions of fingerprints make, all dense."""
    rng = np.random.default_rng(17)
    base = rng.integers(0, 1 << 63, 250, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)) for _ in range(3))]))
    monkeypatch.setattr(simhash, "SHARD_BASE", len(fps) / 500**2)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    edges = simhash.star_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint"))
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    label = np.arange(len(fps))
    close = [np.flatnonzero(np.bitwise_count(fps ^ x) <= 3) for x in fps]
    while True:
        new = np.array([label[c].min() for c in close])
        if (new == label).all():
            break
        label = new
    got, want = defaultdict(set), defaultdict(set)
    for x, group in zip(fps.view(np.int64).tolist(), label.tolist()):
        got[roots.get(x, x)].add(x)
        want[group].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(fps)


def test_a_pair_is_compared_in_one_cell_of_one_list():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(30)]
    for i in range(0, 30, 3):
        sets[i + 1] = np.unique(np.append(sets[i][1:], np.uint64(i)))
    key, n, root = np.arange(30), np.array([len(s) for s in sets]), np.arange(30) // 2
    sketch = shingle_dedup.Sketches([shingle_dedup.sketch_of(s) for s in sets])
    pairs = lambda similarity, side, whole, smaller: [(max(a, b), min(a, b)) for x, y in shingle_dedup.across(key, n, sketch, root, similarity, side, whole, smaller) for a, b in zip(x.tolist(), y.tolist())]
    none = [[]] * 30
    inside = pairs(0.0, np.zeros(30), True, none)
    assert len(inside) == len(set(inside)) == sum(root[i] != root[j] for i in range(30) for j in range(i))
    side = np.arange(30) % 2
    between = pairs(0.0, side, False, none)
    assert len(between) == len(set(between)) and all(side[a] != side[b] and root[a] != root[b] for a, b in between) and len(between) == sum(side[i] != side[j] and root[i] != root[j] for i in range(30) for j in range(i))
    held = [[7] if i < 10 else [9, 7] if i < 12 else [5] for i in range(30)]
    assert set(inside) - set(pairs(0.0, np.zeros(30), True, held)) == {(a, b) for a, b in inside if set(held[a]) & set(held[b])}
    alike = {(i + 1, i) for i in range(0, 30, 3) if root[i] != root[i + 1]}
    assert alike <= set(pairs(0.8, np.zeros(30), True, none)) and alike


def test_ids_in_decimal_come_from_a_table():
    from array import array

    from siltstone.llm import chunked_bpe
    from siltstone.llm.tokens import file_of

    dec = chunked_bpe.opened(file_of("byte_bpe_50k.json"))[1]
    for ids in ([], [0], [1, 22, 333, 0, len(dec.table) - 1]):
        assert dec.decimal(array("I", ids)) == ",".join(map(str, ids)).encode()
