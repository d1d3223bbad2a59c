"""Personal data by weak supervision.

Strict patterns give the base spans; looser grammars give candidates that may be personal data as well: numbers in national
forms, cards in other groupings, obfuscated addresses, IPv6. Labelers (patterns, arithmetic, gazetteers, context, borders,
shape) vote yes, no or nothing on every candidate and base span of all documents. Expectation-maximisation estimates from
the counts of vote patterns how reliable each labeler is (Dawid and Skene's model), its posteriors are the soft labels of a
logistic span classifier, and the classifier decides which candidates join the base spans.

One scan of the texts writes spans with votes and features as small integers; all that follows works on their counts.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import each_row, staged

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ABSTAIN, YES, NO = 0, 1, 2
LABELERS = ("pattern", "arithmetic", "gazetteer", "context", "border", "shape")
#: Bits of a span that the classifier sees; the first is its intercept.
FEATURES = ("any", "strict", "arithmetic", "gazetteer", "context", "other_context", "joined", "shape", "separated", "prefixed", "brackets", "long", "quoted")
SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,features:int>>"
FOUND = f"doc_id bigint, spans {SPAN}"

# Base patterns. Possessive quantifiers and the border before a digit leave the matches as they are and the time linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beyond them.
AT = re.compile(r"\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20@\x20", re.IGNORECASE)
SPOKEN_AT = re.compile(r"\x20at\x20", re.IGNORECASE)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++", re.IGNORECASE)
SPOKEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++", re.IGNORECASE)
V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[({](?:\.|dot)[\])}][0-9]{1,3}){3}(?![0-9])")
LOOSE_NUMBER = re.compile(r"(?:\+|\()?[0-9](?:[\x20().\-/]{0,3}[0-9])++")

# Gazetteers and context.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co me tv us uk ie de at ch fr be nl lu es pt it eu pl cz sk hu ro se no dk fi is ru ua tr gr il in cn jp kr tw hk sg au nz za br ar mx cl ca".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|62|35|30[0-5]|3[689]")
CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689]\d|3[578]\d|42\d|5[09]\d|6[7-9]\d|8[05789]\d|9[679]\d")
SPEAKS_FOR = (
    frozenset("mail email e-mail mailto contact write reach courriel correo kontakt schreiben".split()),
    frozenset("ip ipv4 ipv6 host server ping gateway dns subnet router adresse".split()),
    frozenset("card cards visa mastercard amex credit debit payment carte karte kreditkarte tarjeta".split()),
    frozenset("phone tel telephone call mobile cell fax dial whatsapp sms hotline telefon téléphone teléfono handy anrufen llamar appelez".split()),
)
SPEAKS_AGAINST = frozenset("version release isbn issn doi order invoice token hash key commit serial build page pages chapter year price total sum usd eur sku lot ref".split())
V6_BLOCKS = tuple(map(ipaddress.ip_network, ("2000::/3", "fc00::/7", "fe80::/10")))  #: assigned to hosts
BEFORE = re.compile(r"[^\W\d_](?:[\w-]*[^\W\d_])?")
CONTEXT_CHARS = 40
SEPARATORS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping within a kind, failing matches dropped."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((EMAIL, start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
            out.append((IP, m.start(), m.end()))
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in DIALLED.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((PHONE, m.start(), m.end()))
    return out


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser grammars that touch no base span and not one another."""
    found = []
    for mark, domain in ((AT, LOOSE_DOMAIN), (SPOKEN_AT, SPOKEN_DOMAIN)):
        for m in mark.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            right = domain.match(text, m.end()) if start < m.start() else None
            if right:
                found.append((EMAIL, start, right.end()))
    found += [(IP, m.start(), m.end()) for m in V6.finditer(text)] if "::" in text or text.count(":") > 2 else []
    found += [(IP, m.start(), m.end()) for m in DEFANGED.finditer(text)]
    for m in LOOSE_NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            digits = SEPARATORS.sub("", m[0])
            if 13 <= len(digits) <= 19 and (luhn(digits) or len(digits) > 15):
                found.append((CARD, m.start(), m.end()))
            elif 7 <= len(digits) <= 15:
                found.append((PHONE, m.start(), m.end()))
    taken = sorted((s, e) for _, s, e in base)
    out, upto, i = [], 0, 0
    for kind, s, e in sorted(found, key=lambda c: (c[1], -c[2], c[0])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= upto and not (i < len(taken) and taken[i][0] < e):
            out.append((kind, s, e))
            upto = e
    return out


def votes_and_features(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int]:
    """Every labeler's vote on the span (two bits each) and the classifier's bits."""
    span = text[start:end]
    digits = SEPARATORS.sub("", span)
    groups = [g for g in SEPARATORS.split(span) if g]
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    words = [w.lower() for w in BEFORE.findall(text[max(0, start - CONTEXT_CHARS) : start])][-5:]
    sums, listed, shaped = ABSTAIN, ABSTAIN, ABSTAIN
    if kind == EMAIL:
        plain = re.sub(r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20", ".", span, flags=re.IGNORECASE)
        ending = plain.rpartition(".")[2].lower()
        sums = YES if ending.isalpha() and ".." not in plain else NO
        listed = YES if ending in ENDINGS else NO
        shaped = YES if "@" in span or re.search(r"[\[({<]|\x20dot\x20", span) else ABSTAIN
    elif kind == IP:
        plain = re.sub(r"[\[({](?:\.|dot)[\])}]", ".", span)
        try:
            at = ipaddress.ip_address(".".join(str(int(p)) for p in plain.split(".")) if ":" not in plain else plain)
            sums = YES
            listed = YES if at.version == 4 or any(at in net for net in V6_BLOCKS) else NO
        except ValueError:
            sums = listed = NO
        shaped = YES if "." in plain and all(p == str(int(p)) for p in plain.split(".")) or plain.count(":") == 7 or len(plain) > 6 and "::" in plain else NO
    elif kind == CARD:
        sums = YES if luhn(digits) and len(set(digits)) > 1 else NO
        listed = YES if ISSUERS.match(digits) else NO
        sizes = [len(g) for g in groups]
        shaped = YES if sizes in ([4, 4, 4, 4], [4, 6, 5]) else NO if len(sizes) > 1 else ABSTAIN
    else:
        sums = YES if 8 <= len(digits) <= 15 else ABSTAIN if len(digits) == 7 else NO
        dialled = digits.removeprefix("00") if span.startswith("00") else digits
        national = len(digits) in (10, 11) and [len(g) for g in groups][-3:] == [3, 3, 4]
        listed = (YES if CALLING.match(dialled) else NO) if span.startswith(("+", "00")) else YES if national else ABSTAIN
        dates = re.fullmatch(r"(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})", span)
        shaped = NO if dates or len(groups) == 1 or "/" in span else YES if national or span.startswith(("+", "00")) or [len(g) for g in groups] == [3, 4] else ABSTAIN
    helps, hurts = not SPEAKS_FOR[kind].isdisjoint(words), not SPEAKS_AGAINST.isdisjoint(words)
    joined = any(c.isalnum() or c == "_" for c in around)
    votes = (YES if strict else ABSTAIN, sums, listed, YES if helps else NO if hurts else ABSTAIN, NO if joined else YES, shaped)
    bits = (True, strict, sums == YES, listed == YES, helps, hurts, joined, shaped == YES, len(groups) > 1, span[0] in "+(" or span.startswith("00"), any(c in span for c in "([{<"), len(span) > 24, any(c in "\"'=" for c in around))
    return sum(v << 2 * i for i, v in enumerate(votes)), sum(1 << i for i, b in enumerate(bits) if b)


def spans_of(text: str | None) -> list[dict]:
    """Base spans and candidates of one whole text, by kind and start, with votes and features."""
    text = text or ""
    base = base_spans(text)
    rows = [(*s, True) for s in base] + [(*s, False) for s in candidate_spans(text, base)]
    out = []
    for kind, start, end, strict in sorted(rows):
        votes, features = votes_and_features(text, kind, start, end, strict)
        out.append({"kind": kind, "start": start, "end": end, "base": strict, "votes": votes, "features": features})
    return out


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.int32())]))


def scanned(docs: DataFrame) -> DataFrame:
    """FOUND for each row of docs; written once, as counts and decisions read it."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spans_of(t) for _, t in each_row(b)], SPAN_TYPE)], ["doc_id", "spans"])

    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, FOUND), "pii-spans")


@dataclass
class Reliability:
    """Of one kind: the share of personal data, and P(vote | class) of each labeler as [class, labeler, vote]."""

    prior: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(personal | votes) of patterns as rows of one vote for each labeler."""
        at = np.arange(votes.shape[1])
        logs = np.log(self.table[:, at, votes]).sum(-1)
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - self.prior) / self.prior), -60, 60)))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return np.array([[p >> 2 * i & 3 for i in range(len(LABELERS))] for p in patterns.tolist()], int).reshape(-1, len(LABELERS))


def reliability(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> Reliability:
    """Expectation-maximisation over vote patterns that occur n times each.

    It starts from the majority of the votes; a small prior says that a labeler is rather right than wrong, which also
    settles which class is which and what holds where there is little or no data.
    """
    belief = np.array([[2.0, 1.0, 4.0], [2.0, 4.0, 1.0]])[:, None, :].repeat(len(LABELERS), 1)
    belief[:, LABELERS.index("arithmetic")] = [[1.0, 1.0, 8.0], [1.0, 8.0, 0.5]]
    p = 1 / (1 + np.exp(-1.5 * ((votes == YES).sum(1) - (votes == NO).sum(1))))
    model = Reliability(0.5, belief / belief.sum(-1, keepdims=True))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * n, p * n])
        seen = np.stack([(weight @ (votes == v)) for v in (ABSTAIN, YES, NO)], -1) + belief
        model = Reliability(float((weight[1].sum() + 2) / (n.sum() + 4)), seen / seen.sum(-1, keepdims=True))
        new = model.posterior(votes)
        done = len(p) == 0 or np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return model


#: What the classifier believes beforehand, as if so many spans had been seen: one with all that speaks for it, and ones
#: that are well formed but fail the arithmetic, or stand inside a word.
SPEAK_FOR = sum(1 << FEATURES.index(f) for f in ("any", "strict", "arithmetic", "gazetteer", "context", "shape", "separated"))
BELIEVED = ((SPEAK_FOR, 1.0, 4.0), (1 | 1 << FEATURES.index("gazetteer"), 0.0, 4.0), (1 | 1 << FEATURES.index("joined"), 0.0, 4.0))


def fitted(bits: np.ndarray, n: np.ndarray, soft: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of soft labels on feature bits, rows weighted by n (Newton's method)."""
    bits, soft, n = (np.concatenate([a, [b[i] for b in BELIEVED]]) for a, i in ((bits, 0), (soft, 1), (n, 2)))
    x = np.array([[int(b) >> i & 1 for i in range(len(FEATURES))] for b in bits.tolist()], float).reshape(-1, len(FEATURES))
    w = np.zeros(len(FEATURES))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (n * (soft - p)) - l2 * w)
        w = w + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 9)


@dataclass
class SpanModel:
    labelers: list[Reliability]  #: by kind
    weights: np.ndarray  #: [kind, feature]

    def accepts(self, kind: int, features: int) -> bool:
        return sum(w for i, w in enumerate(self.weights[kind].tolist()) if features >> i & 1) > 0

    def score(self, kind: Column, features: Column) -> Column:
        """The classifier's log-odds of a span as a column."""
        one = lambda w: sum((F.when(features.bitwiseAND(1 << i) != 0, F.lit(float(x))).otherwise(F.lit(0.0)) for i, x in enumerate(w)), F.lit(0.0))
        out = one(self.weights[0])
        for k in range(1, len(KINDS)):
            out = F.when(kind == k, one(self.weights[k])).otherwise(out)
        return out


def train(found: DataFrame) -> SpanModel:
    """Labelers' reliabilities and the classifier from the spans of all documents.

    What comes to the driver are counts by vote pattern (at most 4 kinds x 3 ** 6) and by feature bits (at most 4 x 2 ** 13).
    """
    spark = found.sparkSession
    counts = staged(found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n")), "pii-counts")
    seen = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    labelers, posteriors = [], []
    for k in range(len(KINDS)):
        patterns, n = (np.array([r[c] for r in seen if r["kind"] == k], np.int64) for c in ("votes", "n"))
        model = reliability(unpacked(patterns), n.astype(float))
        labelers.append(model)
        posteriors += [(k, v, p) for v, p in zip(patterns.tolist(), model.posterior(unpacked(patterns)).tolist())]
    soft = spark.createDataFrame(posteriors, "kind int, votes int, p double")
    joined = counts.join(F.broadcast(soft), ["kind", "votes"])  # a row for each vote pattern
    rows = joined.groupBy("kind", "features").agg(F.sum("n").alias("n"), F.sum(F.round(F.col("p") * F.col("n"), 6).cast("decimal(38,6)")).alias("p")).orderBy("kind", "features").collect()
    weights = []
    for k in range(len(KINDS)):
        mine = [r for r in rows if r["kind"] == k]
        n = np.array([r["n"] for r in mine], float)
        weights.append(fitted(np.array([r["features"] for r in mine], np.int64), n, np.array([float(r["p"]) for r in mine]) / np.maximum(n, 1)))
    return SpanModel(labelers, np.array(weights))


def decided(found: DataFrame, model: SpanModel) -> DataFrame:
    """(doc_id, spans): base spans and the candidates that the classifier takes, by kind and start, with kind, start, end,
    base and p."""
    p = lambda s: F.lit(1.0) / (1 + F.exp(-model.score(s["kind"], s["features"])))
    names = F.array(*map(F.lit, KINDS))
    taken = F.filter("spans", lambda s: s["base"] | (model.score(s["kind"], s["features"]) > 0))
    told = F.transform(taken, lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), p(s).alias("p")))
    return found.select("doc_id", told.alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs; places are code points, ends exclusive.

    A null text is empty and has no spans. Null and repeated ids and equal rows are each looked at. The time for a text
    is linear in its length, whatever it is made of. Other columns do not matter; without documents there are no rows, and
    with no candidates at all the labelers keep what they are believed to be.
    """
    found = scanned(docs)
    return decided(found, train(found))


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with every span replaced in text by its kind in angle brackets, in a scan of its own; all columns stay."""

    def masked(text):
        if not text:
            return text
        spans = sorted((s["start"], s["end"], s["kind"]) for s in spans_of(text) if s["base"] or model.accepts(s["kind"], s["features"]))
        out, upto = [], 0
        for start, end, kind in spans:
            if start >= upto:
                out += [text[upto:start], f"<{KINDS[kind]}>"]
            upto = max(upto, end)
        return "".join(out) + text[upto:]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array([masked(t) for (t,) in each_row(b.select(["text"]))], pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digests(rows: DataFrame) -> DataFrame:
    """The counts and digest of the base spans, and all spans as a string, of (doc_id, spans)."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"))
