"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds. Features are the distinct
lower-cased words of the whole text and their beginnings, those that tell the classes apart in the sample. The model is fitted on the driver from a bounded sample of labelled rows, and a
scan scores every document; nothing is shuffled but the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import each_row

GRADES = 4  #: 0 clean, 1 mild, 2 marked, 3 severe
WORD = re.compile(r"[^\W\d_]+")
LEAST_RATIO = 15.0  #: log-likelihood ratio from which a feature enters the model


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings of 3 to 8 letters."""
    return [word, *(f"{word[:k]}~" for k in range(3, min(8, len(word)) + 1))]


def words_of(text: str | None) -> list[str]:
    return sorted(set(WORD.findall((text or "").lower())))


def indexed(docs: list[list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Each document's feature numbers, ascending, and the features' names."""
    known: dict[str, int] = {}
    numbers: dict[str, tuple[int, ...]] = {}
    out = []
    for words in docs:
        for w in words:
            if w not in numbers:
                numbers[w] = tuple(known.setdefault(f, len(known)) for f in word_features(w))
        out.append(np.unique(np.fromiter(chain.from_iterable(numbers[w] for w in words), np.int32)))
    return out, list(known)


def contrast(rows: list[np.ndarray], n_features: int, toxic: np.ndarray, min_df: int) -> np.ndarray:
    """Log-likelihood ratio of each feature against the class, negative where toxic rows lack it; 0 below min_df rows."""
    df = np.zeros((2, n_features))
    for r, y in zip(rows, toxic):
        df[y, r] += 1
    b, a = df
    n1, n0 = float(toxic.sum()), float((1 - toxic).sum())
    if not n1 or not n0:
        return np.zeros(n_features)
    p = (a + b) / (n1 + n0)
    out = np.zeros(n_features)
    for o, e in ((a, n1 * p), (n1 - a, n1 * (1 - p)), (b, n0 * p), (n0 - b, n0 * (1 - p))):
        ok = (o > 0) & (e > 0)
        out[ok] += 2 * o[ok] * np.log(o[ok] / e[ok])
    return np.where(a + b >= min_df, np.where(a * n0 > b * n1, out, -out), 0.0)


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    theta: np.ndarray

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade) per row, from w.x."""
        below = 1 / (1 + np.exp(np.clip(z[:, None] - self.theta[None, :], -60, 60)))
        edges = np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))])
        return np.diff(edges, axis=1)


def grade_labels(rows: list[np.ndarray], ratios: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ordered grades from binary labels: clean rows are 0; toxic rows are cut at the terciles of how many features they
    hold that speak for the toxic class."""
    held = np.array([float((ratios[r] > LEAST_RATIO).sum()) for r in rows])
    grades = np.zeros(len(rows), dtype=int)
    if toxic.any():
        cuts = np.quantile(held[toxic == 1], [1 / 3, 2 / 3])
        grades[toxic == 1] = 1 + np.searchsorted(cuts, held[toxic == 1], side="left")
    return grades


def fit_ordinal(docs: list[list[str]], toxic: np.ndarray, min_df: int = 3, max_features: int = 5000, rounds: int = 1000, rate: float = 0.05, l2: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the mean negative log-likelihood with an L2 penalty. docs: the distinct words of each row."""
    rows, names = indexed(docs)
    ratios = contrast(rows, len(names), toxic, min_df)
    grades = grade_labels(rows, ratios, toxic)
    chosen = [i for i in np.argsort(-np.abs(ratios), kind="stable")[:max_features].tolist() if abs(ratios[i]) > LEAST_RATIO]
    vocab = [names[i] for i in chosen]
    column = np.full(len(names), -1)
    column[chosen] = np.arange(len(chosen))
    held = [column[r][column[r] >= 0] for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(h) for h in held]).astype(np.int64)
    col = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
    n, m = len(rows), len(vocab)
    w, theta0, gaps = np.zeros(m), 2.0, np.full(GRADES - 2, -1.0)
    p = np.concatenate([w, [theta0], gaps])
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    one = np.eye(GRADES)
    if n == 0:
        return OrdinalModel({}, np.array([2.0 + k for k in range(GRADES - 1)]))
    for step in range(1, rounds + 1):
        theta = p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])
        z = np.bincount(row, weights=p[col], minlength=n) if len(row) else np.zeros(n)
        below = 1 / (1 + np.exp(np.clip(z[:, None] - theta, -60, 60)))
        edges = np.hstack([np.zeros((n, 1)), below, np.ones((n, 1))])
        like = np.maximum((np.diff(edges, axis=1) * one[grades]).sum(1), 1e-12)
        slope = below * (1 - below)
        up = one[grades][:, : GRADES - 1] * slope  # d like / d theta_g
        down = one[grades][:, 1:] * slope  # minus d like / d theta_(g-1)
        d_theta = -((up - down) / like[:, None]) / n
        d_z = -d_theta.sum(1)
        g = np.zeros_like(p)
        if m:
            g[:m] = np.bincount(col, weights=d_z[row], minlength=m) + l2 * p[:m]
        t = d_theta.sum(0)
        g[m] = t.sum()
        for k in range(GRADES - 2):
            g[m + 1 + k] = t[k + 1 :].sum() * np.exp(p[m + 1 + k])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p - rate * (1 - step / (rounds + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    theta = p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])
    return OrdinalModel({v: float(x) for v, x in zip(vocab, p[:m]) if abs(x) > 1e-6}, theta)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[list[list[str]], np.ndarray]:
    """At most limit labelled rows, in halves by class, chosen by a hash of the id; their distinct words come back, not their
    texts, and once for an id that several rows have."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    halves = [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(limit // 2) for y in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # at most limit rows

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(words_of(t)) for t, *_ in each_row(b)], pa.string()), b.column(1), b.column(2)], ["words", "y", "h"])

    found = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y", "h").mapInArrow(run, "words string, y int, h bigint")
    got = found.groupBy("h").agg(F.min("words").alias("words"), F.min("y").alias("y")).collect()  # one row for each id, however often it comes
    got.sort(key=lambda r: (r["h"], r["words"]))
    return [r["words"].split() for r in got], np.array([r["y"] for r in got], dtype=int)


def train(docs: DataFrame, labels: DataFrame, sample_limit: int = 4000) -> OrdinalModel:
    """Fit on at most sample_limit labelled rows, whatever the size of the tables."""
    return fit_ordinal(*labelled_sample(docs, labels, "toxic", sample_limit))


def score(docs: DataFrame, model: OrdinalModel, cut: float = 0.35) -> DataFrame:
    """One row per row of docs: doc_id, expected_severity (0 to 3), grade (the likeliest), p_toxic, toxic (p_toxic >= cut).

    A null or empty text scores as one without words. Null or repeated ids and equal rows are each scored; other columns
    are ignored; an empty table gives no rows. With no labels at all, the model is a constant that calls nothing toxic.
    Very long texts are scored whole. The labels are binary, so the grades that the model is fitted to are made from the
    same words as its features: severity orders documents by how much they hold of what tells the classes apart.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features words

    def run(batches):
        m = shared.value
        known: dict[str, tuple[str, ...]] = {}

        def z_of(text):
            found = set()
            for w in set(WORD.findall((text or "").lower())):
                hit = known.get(w)
                if hit is None:
                    if len(known) > 300_000:
                        known.clear()
                    known[w] = hit = tuple(f for f in word_features(w) if f in m.weights)
                found.update(hit)
            return sum(m.weights[f] for f in sorted(found))

        for b in batches:
            z = np.array([z_of(t) for _, t in each_row(b)], dtype=float)
            p = m.probabilities(z)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p @ np.arange(GRADES)), pa.array(p.argmax(1).astype(np.int64)), pa.array(1 - p[:, 0]), pa.array(1 - p[:, 0] >= cut)], ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, expected_severity double, grade bigint, p_toxic double, toxic boolean")
