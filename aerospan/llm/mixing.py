"""Soft-membership mixing: domain posteriors from a classifier, and document rates that meet target weights.

A classifier learned on a labelled table gives each document a posterior over domains. Rates r >= 0 are fitted so that
the expected tokens of each domain, the sum of r x tokens x posterior over all documents, meet the targets in the least
squares, with a small ridge that holds rates to one where the targets leave them free. The fit is projected gradient
descent from r = 1. Since every gradient lies in the span of the posteriors, the state is one multiplier a domain: rates
are the projection max(0, 1 - multipliers . posterior). A step is one distributed aggregate, the residuals and the
curvature over rates that are not at zero (a number for each pair of domains), and the gradient is scaled by that
curvature: seen from the multipliers, a damped Newton step on the dual. A ridge below the usual one is come to by tenths,
each fit starting where the one before ended. Rates are an expression of constant size over the written posteriors and are never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import numbered_rows, slices, texts_of, written
from aerospan.llm.langid import logistic

BUCKETS = 1 << 18
STRIPPED = " \t\n\r\x0b\x0c.,;:!?\"'()[]"
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()-]")


def word_buckets(text: str) -> tuple[set[int], int]:
    """Hashed different words (lower case, punctuation off), and the number of words."""
    words = text.lower().split()
    return {xxhash.xxh3_64_intdigest(w.strip(STRIPPED)) % BUCKETS for w in set(words)}, len(words)


def shape(text: str, n: int) -> list[float]:
    """A few facts about a text's form, all between 0 and about 1."""
    size = max(1, len(text))
    lines = text.split("\n")
    return [min(2.0, len(SYMBOL.findall(text)) / max(1, n)), len(set(lines)) / len(lines), np.log1p(n) / 10, min(2.0, 10 * n / size), sum(map(text.count, ".!?")) / size * 20, float(text.isupper()), float(n < 10)]


SHAPE = 7
#: What a mean squared distance of rates from one weighs against a squared miss of the target shares.
RIDGE = 1e-3
#: The same where the targets come first: shares are met to about a thousandth, at the price of rates far from one.
FREE = 1e-6


@dataclass
class DomainModel:
    domains: list[str]
    table: np.ndarray  # bucket -> column of weights, or -1
    weights: np.ndarray
    bias: np.ndarray
    scale: float = 1.0

    @classmethod
    def fit(cls, rows: list[tuple[list[int], list[float]]], labels: list[str], top: int = 96, support: int = 5) -> DomainModel:
        """``rows``: word buckets and shape of each text. Margins are calibrated: the scale that makes a model of every other row
        give the rest the greatest likelihood is that of the model of all rows."""
        model, n = cls.of(rows, labels, top, support), len(rows)
        half = cls.of(rows[::2], labels[::2], top, support) if n > 20 else model
        if len(model.domains) > 1 and half.domains == model.domains:
            z, want = half.margins(rows[1::2]), np.array([model.domains.index(x) for x in labels[1::2]])
            loss = lambda s: -np.log(softmax(s * z)[np.arange(len(want)), want] + 1e-6).mean()
            model.scale = min((2 ** (k / 4) for k in range(-4, 17)), key=loss)
        return model

    @classmethod
    def of(cls, rows, labels: list[str], top: int, support: int) -> DomainModel:
        """Words that are most telling of each domain, then a logistic regression for each domain against the rest."""
        domains = sorted(set(labels))
        by = np.zeros((len(domains), BUCKETS), np.int32)
        for (words, _), d in zip(rows, labels, strict=True):
            by[domains.index(d), words] += 1
        total, n, chosen = by.sum(axis=0), len(rows), {}
        for k, d in enumerate(domains):
            usual = total * (labels.count(d) / n)
            telling = np.where((total >= support) & (by[k] > 0), np.abs(by[k] - usual) / np.sqrt(usual + 1), -1)
            for w in np.argsort(-telling, kind="stable")[:top].tolist():
                if telling[w] >= 0:
                    chosen.setdefault(w, len(chosen))
        table = np.full(BUCKETS, -1, np.int32)
        for w, k in chosen.items():
            table[w] = k
        model = cls(domains, table, np.zeros((len(chosen) + SHAPE, len(domains))), np.zeros(len(domains)))
        if len(domains) > 1:
            y = np.array([[1.0 if d == x else -1.0 for d in domains] for x in labels], np.float32)
            model.weights, model.bias, _ = logistic(model.features(rows), y, steps=300, l2=1e-3)
        return model

    def features(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.weights)), np.float32)
        for k, (words, form) in enumerate(rows):
            at = self.table[words]
            out[k, at[at >= 0]] = 1
            out[k, -SHAPE:] = form
        return out

    def margins(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        return self.features(rows) @ self.weights + self.bias

    def posterior(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """Chances of the domains."""
        return softmax(self.scale * self.margins(rows))


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def facts(text: str) -> tuple[np.ndarray, list[float]]:
    """Word buckets and shape of a whole text."""
    words, n = word_buckets(text)
    return np.fromiter(words, np.int64, len(words)), shape(text, n)


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domains of the labels table."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def fit(docs: DataFrame, labelled: DataFrame, most: int = 6000) -> DomainModel:
    """Learn from whole texts of ``labelled`` (doc_id, domain): of ``most`` rows, those with the least hash of their id (ties by
    id, then by a hash of the text). A row with null domain or a document that is not there is left out. Tasks turn texts into
    word buckets; only those come to the driver."""
    rows = labelled.where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(5))).orderBy("h", "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, form = zip(*map(facts, texts_of(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "doc_id", "t", "domain")), pa.array(words, pa.list_(pa.int32())), pa.array(form, pa.list_(pa.float64()))], ["h", "doc_id", "t", "domain", "words", "form"])

    met = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(F.broadcast(rows), "doc_id").select("h", "doc_id", "t", "domain", "text")
    got = met.mapInArrow(run, "h long, doc_id long, t long, domain string, words array<int>, form array<double>").orderBy("h", "doc_id", "t").limit(most).collect()
    if not got:
        return DomainModel(["all"], np.full(BUCKETS, -1, np.int32), np.zeros((SHAPE, 1)), np.zeros(1))
    return DomainModel.fit([(r.words, r.form) for r in got], [r.domain for r in got])


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """uid, doc_id, tokens (words of the whole text), p (chance of each domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and the words chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch.column("text"))
            p = shared.value.posterior([facts(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["uid", "doc_id", "tokens", "p"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, tokens long, p array<double>")


def rate_of(pull: list[float]) -> Column:
    """max(0, 1 - pull . p)."""
    return F.greatest(F.lit(0.0), 1 - sum((F.lit(float(x)) * F.get("p", F.lit(j)) for j, x in enumerate(pull)), F.lit(0.0)))


def rates(members: DataFrame, weights: list[float], total: float | None = None, ridge: float = RIDGE, enough: float = 1e-7, most: int = 60) -> tuple[list[float], dict[str, list[float]]]:
    """The multipliers of the rates of ``members`` (tokens, p) (see :func:`rate_of`), and what they reach: expected tokens by domain.

    ``weights``: target share of each domain. ``total``: expected tokens in all, by default those of ``members``. Minimised, in
    shares of all tokens: |expected - target|^2 + ridge x mean of (rate - 1)^2. Raises if ``most`` steps for one ridge do not get there.
    """
    k = len(weights)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.get("p", F.lit(j)) for j in range(k)]

    def look(pull: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean of rate^2, expected tokens by domain, curvature over open rates."""
        r, t = rate_of(pull.tolist()), F.col("tokens")
        open_t = F.when(r > 0, t).otherwise(0)
        row = members.agg(F.sum(t * r * r), *(F.sum(t * r * q) for q in p), *(F.sum(open_t * p[i] * p[j]) for i, j in pairs)).first()
        row = [float(x or 0) for x in row]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[k + 1 :], strict=True):
            curve[i, j] = curve[j, i] = x
        return row[0], np.array(row[1 : k + 1]), curve

    square, have, curve = look(np.zeros(k))
    tokens = float(have.sum())
    if not tokens or not sum(weights):
        return [0.0] * k, {"expected": have.tolist(), "target": [0.0] * k}
    goal = np.array(weights, float) / sum(weights) * (tokens if total is None else total)
    pull, ridges = np.zeros(k), [ridge]
    while ridges[0] * 10 < RIDGE * 1.01:
        ridges.insert(0, ridges[0] * 10)
    for ridge in ridges:
        # the dual of the fit: ridge x pull + target - expected is its gradient, ridge + curvature its second derivative
        worth = lambda pull, square, ridge=ridge: 0.5 * square / tokens + 0.5 * ridge * pull @ pull + pull @ goal / tokens
        now = worth(pull, square)
        for _ in range(most):
            slope = ridge * pull + (goal - have) / tokens
            if np.abs(slope).max() <= enough:
                break
            step, size = np.linalg.solve(curve / tokens + ridge * np.eye(k), slope), 1.0
            while True:
                new = pull - size * step
                square, have, curve = look(new)
                then = worth(new, square)
                if then <= now - 1e-4 * size * (slope @ step) + 1e-12 or size < 1e-6:
                    break
                size /= 2
            pull, now = new, then
        else:
            raise RuntimeError(f"rates did not settle in {most} steps")
    return pull.tolist(), {"expected": have.tolist(), "target": goal.tolist()}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], seed: int = 11, whole: str | None = None, ridge: float = RIDGE, uid: str | None = None) -> DataFrame:
    """uid, doc_id, tokens, p_<domain>, rate, copies of each row of ``docs`` (doc_id, text); targets by ``weights``.

    ``copies`` is the rate rounded at random, up with the chance of its fraction by a hash of uid, so expected copies are the
    rate. A domain without a weight has target zero. Null and empty texts have no tokens and their own posterior; rows with
    equal doc_id are told apart by uid (a column of ``docs`` if ``uid`` names one); whole texts of any length are read; an empty table gives no rows; without labelled
    rows all is one domain and all rates are one; other columns are not read. Expected tokens in all are those of ``docs``;
    with ``whole``, they are more where that domain's target would be less than it has, so that it need not shrink.
    """
    docs = numbered_rows(docs, uid)
    model = fit(docs, labelled)
    members = written(posteriors(docs, model), "posteriors")
    shares, total = [weights.get(d, 0.0) for d in model.domains], None
    if whole in model.domains and weights.get(whole):
        at = model.domains.index(whole)
        have, tokens = members.agg(F.sum(F.col("tokens") * F.get("p", F.lit(at))), F.sum("tokens")).first()
        total = max(float(tokens or 0), float(have or 0) * sum(shares) / shares[at])
    pull = rates(members, shares, total, ridge)[0] if len(model.domains) > 1 else [0.0]
    rate = rate_of(pull)
    u = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return members.select("uid", "doc_id", "tokens", *(F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(model.domains)), rate.alias("rate"), F.floor(rate + u).cast("long").alias("copies"))


#: Target shares of the domains of the labels table.
WEIGHTS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}


def labels_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
