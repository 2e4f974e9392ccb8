"""Language identification by error-correcting output codes.

Each language has a codeword of bits; codewords differ in as many bits as can be. For each bit a binary classifier
over hashed character n-grams predicts a margin. Decoding is weighted by loss: for each codeword the exponential
losses of its bits under the margins add up, and the least loss wins. The share of the winner in exp(-loss) is the
score; where it leads the next one by too little, the row is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import mixed, slices, texts_of

UNKNOWN = "und"


def codewords(n: int, bits: int = 15, seed: int = 7) -> np.ndarray:
    """(n, columns) of -1 and 1. No two columns split the languages alike: few languages get every split there is, many
    ``bits`` random ones (more where they must tell more than 2^bits apart), of draws the one whose codewords are farthest apart."""
    if n < 2:
        return np.ones((n, 1), np.int64)
    if n - 1 < 31 and (1 << (n - 1)) - 1 <= bits:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits >> np.arange(n)[:, None] & 1, 1, -1)
    rng, bits = np.random.default_rng(seed), max(bits, 2 * int(np.ceil(np.log2(n))))
    best, score = None, (-1, -1)
    for _ in range(200 if n <= 64 else 4):
        c = rng.integers(0, 2, (n, bits)) * 2 - 1
        same = np.flatnonzero(np.abs(c.sum(axis=0)) == n)  # a column that is the same for all tells nothing
        c[rng.integers(0, n, len(same)), same] *= -1
        rows, columns = c @ c.T, np.abs(c.T @ c)
        np.fill_diagonal(rows, -bits)
        np.fill_diagonal(columns, 0)
        least = ((bits - int(rows.max())) // 2, n - int(columns.max()))
        if least > score:
            best, score = c, least
    return best


@dataclass
class Features:
    """Hashed n-grams of code points, each order in its own share of the buckets, as unit frequencies per order."""

    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 10

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each order the bucket at every place of the texts, and each text's first place (one line end added).

        Texts are joined with so many line ends that no n-gram reaches the next text: a text's n-grams are its own.
        """
        gap = max(self.orders)
        joined = "".join(t + "\n" * gap for t in texts)
        points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) != len(joined):  # a few capitals become two characters
            points = np.frombuffer("".join(c if len(d := c.lower()) > 1 else d for c in joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) + gap for t in texts], np.int64)
        keep = np.ones(len(points), bool)
        last = np.cumsum(size)
        for k in range(1, gap):
            keep[last - k] = False
        starts = np.concatenate([[0], np.cumsum(size - gap + 1)])
        unit, out = mixed(points.astype(np.uint64) + np.uint64(1)), []
        h = np.zeros(len(points), np.uint64)
        for k in range(max(self.orders)):
            shifted = np.concatenate([unit[k:], np.zeros(min(k, len(unit)), np.uint64)])[: len(unit)]
            h = h * np.uint64(0x100000001B3) + shifted
            if k + 1 in self.orders:
                place = self.orders.index(k + 1)
                out.append((mixed(h) & np.uint64(self.buckets - 1)).astype(np.int32)[keep] + place * self.buckets)
        return out, starts

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Frequencies by bucket: the root of each, so that rare n-grams weigh too."""
        out = np.zeros((len(texts), len(self.orders) * self.buckets), np.float32)
        for k, t in enumerate(texts):
            grams, _ = self.of([t])
            for g in grams:
                out[k] += np.bincount(g, minlength=out.shape[1])[: out.shape[1]] / len(g)
        return out

    def scores(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """``matrix(texts) @ weights``, of whole texts: counts of all texts' n-grams in one pass for each order."""
        grams, starts = self.of(texts)
        n = np.diff(starts)
        row = np.repeat(np.arange(len(texts)) * self.buckets, n)
        out = np.zeros((len(texts), weights.shape[1]), np.float64)
        for k, g in enumerate(grams):
            count = np.bincount(row + (g - k * self.buckets), minlength=len(texts) * self.buckets).reshape(len(texts), -1)
            out += (count / n[:, None]) @ weights[k * self.buckets : (k + 1) * self.buckets].astype(np.float64)
        return out


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regressions for the columns of ``y`` (-1, 0 to leave out, 1): weights, biases; gradient descent with Adam."""
    mean = x.mean(axis=0)
    scale = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", x, x) / max(1, len(x)) - mean * mean)) + 1e-4
    # features are standardised in the formulas, not in a copy of x
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    used = np.maximum(1, (y != 0).sum(axis=0))
    rate = 0.01
    for t in range(1, steps + 1):
        u = w / scale[:, None]
        p = 1 / (1 + np.exp(np.clip(y * (x @ u + (b - mean @ u)), -30, 30)))
        d = (-(y * p) / used).astype(np.float32)
        g = (x.T @ d - np.outer(mean, d.sum(axis=0))) / scale[:, None] + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        b -= rate * 10 * d.sum(axis=0)
    w = w / scale[:, None]
    return w, b - mean @ w, scale


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    features: Features
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], features: Features, bits: int = 15) -> LanguageModel:
        """``x``: features of texts and of windows of them, ``langs`` their languages."""
        languages = sorted(set(langs))
        codes = codewords(len(languages), bits)
        place = {lang: k for k, lang in enumerate(languages)}
        if not languages:
            return cls(languages, codes, features, np.zeros((len(features.orders) * features.buckets, 1), np.float32), np.zeros(1))
        w, b, _ = logistic(x, codes[[place[lang] for lang in langs]].astype(np.float32))
        return cls(languages, codes, features, w.astype(np.float32), b)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, its score, and its lead over the next one."""
        loss = np.exp(-np.clip(margins[:, None, :] * self.codes[None], -2, 2)).mean(axis=2)
        p = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        return loss.argmin(axis=1), order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.decode(self.features.scores(texts, self.weights) + self.bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


WINDOWS = (300, 24)


def windows(text: str) -> list[str]:
    """The whole text, and a window of each length in WINDOWS at a place chosen by a hash, so that short texts are known too."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return [text, *(text[at : at + n] for n in WINDOWS for at in (h % max(1, len(text) - n + 1),))]


def fit(docs: DataFrame, most: int = 250, features: Features | None = None) -> LanguageModel:
    """Learn from whole ``text`` and ``lang`` of rows that are not held out: ``most`` rows of each language, those with the
    least hash of their id (ties by id, then by a hash of the text). Every language that has a row is learned. Tasks turn texts
    into features; only those come to the driver."""
    from pyspark.sql import Window

    features = features or Features()
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # a row for each language
    # a hash below a threshold by language keeps about twice the sample before it is ranked
    rows = rows.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)).alias("h"), F.xxhash64("text").alias("t")).join(F.broadcast(sums), "lang")
    rows = rows.where(F.col("h") * F.col("n") < F.lit(2.0 * most * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64, 1 << 20):
            x = [features.matrix(windows(t)).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))).where(F.col("k") <= most)
    got = ranked.orderBy("lang", "k").select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, len(features.orders) * features.buckets)
    return LanguageModel.fit(x, [lang for lang in got.column("lang").to_pylist() for _ in range(1 + len(WINDOWS))], features)


def identify(docs: DataFrame, model: LanguageModel, least_lead: float = 0.2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score (0 to 1) and ambiguous, from whole texts alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Empty tables give no
    rows, repeated rows are predicted each, equal losses go to the first language by name; other columns pass
    through only if named in ``keep``.
    """
    fields = {f.name: f.dataType for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by buckets, bits and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 128, 1 << 20):
            texts, fine = texts_of(batch.column("_text")), np.array(batch.column("_letters").to_pylist(), bool)
            lang, score, flag = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if fine.any() and m.languages:
                at = np.flatnonzero(fine)
                best, p, lead = m.predict([texts[k] for k in at])
                for k, x in zip(at, best, strict=True):
                    lang[k] = m.languages[x]
                score[at], flag[at] = np.clip(p, 0, 1), lead < least_lead
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(flag)], [*keep, "lang_pred", "score", "ambiguous"])

    wanted = docs.select(*keep, F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = ", ".join(f"`{c}` {fields[c].simpleString()}" for c in keep)
    return wanted.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Fit, then predict every row: doc_id, held_out, lang_pred, score, ambiguous."""
    out = identify(docs, fit(docs))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
