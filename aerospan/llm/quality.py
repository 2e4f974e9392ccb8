"""Quality rules by weak supervision: rules vote or abstain, and what they are worth is estimated from their agreement.

Each rule looks at a document's statistics and votes good (1) or bad (-1), or abstains (0). How often each pattern of
votes occurs is counted over all documents (the table has at most 3^9 rows). On those counts expectation
maximisation fits a two-class model in which rules are independent given the class: the class prior and, for each
rule, the chance of each vote in each class. A document is kept if its posterior probability of being good is at
least ``least``; no rule decides alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import slices, texts_of, written

SYMBOL = re.compile(r"[#*$%&|<>]")
SPACES = re.compile("[ \t\n\r\x0b\x0c]+")

#: (name, statistic, good votes, bad votes) as SQL conditions over the statistics; neither: the rule abstains.
RULES = (
    ("length", "n_words >= 40", "n_words < 12"),
    ("repeats", "n_repeat_words * 100 <= n_words", "n_repeat_words * 10 > n_words"),
    ("lines", "n_dup_lines = 0", "n_dup_lines >= 3"),
    ("symbols", "n_symbols * 50 <= n_words", "n_symbols * 8 > n_words"),
    ("symbol_words", "n_symbol_words * 50 <= n_words", "n_symbol_words * 10 > n_words"),
    ("letters", "n_letters * 100 >= word_chars * 93", "n_letters * 100 < word_chars * 90"),
    ("capitals", "n_upper * 5 <= word_chars", "n_upper * 2 > word_chars"),
    ("marks", "n_end_marks * 4 <= n_words", "n_end_marks * 2 > n_words"),
    ("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_end_marks", "n_upper", "n_letters", "n_symbol_words")


def repeat_words(words: list, width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes: dict = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    if len(codes) > len(words) - 1:
        return 0
    key, k = ids, 1
    while k < width:  # ranks of runs of 2k words from ranks of runs of k; runs may overlap
        step = min(k, width - k)
        key = key[: len(key) - step] * (int(key.max()) + 1) + key[step:]
        _, key = np.unique(key, return_inverse=True)
        k += step
        if k < width and key.max() + 1 == len(key):
            return 0
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """STATS of one whole text."""
    words = SPACES.split(text.strip(" \t\n\r\x0b\x0c"))
    if words == [""]:
        return (0,) * len(STATS)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line and line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols = int(sum(count[ord(c)] for c in "#*$%&|<>"))
    letters = int(count[65:91].sum() + count[97:123].sum())
    upper = int(count[65:91].sum())
    if len(raw) > len(text):
        other = [c for c in text if c > "\x7f"]
        letters += sum(c.isalpha() for c in other)
        upper += sum(c.isupper() for c in other)
    return len(words), chars, symbols, dup, repeat_words(words), int(count[46] + count[33] + count[63]), upper, letters, sum(map(bool, map(SYMBOL.search, words))) if symbols else 0


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """STATS of each whole text (null: empty)."""
    fields = {f.name: f.dataType for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measure(t) for t in texts_of(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], [*keep, *STATS])

    schema = ", ".join([*(f"`{c}` {fields[c].simpleString()}" for c in keep), *(f"{c} long" for c in STATS)])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def votes() -> list[Column]:
    return [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).alias(f"vote_{name}") for name, good, bad in RULES]


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, trust: float = 0.02) -> tuple[float, np.ndarray]:
    """EM on vote patterns (-1, 0, 1) and their counts: prior of good, chances [class, rule, vote + 1].

    It starts from the belief that bad votes are ten times as common among bad documents, which fixes the classes (a
    good vote says less: it is the lack of one fault); that belief keeps the weight of a share ``trust`` of the documents.
    """
    n = patterns.shape[1]
    chance = np.empty((2, n, 3))
    chance[1] = [0.03, 0.12, 0.85]
    chance[0] = [0.3, 0.2, 0.5]
    prior, belief, weight = 0.8, chance.copy(), trust * counts.sum() + 1
    for _ in range(steps):
        post = posterior(patterns, prior, chance)
        new = float((post * counts).sum() / max(1, counts.sum()))
        for c, share in ((1, post), (0, 1 - post)):
            for v in range(3):
                chance[c, :, v] = (((patterns == v - 1) * (share * counts)[:, None]).sum(axis=0) + weight * belief[c, :, v]) / ((share * counts).sum() + weight)
        if abs(new - prior) < 1e-10:
            break
        prior = min(max(new, 1e-6), 1 - 1e-6)
    return prior, chance


def posterior(patterns: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    """Chance of good for each pattern."""
    logs = [np.log(p) + np.log(chance[c][np.arange(patterns.shape[1]), patterns + 1]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the contract's statistics, base_failed, kept, and posterior.

    Statistics and votes are made once and written; only counts of patterns reach the driver. Null and empty texts
    have no words and fail the base rule; repeated rows are judged each; an empty table gives no rows; other columns
    are not read.
    """
    stats = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    stats = written(stats.select("*", F.array(*votes()).alias("votes")), "quality")
    patterns = stats.groupBy("votes").count().collect()  # at most 3^9 rows
    seen = np.array([r.votes for r in patterns], np.int64).reshape(-1, len(RULES))
    prior, chance = fit(seen, np.array([r["count"] for r in patterns], np.float64))
    odds = np.log(prior) - np.log(1 - prior)
    terms = [F.get(F.array(*(F.lit(float(x)) for x in np.log(chance[1, k]) - np.log(chance[0, k]))), F.get("votes", F.lit(k)) + 1) for k in range(len(RULES))]
    score = sum(terms, F.lit(float(odds)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("posterior", 1 / (1 + F.exp(-score))).withColumn("base_failed", base)
    return out.select("doc_id", *STATS[:5], "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior")
