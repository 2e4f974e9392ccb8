"""Substring dedup with compressed FM-indexes: words that lie in a window that also starts earlier are removed.

A shard's FM-index is the Burrows-Wheeler transform of its word sequence in a wavelet matrix: one packed bit vector
for each bit of the word codes, with counts every 64 bits. Passages stream against the shard. Backward search reads a
window from its end; the interval narrows word by word, all windows of the stream in step. A window whose interval
holds it alone has a matching statistic below the threshold and leaves the stream; the windows that reach the
threshold report their interval, and the earliest place in it tells whether they start earlier elsewhere.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.llm.passages import Kind, repeated

WINDOW = 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


WORDS = Kind(WINDOW, 8, words_of, word_hashes, b" ".join)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of codes in order, by prefix doubling; the end comes before everything."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank over a sequence of codes: packed bits by level, from the highest bit down."""

    def __init__(self, codes: np.ndarray):
        self.levels = max(1, int(codes.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((codes >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def starts(self, alphabet: int) -> np.ndarray:
        """Where each code's run begins in the last level's order."""
        c = np.arange(alphabet)
        return self.rank(c, np.zeros(alphabet, np.int64), raw=True)

    def rank(self, codes: np.ndarray, at: np.ndarray, raw: bool = False) -> np.ndarray:
        """How many of each code stand before each place (``raw``: its place in the last order)."""
        for k in range(self.levels):
            word = at >> 6
            low = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word].astype(np.int64) + np.bitwise_count(low)
            one = (codes >> (self.levels - 1 - k)) & 1 == 1
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Of a sequence in which code 0 stands between passages."""

    def __init__(self, text: np.ndarray):
        self.text, self.sa = text, suffix_array(text)
        self.bwt = WaveletMatrix(text[self.sa - 1])
        alphabet = int(text.max(initial=0)) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.base = self.bwt.starts(alphabet)

    def search(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the text at ``starts`` that occur twice or more: their number in ``starts``, and their interval."""
        alive = np.arange(len(starts))
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.text), np.int64)
        for k in range(window - 1, -1, -1):
            c = self.text[starts[alive] + k]
            move = self.less[c] - self.base[c]
            low, high = move + self.bwt.rank(c, low), move + self.bwt.rank(c, high)
            more = high - low > 1  # one occurrence is the window itself
            alive, low, high = alive[more], low[more], high[more]
        return alive, low, high


def earlier(contents: list[bytes], uids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each passage its windows that start earlier, in another passage of the shard."""
    codes: dict[bytes, int] = {}
    seqs = [[codes.setdefault(w, len(codes) + 1) for w in c.split(b" ")] for c in contents]
    size = np.array([len(s) for s in seqs])
    base = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(base[-1], np.int64)
    for s, b in zip(seqs, base[:-1], strict=True):
        text[b : b + len(s)] = s
    index = FMIndex(text)
    of = np.repeat(np.arange(len(seqs)), size + 1)
    offset = np.arange(len(text)) - base[of]
    windows = np.flatnonzero(offset + WINDOW <= size[of])
    hit, low, high = index.search(windows, WINDOW)
    if not len(hit):
        return [np.zeros(0, np.int64)] * len(contents)
    order = np.empty(len(text), np.int64)
    order[np.lexsort((starts[of] + offset, uids[of]))] = np.arange(len(text))
    where = order[index.sa]
    lows, inverse = np.unique(low, return_inverse=True)
    highs = np.zeros(len(lows), np.int64)
    highs[inverse] = high
    edges = np.stack([lows, highs], axis=1).ravel()
    least = np.minimum.reduceat(np.concatenate([where, [len(text)]]), edges)[::2]
    late = windows[hit[least[inverse] < order[windows[hit]]]]
    late.sort()
    cuts = np.searchsorted(of[late], np.arange(len(contents) + 1))
    return [offset[late[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def substring_dedup(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_words, n_removed, kept_sha256 and the removed runs of words of each row of ``docs`` (doc_id, text).

    Null and short texts lose nothing; rows with equal doc_id count as documents of their own, ordered by text; null
    doc_id comes first; an empty table gives no rows; other columns are not read.
    """
    out = repeated(docs, WORDS, earlier, ~F.col("is_first"))
    return out.withColumnRenamed("n_units", "n_words")
