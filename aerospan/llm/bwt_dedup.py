"""Suffix-array dedup by merging Burrows-Wheeler transforms: bytes in a 200-byte string that occurs twice are removed.

Each shard of passages is suffix-sorted once. Shards are then merged without sorting their suffixes again: the
interleave, which says for each place of the merged order which shard its suffix is from, is refined step by step.
Reading the shards' transforms in the order of the interleave and dealing them stably by the bytes that precede gives
the interleave for prefixes that are one step longer; where two neighbours first differ in a step, their common prefix
is known. After ``WINDOW`` bytes, the places not yet told apart are the repeated intervals.

A step reads a block of ``STEP`` bytes at once. Blocks are letters of a large alphabet; which of two letters comes
first does not matter for equal prefixes, so letters are 64-bit hashes of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.llm.passages import Kind, gram_hashes, repeated

WINDOW, STEP = 200, 50
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


BYTES = Kind(WINDOW, 32, bytes_of, lambda b: _BYTE[np.frombuffer(b, np.uint8)], bytes)


class Shard:
    """Passages: their suffixes in order, and for each the block before it.

    A suffix of less than a block is an end: ends come first, in order of place, and differ from all others. Only
    suffixes that lie a number of blocks behind the start of a window are kept; the others no window depends on.
    """

    def __init__(self, contents: list[bytes], first: int):
        size = np.array([len(c) + 1 for c in contents])  # the empty suffix too
        base = np.concatenate([[0], np.cumsum(size)])
        text = np.frombuffer(b"\0".join(contents) + bytes(STEP + 1), np.uint8)
        n = int(base[-1])
        of = np.repeat(np.arange(len(contents), dtype=np.int32), size)
        offset = np.arange(n, dtype=np.int32) - base[of].astype(np.int32)
        keep = offset % STEP <= (size - 1 - WINDOW)[of]
        self.raw = np.flatnonzero(keep)
        self.place = np.cumsum(keep, dtype=np.int32) - 1
        self.of, self.offset = of[keep], offset[keep]
        self.left = (size - 1)[self.of] - self.offset  # bytes up to the passage's end
        letter = gram_hashes(_BYTE[text], STEP)[:n][keep] | np.uint64(1)  # 0 stands for none
        self.sa = self._sorted(letter)
        self.of = self.of + np.int32(first)
        inside = self.offset[self.sa] >= STEP
        back = self.place[np.maximum(self.raw[self.sa] - STEP, 0)]
        self.before = np.where(inside, letter[back], np.uint64(0))
        self.ends = int((self.left < STEP).sum())

    def _sorted(self, letter: np.ndarray) -> np.ndarray:
        n, step = len(letter), STEP
        ends, rest = np.flatnonzero(self.left < STEP), np.flatnonzero(self.left >= STEP)
        rest = rest[np.argsort(letter[rest], kind="stable")]
        order = np.concatenate([ends, rest])
        split = np.ones(n, bool)
        split[len(ends) + 1 :] = np.diff(letter[rest]) != 0
        while not split.all():
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(split) - 1
            tied = ~split
            tied[:-1] |= ~split[1:]
            some = order[tied]
            after = rank[self.place[self.raw[some] + step]]  # equal blocks: so there is more behind them
            key = rank[some] * n + after
            deal = np.argsort(key, kind="stable")
            order[tied] = some[deal]
            split[tied] = np.concatenate([[True], np.diff(key[deal]) != 0])
            step *= 2
        return order


def merge(shards: list[Shard], steps: int = WINDOW // STEP) -> tuple[np.ndarray, np.ndarray]:
    """The merged order after ``steps`` refinements, as places in the shards laid end to end, and the number of the
    interval of equal prefixes at each place."""
    before = np.concatenate([s.before for s in shards])
    letters, dense = np.unique(before, return_inverse=True)
    kind = np.uint16 if len(letters) < 1 << 16 else np.uint32
    dense = (dense + (letters[0] != 0)).astype(kind)  # 0: no block before
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.before) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.ends for s in shards])
    interval = np.zeros(len(z), np.int64)
    for _ in range(steps):
        place = np.empty(len(z), np.int64)
        place[np.argsort(z, kind="stable")] = np.arange(len(z))
        read = dense[place]
        has = np.flatnonzero(read)
        read = read[has]
        if kind is np.uint16:
            deal = np.argsort(read, kind="stable")
        else:  # two passes of sixteen bits
            deal = np.argsort((read & 0xFFFF).astype(np.uint16), kind="stable")
            deal = deal[np.argsort((read[deal] >> 16).astype(np.uint16), kind="stable")]
        source = has[deal]
        new = np.concatenate([ends, z[source]])
        code, was = read[deal], interval[source]
        split = np.ones(len(new), bool)
        split[len(ends) + 1 :] = (code[1:] != code[:-1]) | (was[1:] != was[:-1])
        now = np.cumsum(split) - 1
        same = np.array_equal(new, z) and np.array_equal(now, interval)
        z, interval = new, now
        if same:
            break
    place = np.empty(len(z), np.int64)
    place[np.argsort(z, kind="stable")] = np.arange(len(z))
    return place, interval


def shared(contents: list[bytes], uids: np.ndarray, starts: np.ndarray, size: int = 200_000) -> list[np.ndarray]:
    """For each passage its windows of WINDOW bytes that are also in another passage."""
    shards, held, first, n = [], [], 0, 0
    for k, c in enumerate(contents):
        held.append(c)
        n += len(c)
        if n >= size or k == len(contents) - 1:
            shards.append(Shard(held, first))
            held, first, n = [], k + 1, 0
    place, interval = merge(shards)
    of, offset, left = (np.concatenate([getattr(s, c)[s.sa] for s in shards])[place] for c in ("of", "offset", "left"))
    whole = left >= WINDOW
    count = np.bincount(interval[whole], minlength=int(interval[-1]) + 1)
    hit = np.flatnonzero(whole & (count[interval] > 1))
    of, offset = of[hit], offset[hit]
    order = np.lexsort((offset, of))
    of, offset = of[order], offset[order]
    cuts = np.searchsorted(of, np.arange(len(contents) + 1))
    return [offset[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of bytes of each row (doc_id, text).

    Null and short texts lose nothing; rows with equal doc_id, equal or not, are documents of their own; an empty
    table gives no rows; other columns are not read.
    """
    return repeated(docs, BYTES, shared, F.col("copies") > 1, cap=1500, budget=500_000).withColumnRenamed("n_units", "n_bytes")
