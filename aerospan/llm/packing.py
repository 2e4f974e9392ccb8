"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token shares.

Each source is a queue of its documents' ids. Round-robin gives a queue, for every window, its quantum (share x window
length) plus the deficit it carries over; what is due in whole ids is taken, the rest is carried on. Documents may
be cut anywhere, so a queue's deficit stays below one id at every turn, and turns have a closed form: id x of a queue of
share s is due at time (x + 1) / s, and ids go in order of when they are due, ties in order of the queues. A queue that
has run dry owes nothing, so the others share its quantum without any further rule. What a queue has given after g ids
follows from the one time that g ids are due by. That makes the scheme parallel: a document's pieces follow from its
place in its queue alone, and deficits carry across windows and partitions without any order of execution.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospan.llm.common import in_order, slices, texts_of, written
from aerospan.llm.tokens import encoder

#: Rows (a few dozen bytes each) of the table of queue places up to which it is broadcast; beyond, it is joined.
MOST_PLACES = 100_000
#: Sources without given weights up to which queues take turns one by one; beyond, by halves.
MOST_SOURCES = 10_000
#: Numbers (windows x queues) that are worked out at once.
AT_ONCE = 1 << 20


class Schedule:
    """Where the ids of each queue go. ``totals``: ids by queue; ``weights``: target shares (default: the totals).

    A queue of weight zero comes after the others. Work grows with windows x queues.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, length: int = 1024):
        self.totals, self.length, self.total = np.array(totals, np.int64), length, int(sum(totals))
        w = np.array(totals if weights is None else weights, float)
        if (w < 0).any() or not np.isfinite(w).all():
            raise ValueError("weights must be finite and not below zero")
        least = w[w > 0].min(initial=np.inf)
        w = np.where(w > 0, w, 1e-9 * least if np.isfinite(least) else 1.0)
        self.share = w / max(w.sum(), 1e-300)
        self.windows = -(-self.total // length)
        dry = self.totals / self.share  # when each queue runs dry, and what all have given by then
        order = np.argsort(dry, kind="stable")
        self.dry = np.concatenate([[0.0], dry[order]])
        open_share = np.maximum(0, 1 - np.concatenate([[0.0], np.cumsum(self.share[order])]))[:-1]
        self.by_dry = np.concatenate([[0.0], np.cumsum(np.diff(self.dry) * open_share)])
        self.end = float(self.dry[-1]) * (1 + 1e-9) + 2 / float(self.share.min(initial=1.0))

    def _due(self, time: np.ndarray) -> np.ndarray:
        """Ids of each queue that are due by each time: (times, queues)."""
        return np.minimum(self.totals, np.floor(time[:, None] * self.share)).astype(np.int64)

    def given(self, g: np.ndarray) -> np.ndarray:
        """Ids that each queue has given of the first g: (numbers, queues)."""
        g = np.minimum(np.asarray(g, np.int64), self.total)
        step = max(1, AT_ONCE // max(1, len(self.totals)))
        return np.concatenate([self._given(g[at : at + step]) for at in range(0, len(g), step)] or [np.zeros((0, len(self.totals)), np.int64)])

    def _given(self, g: np.ndarray) -> np.ndarray:
        slack = len(self.totals) + 2
        low = np.interp(g - slack, self.by_dry, self.dry) * (1 - 1e-9)
        low[self._due(low).sum(axis=1) > g] = 0.0
        high = np.interp(g + slack, self.by_dry, self.dry) * (1 + 1e-9) + 1e-9
        high[self._due(high).sum(axis=1) <= g] = self.end
        while True:  # the last time by which no more than g ids are due, to the last bit
            mid = low + (high - low) / 2
            if ((mid <= low) | (mid >= high)).all():
                break
            few = self._due(mid).sum(axis=1) <= g
            low, high = np.where(few, np.maximum(low, mid), low), np.where(few, high, np.minimum(high, mid))
        sure = self._due(low)
        tied = self._due(high) - sure
        before = np.cumsum(tied, axis=1) - tied
        out = sure + np.clip((g - sure.sum(axis=1))[:, None] - before, 0, tied)
        return np.where((g >= self.total)[:, None], self.totals, out)

    def pieces(self, k: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of documents with ``n`` ids from place ``x`` of queue ``k``: document, first id in it, ids, sequence, place there."""
        rim = self.share[k]
        near = lambda ids: np.interp(ids / rim, self.dry, self.by_dry)
        margin = len(self.totals) + 2
        first = np.maximum(0, (near(x) - margin) // self.length).astype(np.int64)
        last = np.minimum(self.windows - 1, (near(x + n) + margin) // self.length).astype(np.int64)
        out, at, most = [], 0, max(2, 4 * AT_ONCE // max(1, len(self.totals)))
        order = np.argsort(first, kind="stable")
        while at < len(order):  # documents of neighbouring windows share what is worked out
            mine = order[at : at + max(1, int(np.searchsorted(np.cumsum((last - first + 2)[order[at:]]), most)))]
            out.append(self._pieces(mine, k, x, n, first, last))
            at += len(mine)
        doc, start, size, seq, place = (np.concatenate(c) for c in zip(*out, strict=True))
        back = np.lexsort((start, doc))
        return doc[back], start[back], size[back], seq[back], place[back]

    def _pieces(self, docs, k, x, n, first, last) -> tuple[np.ndarray, ...]:
        spans = last[docs] - first[docs] + 1
        doc = np.repeat(docs, spans)
        window = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans) + first[doc]
        needed = np.unique(np.concatenate([window, window + 1]))
        gave = self.given(needed * self.length)
        upto = np.cumsum(gave, axis=1)
        a, b, q = np.searchsorted(needed, window), np.searchsorted(needed, window + 1), k[doc]
        low, high = np.maximum(gave[a, q], x[doc]), np.minimum(gave[b, q], x[doc] + n[doc])
        place = (upto[b, q] - gave[b, q]) - (upto[a, q] - gave[a, q]) + low - gave[a, q]
        some = high > low
        doc, low, size, window, place = doc[some], low[some], (high - low)[some], window[some], place[some]
        return self._tail(doc, low - x[doc], size, window, place)

    def _tail(self, doc, start, size, window, place) -> tuple[np.ndarray, ...]:
        """The last window is cut into sequences of powers of two, which need no padding."""
        rest = self.total % self.length
        at = np.flatnonzero(window == self.windows - 1) if rest else []
        if not len(at):
            return doc, start, size, window, place
        cut = []
        for i in at:
            left, seq = 0, self.windows - 1
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    low, high = max(int(place[i]), left), min(int(place[i] + size[i]), left + (1 << bit))
                    if low < high:
                        cut.append((doc[i], start[i] + low - place[i], high - low, seq, low - left))
                    left, seq = left + (1 << bit), seq + 1
        others = np.ones(len(doc), bool)
        others[at] = False
        return tuple(np.concatenate([c[others], np.array(new, np.int64)]) for c, new in zip((doc, start, size, window, place), zip(*cut, strict=True), strict=True))


class Halves(Schedule):
    """The schedule of many queues at their own shares: ids are split between halves of the queues, and so on down to one, so
    a queue's share takes as many steps as their number has bits. Each split is off by less than one id, so a queue is by less than the number of splits above it."""

    def __init__(self, totals: np.ndarray, length: int = 1024):
        self.cum, self.length = np.concatenate([[0], np.cumsum(totals, dtype=np.int64)]), length
        self.total = int(self.cum[-1])
        self.windows = -(-self.total // length)
        self.kind = np.int64 if self.total < 3_000_000_000 else object

    def _two(self, k: int, g):
        """Ids that the queues before ``k``, and those up to it, have given of the first g (an integer or an array)."""
        x = np.minimum(g.astype(self.kind), self.total) if isinstance(g, np.ndarray) else min(g, self.total)
        low, high, before = 0, len(self.cum) - 1, x * 0
        while high - low > 1:
            mid = (low + high) // 2
            a, b, c = (int(self.cum[j]) for j in (low, mid, high))
            left = x * (b - a) // max(1, c - a)
            if k < mid:
                high, x = mid, left
            else:
                low, before, x = mid, before + left, x - left
        return before, before + x

    def given_by(self, k: int, g):
        low, high = self._two(k, g)
        return high - low

    def window_of(self, k: int, x: int) -> int:
        """The window that id ``x`` of queue ``k`` is in."""
        w = min(self.windows - 1, x * self.total // max(1, int(self.cum[k + 1] - self.cum[k])) // self.length)
        while True:
            if self.given_by(k, w * self.length) > x:
                w -= 1
            elif self.given_by(k, (w + 1) * self.length) <= x:
                w += 1
            else:
                return w

    def pieces(self, k: np.ndarray, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for doc, (q, at, size) in enumerate(zip(k.tolist(), x.tolist(), n.tolist(), strict=True)):
            w = np.arange(self.window_of(q, at), self.window_of(q, at + size - 1) + 2)
            left, right = self._two(q, w * self.length)
            edge = (right - left).astype(np.int64)
            low, high = np.maximum(edge[:-1], at), np.minimum(edge[1:], at + size)
            some = high > low
            place = (left[1:] - left[:-1]).astype(np.int64) + low - edge[:-1]
            out.append(self._tail(np.full(int(some.sum()), doc), (low - at)[some], (high - low)[some], w[:-1][some], place[some]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def numbered(totals: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Sources with their place by name (source, k), written, and their totals in that order."""
    rows = written(in_order(totals.select("source", "n"), ["source"]), "sources")
    counts = rows.groupBy("_part").count().collect()  # a row for each partition
    base, at = [], 0
    for part, n in sorted((r[0], r[1]) for r in counts):
        base.append((part, at))
        at += n
    first = totals.sparkSession.createDataFrame(base, "_part int, base long")
    out = written(rows.join(F.broadcast(first), "_part").select("source", "n", (F.col("base") + F.col("_row")).alias("k")), "sources")
    return out.select("source", "k"), out.orderBy("k").select("n").toArrow().column("n").to_numpy()


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0, source: str = "source") -> DataFrame:
    """Each row's ids, its source, and its place among the rows of its source in its input partition; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in slices(batches):
            coded = [x + end for x in enc.encode(texts_of(batch.column("text")))]
            n = [len(x) // enc.dtype.itemsize for x in coded]
            starts = []
            for s, k in zip(batch.column("source").to_pylist(), n, strict=True):
                starts.append(at.get(s, 0))
                at[s] = starts[-1] + k
            width = pa.array([enc.dtype.itemsize] * len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), width, pa.array(coded, pa.binary())], ["doc_id", "source", "part", "part_start", "n", "width", "ids"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col(source), F.lit("")).alias("source"))
    return written(wanted.mapInArrow(run, "doc_id long, source string, part int, part_start long, n long, width int, ids binary"), "packed-ids")


def pack(docs: DataFrame, tokenizer: str, weights: dict[str, float] | None = None, length: int = 1024, end_id: int = 0, power: float = 1.0) -> DataFrame:
    """Pack all ``docs`` (doc_id, text, source) into sequences of at most ``length`` ids; one row for each piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, pad_to. Target shares of the
    sources come from ``weights`` (a source that is not named there comes after the others), by default from their ids to
    the power of ``power``: at 1 all queues end together; below it small sources weigh more in a window until they run
    dry. Every id lies in one piece. Sequences are full but for the tail, whose sequences are powers of two. The text is
    never shuffled: ids are written once where they are made, and queues' places follow from a table with one row for
    each source and partition. Null text is an empty document, null source the source ''; equal rows are packed
    one by one; an empty table gives no rows; other columns are not read.
    """
    ids = encoded(docs, tokenizer, end_id)
    sums = written(ids.groupBy("source", "part").agg(F.sum("n").alias("n")), "queues")
    queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "part", F.coalesce(F.sum("n").over(queue), F.lit(0)).alias("base"))
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    found, names = totals.orderBy("source").limit(MOST_SOURCES + 1).collect(), {}
    many = len(found) > MOST_SOURCES and weights is None and power == 1
    if many:
        places, counts = numbered(totals)
        plan, bases = Halves(counts, length), bases.join(places, "source")
    else:
        found = totals.orderBy("source").collect() if len(found) > MOST_SOURCES else found
        names = {r.source: k for k, r in enumerate(found)}
        plan = Schedule([r.n for r in found], [weights.get(r.source, 0.0) if weights is not None else float(r.n) ** power for r in found], length)
    numbers = ["k"] if many else []
    shared = docs.sparkSession.sparkContext.broadcast((plan, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            plan, names = shared.value
            at_k = batch.column("k").to_pylist() if numbers else [names[s] for s in batch.column("source").to_pylist()]
            x = np.array(batch.column("base")) + np.array(batch.column("part_start"))
            n = np.array(batch.column("n"))
            doc, start, size, seq, place = plan.pieces(np.array(at_k, np.int64), x, n)
            raw = b"".join(np.frombuffer(r, f"<u{w}").astype("<u4").tobytes() for r, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True))
            low = 4 * ((np.cumsum(n) - n)[doc] + start)
            view, crc = memoryview(raw), zlib.crc32
            crcs = [crc(view[a:b]) for a, b in zip(low.tolist(), (low + 4 * size).tolist(), strict=True)]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(start), pa.array(size), pa.array(crcs, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(place), batch.column("source").take(at)], PIECE)

    small = sums.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    placed = ids.join(F.broadcast(bases) if small else bases, ["source", "part"]).select("doc_id", "source", "base", "part_start", "n", "width", "ids", *numbers)
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
