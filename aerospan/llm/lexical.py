"""Ranked lexical search of many queries at once, with what they share worked out once.

Queries (items) are dealt into blocks of a bounded number of terms. For each block a plan is mined: terms that occur in the same
items become one class, items become sequences of classes (most shared first), and pairs of neighbours that more than one item
holds become nodes of their own, round by round, until no pair is shared. The nodes are a graph over which every batch of
documents adds up partial scores: a class once from the documents' terms, a pair once from its two parts, and each item from the
few nodes left in its sequence. Scores are whole numbers, so the order of additions doesn't matter.

Texts are read once a block, into the counts of the block's terms; document frequencies and totals come from that table; tasks
keep the best ``k`` documents of each item, and only those are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospan.llm.common import in_order, slices, written

#: Terms (with repeats over items) of the items that are answered together: the size of what is broadcast. One item may have more.
BLOCK = 100_000
#: Partial scores that a task holds at once.
CELLS = 1 << 21
#: Bytes of a text that are split at once.
CHUNK = 1 << 20

_LETTERS = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _LETTERS else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, in parts: runs of ASCII letters (in lower case), digits and any other characters beyond ASCII."""
    at = 0
    while at < len(text):
        parts = [text[at : at + CHUNK].translate(_TABLE)]
        at += CHUNK
        while at < len(text) and text[at] in _LETTERS:  # the last term goes on
            more = text[at : at + CHUNK].translate(_TABLE)
            stop = more.find(b" ")
            parts.append(more if stop < 0 else more[:stop])
            at += len(parts[-1])
        yield b"".join(parts).split()


def items_of(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """item, item_id, terms (distinct), block: every row of ``items`` with a number in the order of (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted({t for part in terms(x or b"") for t in part}) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("hash"), pa.array(found, pa.list_(pa.binary()))], ["item_id", "hash", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("hash"), "text")
    rows = written(in_order(rows.mapInArrow(run, "item_id long, hash long, terms array<binary>"), ["item_id", "hash"]), "lexical-items")
    sizes = rows.groupBy("_part").agg(F.sum(F.size("terms")).alias("n"))
    base = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("base"))  # one row a partition
    here = F.sum(F.size("terms")).over(Window.partitionBy("_part").orderBy("_row")) - F.size("terms")
    number = F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_row")
    return rows.withColumn("here", here).join(base, "_part").select(number.alias("item"), "item_id", "terms", F.floor((F.col("base") + F.col("here")) / block).alias("block"))


class Plan:
    """The graph of shared sums of a block of items.

    ``vocabulary`` lists the terms and ``class_of`` their classes; ``rounds`` are (first, left, right) arrays: node first + k is the
    sum of nodes left[k] and right[k]; item i is the sum of ``nodes[ends[i]:ends[i + 1]]``.
    """

    def __init__(self, items: list[list[bytes]]):
        holders: dict[bytes, list[int]] = {}
        for k, row in enumerate(items):
            for t in row:
                holders.setdefault(t, []).append(k)
        sets = Counter(map(tuple, holders.values()))
        order = sorted(sets, key=lambda s: (-len(s), s))  # classes that most items hold come first
        number = {s: c for c, s in enumerate(order)}
        self.vocabulary = sorted(holders)
        self.class_of = np.array([number[tuple(holders[t])] for t in self.vocabulary], np.int64)
        self.classes = self.size = len(order)
        rows: list[list[int]] = [[] for _ in items]
        for c, s in enumerate(order):
            for k in s:
                rows[k].append(c)
        self.rounds: list[tuple[int, np.ndarray, np.ndarray]] = []
        while True:
            pairs = Counter(p for row in rows for p in zip(row, row[1:], strict=False))
            shared = {p for p, n in pairs.items() if n > 1}
            new: dict[tuple[int, int], int] = {}
            taken: list[list] = []
            used: Counter = Counter()
            for row in rows:  # the more shared of two overlapping pairs wins
                out, k = [], 0
                while k < len(row):
                    pair = tuple(row[k : k + 2])
                    if pair in shared and pairs[pair] >= pairs.get(tuple(row[k + 1 : k + 3]), 0):
                        out.append(pair)
                        used[pair] += 1
                        k += 2
                    else:
                        out.append(row[k])
                        k += 1
                taken.append(out)
            for pair, n in sorted(used.items()):
                if n > 1:
                    new[pair] = self.size + len(new)
            if not new:
                break
            rows = [[x for y in row for x in ((new[y],) if y in new else y if isinstance(y, tuple) else (y,))] for row in taken]
            left, right = (np.array(x, np.int64) for x in zip(*new, strict=True))
            self.rounds.append((self.size, left, right))
            self.size += len(new)
        self.nodes = np.array([x for row in rows for x in row], np.int64)
        self.ends = np.cumsum([0, *map(len, rows)])

    def additions(self) -> int:
        """Sums a document costs beyond adding up its classes."""
        return self.size - self.classes + len(self.nodes)

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """Scores (items x documents) from the sums of the classes (classes x documents)."""
        acc = np.empty((self.size, classes.shape[1]), np.int64)
        acc[: self.classes] = classes
        for first, left, right in self.rounds:
            acc[first : first + len(left)] = acc[left] + acc[right]
        out = np.zeros((len(self.ends) - 1, classes.shape[1]), np.int64)
        full = np.flatnonzero(np.diff(self.ends))
        if len(full):
            out[full] = np.add.reduceat(acc[self.nodes], self.ends[full], axis=0)
        return out


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text) and, of the vocabulary, term numbers and how often each occurs; documents without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}.get
        for batch in slices(batches):
            keep, sizes, found, often, ends = [], [], [], [], [0]
            for at, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                n, tally = 0, Counter()
                for part in terms(text or b""):
                    n += len(part)
                    tally.update(map(number, part))
                if n:
                    tally.pop(None, None)
                    keep.append(at)
                    sizes.append(n)
                    found.extend(tally)
                    often.extend(tally.values())
                    ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Best:
    """The best ``k`` documents of each item: higher scores first, equal ones by doc_id, null first."""

    def __init__(self, items: int, k: int):
        self.k, self.score = k, np.zeros((items, 0), np.int64)
        self.doc, self.known = np.zeros((items, 0), np.int64), np.zeros((items, 0), bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        least = np.maximum(self.score[:, -1], 1) if self.score.shape[1] == self.k else np.ones(len(scores), np.int64)
        cols = np.flatnonzero((scores >= least[:, None]).any(axis=0))
        if len(cols):
            wide = lambda x: np.broadcast_to(x[cols], (len(scores), len(cols)))
            score, doc, ok = np.hstack([self.score, scores[:, cols]]), np.hstack([self.doc, wide(docs)]), np.hstack([self.known, wide(known)])
            order = np.lexsort((doc, ok, -score))[:, : self.k]
            self.score, self.doc, self.known = (np.take_along_axis(x, order, axis=1) for x in (score, doc, ok))


def ranked(counts: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """at (place of the item in the block), doc_id, score: the best ``k`` of each task, and the task's number modulo 64."""
    step = max(16, CELLS // max(1, plan.size + len(plan.ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = Best(len(plan.ends) - 1, k)
        for batch in slices(batches, step, 1 << 24):
            rows, n = batch.num_rows, batch.column("n").to_pylist()
            length = np.array([10 + 90 * x * n_docs // n_terms for x in n], np.int64)
            terms, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy()
            who, what = np.repeat(np.arange(rows), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy()
            part = weights[what] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length[who]))
            classes = np.zeros((plan.classes, rows), np.int64)
            np.add.at(classes, (plan.class_of[what], who), part)
            ids = batch.column("doc_id")
            best.add(plan.scores(classes), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        at, col = np.nonzero(best.score > 0)
        docs = pa.array(best.doc[at, col], pa.int64(), mask=~best.known[at, col])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), docs, pa.array(best.score[at, col]), pa.array(np.full(len(at), TaskContext.get().partitionId() % 64, np.int32))], ["at", "doc_id", "score", "task"])

    return counts.mapInArrow(run, "at long, doc_id long, score long, task int")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    Every row of ``items`` is a query, also one whose item_id is null or repeated; one without a term known to a document gets no rows. Every row of
    ``docs`` is a document, also a repeated one; null and empty texts have no terms and count nowhere; equal scores are ordered by doc_id, null
    first. Empty tables give no rows. Only item_id, doc_id and text are read. The driver holds the terms of one block of items at a time.
    """
    spark = docs.sparkSession
    asked = written(items_of(items, block), "lexical-blocks")
    blocks = [r.block for r in asked.groupBy("block").agg(F.sum(F.size("terms")).alias("n")).where("n > 0").orderBy("block").collect()]  # one row a block
    outs = []
    for number in blocks:
        rows = asked.where((F.col("block") == number) & (F.size("terms") > 0)).select("item", "item_id", "terms").toPandas().sort_values("item", ignore_index=True)
        plan = Plan([[bytes(t) for t in x] for x in rows["terms"]])
        counts = written(counted(docs, plan.vocabulary), "lexical-counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(plan.vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's vocabulary
            df[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_first()]
        best = ranked(counts, plan, weights, n_docs, n_terms, k)
        for keys in (["at", "task"], ["at"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(rows)), "item_id": rows["item_id"].astype("Int64")}), "at long, item_id long")
        outs.append(written(best.join(F.broadcast(names), "at").select("item_id", "rank", "doc_id", "score"), "lexical-best"))
    if not outs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = outs[0]
    for more in outs[1:]:
        out = out.unionByName(more)
    return out
