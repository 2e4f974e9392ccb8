"""What the two exact repeated-passage operators share: how equal windows meet without comparing all documents.

A window is ``window`` consecutive units (bytes or words) of one document. Its anchor is the least of the hashes of
its runs of ``gram`` units, leftmost first; equal windows have equal anchors. Neighbouring windows that share the
place of their anchor form a passage, so a document of n units has about 2 n / (window - gram) passages. An anchor
that occurs once in the corpus cannot hold a repeated window: such passages are done. The others are cut out of their
documents, equal ones are merged (by a 128-bit digest, before the shuffle), and the different ones of an anchor meet
in a tile, where an index decides exactly which of their windows repeat. An anchor with more passages than ``cap`` is
dealt into as many tiles as its pairs of parts need. Nothing is dropped: every pair of equal windows either lies in
equal passages or meets in a tile.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import discard, mixed, numbered_rows, slices, written

#: Places are kept in the low bits of hashes while the least is sought; longer inputs are cut with an overlap.
PLACE = np.uint64((1 << 24) - 1)
LONGEST = 1 << 22
#: Documents with repeated anchors up to which their ids (8 bytes each) are broadcast to leave others out of a shuffle.
MOST_UIDS = 2_000_000


def gram_hashes(unit: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` units, from hashes of the units, by doubling."""
    size, done, out, part = 1, 0, None, unit
    c = 0x9FB21C651E98DF25
    left = gram
    while left:
        if left & 1:
            out = part[done:] if out is None else out[: len(part) - done] * np.uint64(c) + part[done:]
            done += size
        left >>= 1
        if left:
            part = part[: max(0, len(part) - size)] * np.uint64(c) + part[size:]
            c = (c * c + 2) % (1 << 64)
            size *= 2
    return mixed(out[: max(0, len(unit) - gram + 1)])


def anchors(units: list[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages of each list of unit hashes: index of the list, anchor, first window, number of windows."""
    out, group, size = [], [], 0
    for k, u in enumerate(units):
        for at in range(0, max(1, len(u) - window + 1), LONGEST):
            piece = u[at : at + LONGEST + window - 1]
            if size + len(piece) > LONGEST and group:
                out.append(_anchors(group, window, gram))
                group, size = [], 0
            group.append((k, at, piece))
            size += len(piece)
    out.append(_anchors(group, window, gram))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors(group: list, window: int, gram: int) -> tuple[np.ndarray, ...]:
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    if not group:
        return none
    unit = np.concatenate([p for _, _, p in group]).astype(np.uint64)
    if len(unit) < window:
        return none
    size = np.array([len(p) for _, _, p in group])
    base = np.concatenate([[0], np.cumsum(size)])
    h = gram_hashes(unit, gram)
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    span, step = window - gram + 1, 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    end = np.repeat(base[1:], size)
    at = np.flatnonzero(np.arange(len(least)) + window <= end[: len(least)])
    if not len(at):
        return none
    place = (least[at] & PLACE).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(at) > 1)])
    first = at[new]
    n = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
    piece = np.searchsorted(base, first, side="right") - 1
    lists, offsets = np.array([k for k, _, _ in group]), np.array([a for _, a, _ in group])
    return lists[piece], h[place[new]], first - base[piece] + offsets[piece], n


@dataclass
class Kind:
    """How texts become units. ``units``: text -> items; ``hashes``: items -> unit hashes; ``join``: items -> bytes."""

    window: int
    gram: int
    units: Callable
    hashes: Callable
    join: Callable


def removed(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n units the spans (first, end) cover."""
    edge = np.zeros(n + 1, np.int32)
    a, b = np.array(spans, np.int64).reshape(-1, 2).T
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    return np.cumsum(edge)[:n] > 0


def sieve(docs: DataFrame, kind: Kind) -> DataFrame:
    """uid, n_units, whole_sha256 and the passages (keys, starts, ns) of each text; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64, 1 << 20):
            items = [kind.units(t or "") for t in batch.column("text").to_pylist()]
            of, key, first, n = anchors([kind.hashes(x) for x in items], kind.window, kind.gram)
            cut = np.searchsorted(of, np.arange(len(items) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (key.view(np.int64), first.astype(np.int32), n.astype(np.int32))]
            sha = [hashlib.sha256(kind.join(x)).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array([len(x) for x in items], pa.int64()), pa.array(sha), *lists], ["uid", "n_units", "whole_sha256", "keys", "starts", "ns"])

    schema = "uid long, n_units long, whole_sha256 string, keys array<long>, starts array<int>, ns array<int>"
    return written(docs.select("uid", "text").mapInArrow(run, schema), "passages")


def digests(found: DataFrame, kind: Kind) -> DataFrame:
    """(uid, text, runs) -> one row for each passage: key, digest of its content, uid, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64, 1 << 20):
            out = []
            for uid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "runs")), strict=True):
                items = kind.units(text or "")
                out += [(r["key"], xxhash.xxh3_128_digest(kind.join(items[r["s"] : r["s"] + r["n"] + kind.window - 1])), uid, r["s"], r["n"]) for r in runs]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "digest", "uid", "start", "n"])

    return found.mapInArrow(run, "key long, digest binary, uid long, start int, n int")


def contents(wanted: DataFrame, kind: Kind) -> DataFrame:
    """(uid, text, wanted passages) -> key, digest, content, uid, start, k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "digest", "content", "uid", "start", "k"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        for batch in slices(batches, 64, 1 << 20):
            for uid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "wanted")), strict=True):
                items = kind.units(text or "")
                for at in range(0, len(runs), 4096):
                    out = [(r["key"], r["digest"], kind.join(items[r["start"] : r["start"] + r["n"] + kind.window - 1]), uid, r["start"], r["k"]) for r in runs[at : at + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return wanted.mapInArrow(run, "key long, digest binary, content binary, uid long, start int, k long")


#: Decides within tiles: contents, and where each first occurs (uid, start) -> for each content its windows that repeat.
Index = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


def tiled(met: DataFrame, index: Index, budget: int) -> DataFrame:
    """Stream tiles (key, a, b) of sorted rows to the index, several at once up to ``budget`` bytes: digest, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = {}, 0, None  # a passage that is in several tiles is indexed once

        def decide() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                rows = list(held.values())
                hits = index([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
                out = [(d, list(zip(*runs_of(h), strict=True))) for d, h in zip(held, hits, strict=True) if len(h)]
                if out:
                    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                    spans = [[{"a": int(a), "b": int(b)} for a, b in s] for _, s in out]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array(spans, kind)], ["digest", "spans"])

        for batch in batches:
            for key, a, b, digest, content, uid, start in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "digest", "content", "uid", "start")), strict=True):
                if (key, a, b) != at:
                    if size > budget:
                        yield from decide()
                        held.clear()
                        size = 0
                    at = (key, a, b)
                if digest not in held:
                    held[digest] = (content, uid, start)
                    size += len(content)
        yield from decide()

    return met.mapInArrow(run, "digest binary, spans array<struct<a:int,b:int>>")


def runs_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as runs (first, end)."""
    gap = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + 1


def repeated(docs: DataFrame, kind: Kind, index: Index, all_of_first: Column, cap: int = 4000, budget: int = 1_500_000, uid: str | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): uid, doc_id, n_units, n_removed, n_spans, kept_sha256 and removed (the runs of
    removed units).

    ``all_of_first``: of a passage's first occurrence, whether all windows count as repeats, over the columns
    ``copies`` (occurrences of the equal passage) and ``is_first``. Rows are told apart by uid (see ``numbered_rows``).
    """
    docs = numbered_rows(docs, uid)
    by_row = isinstance(docs.schema["uid"].metadata.get("by_row"), bool)
    known = sieve(docs, kind)
    runs = known.select("uid", F.explode(F.arrays_zip("keys", "starts", "ns")).alias("r")).select("uid", F.col("r.keys").alias("key"), F.col("r.starts").alias("s"), F.col("r.ns").alias("n"))
    mine = written(of_repeated(runs).groupBy("uid").agg(F.collect_list(F.struct("key", "s", "n")).alias("runs")), "runs")
    text = docs.select("uid", "text")
    if mine.limit(MOST_UIDS + 1).count() <= MOST_UIDS:  # then other texts need not be dealt
        text = text.join(F.broadcast(mine.select("uid")), "uid", "left_semi")
    found = written(text.join(mine, "uid"), "candidates")
    discard(mine)
    parts = written(digests(found, kind), "occurrences")
    found = found.select("uid", "text")
    merged = parts.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("uid", "start", "n")).alias("first"))
    merged = written(merged, "merged")
    many = merged.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / cap).alias("k"))
    wanted = merged.join(many, "key").groupBy(F.col("first.uid").alias("uid")).agg(F.collect_list(F.struct("key", "digest", F.col("first.start").alias("start"), F.col("first.n").alias("n"), "k")).alias("wanted"))
    part = F.pmod(F.xxhash64("digest"), F.col("k"))
    met = contents(found.join(wanted, "uid"), kind).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).where("k = 1 or part <> other")
    met = met.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "digest", "content", "uid", "start")
    met = met.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "digest")
    spans = tiled(met, index, budget).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    facts = written(merged.select("digest", "copies", "first").join(spans, "digest", "left"), "facts")
    discard(merged)
    placed = parts.select("digest", "uid", "start", "n").join(facts, "digest").withColumn("is_first", (F.col("uid") == F.col("first.uid")) & (F.col("start") == F.col("first.start")))
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    hits = placed.select("uid", "start", F.explode(F.when(all_of_first, every).otherwise(F.col("spans"))).alias("w")).select("uid", F.struct((F.col("start") + F.col("w.a")).alias("a"), (F.col("start") + F.col("w.b") + kind.window - 1).alias("b")).alias("w"))
    spans_of = written(hits.groupBy("uid").agg(F.collect_list("w").alias("spans")), "removed")
    discard(parts, facts)
    changed = strip(found.join(spans_of, "uid"), kind)
    base = known.select("uid", "n_units", "whole_sha256")
    base = base.join(docs.select("uid", "doc_id"), "uid") if by_row else base.withColumn("doc_id", F.col("uid"))
    out = base.join(changed, "uid", "left")
    return out.select("uid", "doc_id", "n_units", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "removed")


def of_repeated(runs: DataFrame, hot: int = 1000, salts: int = 64) -> DataFrame:
    """Rows of (uid, key, ...) whose key occurs twice or more. A key with over one in ``hot`` of these rows (so there are fewer than
    ``hot`` such keys) is dealt by document to ``salts`` tasks."""
    twice = written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "anchors")
    much = F.lit((twice.agg(F.sum("c")).first()[0] or 0) / hot)
    salted = runs.join(F.broadcast(twice.where(F.col("c") > much).select("key", F.lit(salts).alias("salts"))), "key", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    each = twice.select("key", F.explode(F.sequence(F.lit(0), F.when(F.col("c") > much, salts - 1).otherwise(0))).alias("salt"))
    return salted.join(each, ["key", "salt"], "left_semi").drop("salt")


def strip(rows: DataFrame, kind: Kind) -> DataFrame:
    """(uid, text, spans) -> n_removed, n_spans, kept_sha256 and the removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64, 1 << 20):
            out = []
            for uid, text, spans in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "spans")), strict=True):
                items = kind.units(text or "")
                gone = removed(len(items), [(s["a"], s["b"]) for s in spans])
                first, end = runs_of(np.flatnonzero(gone)) if gone.any() else (np.zeros(0, int), np.zeros(0, int))
                kept = keep(items, first, end)
                out.append((uid, int(gone.sum()), len(first), hashlib.sha256(kind.join(kept)).hexdigest(), [{"a": int(a), "b": int(b)} for a, b in zip(first, end, strict=True)]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["uid", "n_removed", "n_spans", "kept_sha256", "removed"])

    return rows.mapInArrow(run, "uid long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:int,b:int>>")


def keep(items, first, end):
    """What is left of a sequence without the runs (first, end)."""
    out, at = items[:0], 0
    for a, b in zip(first, end, strict=True):
        out += items[at:a]
        at = b
    return out + items[at:]
