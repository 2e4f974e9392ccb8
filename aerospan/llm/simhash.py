"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts.

Distinct fingerprints are cut into tiles by the population counts of their parts. Two fingerprints that differ in d
bits have part counts that differ by d at most in all, so a pair of tiles whose counts differ beyond the radius is
skipped, and no link is lost. All other pairs of tiles are compared exactly, fingerprint by fingerprint. A tile pair
emits a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import forest, slices, texts_of, written
from aerospan.llm.graph import components


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words (A-Z lower-cased); of the whole sequence if there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, n)


def bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is 1 in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((count * 2 > len(hashes)) @ (1 << np.arange(64, dtype=object)))


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` (longs), and ``fp``: a fingerprint of 64 x ``words`` bits as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for t in texts_of(batch.column("text")):
                hashes = shingle_hashes(t, width)
                out.append([x - (1 << 64) if x >> 63 else x for x in (bits(hashes if not k else shingle_hashes(t, width, 42 + k)) for k in range(words))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.list_(pa.int64()))], [*keep, "fp"])

    wanted = docs.select(*(F.col(c).cast("long").alias(c) for c in keep), F.col(text).alias("text"))
    return wanted.mapInArrow(run, ", ".join(f"{c} long" for c in keep) + ", fp array<long>")


def part_counts(fp: Column, words: int, parts: int) -> list[Column]:
    """Population counts of ``parts`` near-equal slices of the fingerprint's 64 x ``words`` bits."""
    edges = [round(k * 64 / parts) for k in range(parts + 1)]
    return [
        reduce(add, [F.bit_count(F.shiftrightunsigned(F.get(fp, F.lit(w)), a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long"))) for w in range(words)]).cast("long")
        for a, b in zip(edges, edges[1:], strict=False)
    ]


def links(reps: DataFrame, radius: int, words: int = 1, parts: int = 3, tile: int = 4096) -> DataFrame:
    """(u, v): a spanning forest, for each pair of tiles, of the links between distinct fingerprints.

    ``reps`` has rep (long) and fp, one row for each distinct fingerprint. ``tile`` bounds a tile's rows; a cell with
    more is dealt by hash into as many tiles as it needs, and every pair of them is compared.
    """
    base = 64 * words + 2 * radius + 1
    cell = lambda counts: reduce(lambda a, c: a * base + c, counts)
    counted = written(reps.withColumn("n", F.array(*part_counts(F.col("fp"), words, parts))).withColumn("cell", cell([F.get("n", F.lit(k)) for k in range(parts)])), "fingerprints")
    sizes = counted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    flat = lambda c: F.flatten(F.collect_list(c))
    dealt = counted.join(sizes, "cell").withColumn("k", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    tiles = written(dealt.groupBy("cell", "k").agg(F.first("n").alias("n"), F.collect_list("rep").alias("reps"), flat("fp").alias("fps")), "tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    moved = F.array(*(F.lit(sum(x * base ** (parts - 1 - k) for k, x in enumerate(d))) for d in steps))
    left = tiles.select("cell", "k", "reps", "fps").withColumn("near", F.explode(F.transform(moved, lambda m: m + F.col("cell")))).where("near >= cell")
    right = tiles.select(F.col("cell").alias("near"), F.col("k").alias("k2"), F.col("reps").alias("reps2"), F.col("fps").alias("fps2"))
    pairs = left.join(right, "near").where("near > cell or k2 >= k")
    pairs = pairs.repartition(F.xxhash64("cell", "k", "near", "k2")).select("reps", "fps", "reps2", "fps2")  # equal work for all tasks

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, x, b, y = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("reps", "fps", "reps2", "fps2"))
                i, j = near(x.view(np.uint64).reshape(-1, words), y.view(np.uint64).reshape(-1, words), radius)
                if len(i):
                    ids, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
                    child, root = forest(len(ids), at[: len(i)], at[len(i) :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root])], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def near(x: np.ndarray, y: np.ndarray, radius: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with at most ``radius`` differing bits between x[i] and y[j]."""
    out, step = [], max(1, block // max(1, len(y)))
    columns = [np.ascontiguousarray(y[:, w]) for w in range(y.shape[1])]
    least = np.uint8(min(radius // len(columns), 64))  # some word differs by no more than this
    for at in range(0, len(x), step):
        part = x[at : at + step]
        hit = np.bitwise_count(part[:, :1] ^ columns[0]) <= least
        for w, column in enumerate(columns[1:], 1):
            hit |= np.bitwise_count(part[:, w : w + 1] ^ column) <= least
        if hit.any():
            i, j = np.nonzero(hit)
            if len(columns) > 1:
                d = sum(np.bitwise_count(part[i, w] ^ c[j]).astype(np.int16) for w, c in enumerate(columns))
                i, j = i[d <= radius], j[d <= radius]
            out.append((i + at, j))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def grouped(fps: DataFrame, radius: int, words: int = 1, parts: int = 3, tile: int = 4096, node: str = "doc_id") -> DataFrame:
    """``fps`` (node, fp) with component_id, the smallest node reachable by links."""
    fps = written(fps, "documents-fp")
    reps = fps.groupBy("fp").agg(F.min(node).alias("rep"))
    found = components(links(reps.where("rep is not null"), radius, words, parts, tile))
    named = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document; others linked share a component.

    Null text counts as empty; a text without words has fingerprint zero, linked as any other; short texts are one
    shingle; repeated rows and rows with equal fingerprints are one node and come back each; a row without doc_id
    has the component of the documents with its fingerprint (null if there are none); other columns are not read.
    """
    out = grouped(fingerprints(docs, width), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")
