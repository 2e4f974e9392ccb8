"""Near copies of texts: SimHash candidates by tiled exact comparison, then the similarity of the shingle sets themselves.

Texts with the same set of shingles are one node. Fingerprints within a radius that holds 99.8 percent of the pairs at
the threshold (and all but all above it) name rough groups; only members of rough groups have their shingles
read again. A rough group is dealt into blocks of bounded size. Each block is compared within itself and with the
group's first member, and what that leaves apart is compared with all other blocks, so every candidate pair is either
verified or already joined by verified links. Blocks emit labels, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.llm.common import mixed, slices, texts_of, written
from aerospan.llm.graph import components
from aerospan.llm.simhash import bits, links, near, shingle_hashes


def radius_of(similarity: float, words: int) -> int:
    """Bits, of 64 x ``words``, by which two sets of that similarity differ, plus three standard deviations.

    Equal set sizes are the worst case: their cosine is 2s / (1 + s), and a bit differs with probability angle / pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * words * p + 3 * math.sqrt(64 * words * p * (1 - p)))


def sketches(docs: DataFrame, width: int, words: int, node: str) -> DataFrame:
    """node, fp (``words`` longs), digest (two longs) of the set of shingles, and its size ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps, digests, sizes = [], [], []
            for t in texts_of(batch.column("text")):
                h = shingle_hashes(t, width)
                fps.append(np.array([bits(h if not k else mixed(h ^ np.uint64(k))) for k in range(words)], np.uint64).view(np.int64))
                unique = np.unique(h)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(unique.tobytes()), np.int64))
                sizes.append(len(unique))
            yield pa.RecordBatch.from_arrays([batch.column(node), pa.array(fps, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], [node, "fp", "digest", "n"])

    return docs.select(node, "text").mapInArrow(run, f"{node} long, fp array<long>, digest array<long>, n long")


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets share at least ``least`` of their union."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= least * (len(a) + len(b) - both)


def join_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> list[tuple[int, int]]:
    """Lowers ``label`` in place over the verified links between members ``left`` and ``right``; the pairs of labels joined."""
    out = []
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        i, j = near(fps[rows], fps[right], radius)
        for k in np.unique(i):
            a, others = rows[k], right[j[i == k]]
            others = others[label[others] != label[a]]
            while len(others):
                b, others = others[0], others[1:]
                if similar(sets[a], sets[b], least):
                    low, high = sorted((int(label[a]), int(label[b])))
                    label[label == high] = low
                    out.append((low, high))
                    others = others[label[others] != label[a]]
    return out


def members_of(group: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """rep, fp and sets of a group's rows, as arrays."""
    fps = group.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
    return group.column("rep").to_numpy(), fps, sets


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 3, node: str = "doc_id", tile: int = 8192, block: int = 1 << 18) -> DataFrame:
    """``node`` and component_id, the smallest node reachable by links, of each row of ``docs`` (node, text).

    Rows link if the sets of their ``width``-word shingles (A-Z lower-cased; of shorter texts the whole sequence) have at
    least ``similarity`` of their union in common and their fingerprints lie within :func:`radius_of` it. Null and empty
    texts, and texts without words, have the empty set and are copies of each other only. Nodes must be distinct longs;
    repeated texts come back each; texts of any length are read whole; an empty table gives no rows; other columns are
    not read. ``block`` bounds the mean number of shingles in a block.
    """
    radius = radius_of(similarity, words)
    drawn = written(sketches(docs, width, words, node), "sketches")
    reps = written(drawn.groupBy("digest").agg(F.min(node).alias("rep"), F.min_by("fp", node).alias("fp"), F.first("n").alias("n")), "texts")
    first = reps.groupBy("fp").agg(F.min("rep").alias("rep"))
    same = reps.join(first.withColumnRenamed("rep", "v"), "fp").where("rep <> v").select(F.col("rep").alias("u"), "v")
    rough = components(links(first, radius, words, parts=1, tile=tile).unionByName(same)).withColumnRenamed("node", "rep")
    members = reps.join(rough, "rep")
    large = members.groupBy("component").agg(F.ceil(F.sum(F.col("n") + 8) / block).alias("blocks")).where("blocks > 1")
    dealt = members.join(large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).select("rep", "component", "fp", "n", "blocks")
    read = docs.select(F.col(node).alias("rep"), "text").join(dealt, "rep")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "component", "fp", "n", "blocks")), pa.array(sets, pa.binary())], ["rep", "component", "fp", "n", "blocks", "shingles"])

    sets = written(read.mapInArrow(shingle, "rep long, component long, fp array<long>, n long, blocks long, shingles binary"), "shingles")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    centres = sets.where("rep = component").withColumn("k", numbers("blocks"))

    def within(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.unique(group.column("rep").to_numpy(), return_index=True)[1]))  # the first member may be there twice
        rep, fps, own = members_of(group, words)
        label, every = rep.copy(), np.arange(len(rep))
        join_labels(label, every, every, fps, own, radius, similarity)
        return group.select(["rep", "component", "n", "blocks"]).append_column("label", pa.array(label))

    dealt_sets = sets.withColumn("k", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    labels = written(dealt_sets.unionByName(centres).groupBy("component", "k").applyInArrow(within, "rep long, component long, n long, blocks long, label long"), "labels").distinct()
    edges = labels.where("label <> rep").select(F.col("rep").alias("u"), F.col("label").alias("v"))
    apart = labels.where("blocks > 1 and label <> component")
    if not apart.isEmpty():
        edges = edges.unionByName(across(sets, labels, apart, radius, similarity, words, block))
    found = components(edges).withColumnRenamed("node", "rep")
    named = reps.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return drawn.join(named, "digest").select(node, "component_id")


def across(sets: DataFrame, labels: DataFrame, apart: DataFrame, radius: int, similarity: float, words: int, block: int) -> DataFrame:
    """(u, v): labels joined by links between members ``apart`` from their group's first member and members of all blocks."""
    parts = apart.groupBy("component").agg(F.ceil(F.sum(F.col("n") + 8) / block).alias("parts"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    wanted = sets.select("rep", "component", "fp", "blocks", "shingles").join(labels.select("rep", "label"), "rep").join(parts, "component")
    k, j = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts"))
    theirs = wanted.withColumn("k", k).withColumn("j", numbers("parts")).withColumn("side", F.lit(1))
    ours = wanted.where("label <> component").withColumn("j", j).withColumn("k", numbers("blocks")).withColumn("side", F.lit(0))

    def meet(group: pa.Table) -> pa.Table:
        _, fps, own = members_of(group, words)
        side, label = group.column("side").to_numpy(), group.column("label").to_numpy().copy()
        pairs = join_labels(label, np.flatnonzero(side == 0), np.flatnonzero(side == 1), fps, own, radius, similarity)
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    columns = ["component", "j", "k", "side", "label", "rep", "fp", "shingles"]
    return ours.select(columns).unionByName(theirs.select(columns)).groupBy("component", "j", "k").applyInArrow(meet, "u long, v long")
