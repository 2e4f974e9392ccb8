"""Embedding near-dedup by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Vectors are scaled to length one, so a cosine of at least c means a distance of at most r = sqrt(2 - 2 c). A coarse
quantiser and codebooks for parts of residuals are learned on a bounded sample; every vector is indexed: its list,
its code, and how far its code's reconstruction is off (e).

Probes are sufficient, not a fixed number: a vector within r of x that lies in list L lies beyond the plane between x's
own centroid and that of L, so L is probed if x is within r of that plane; no other list can hold a link. Within a
list the distance from x to a reconstruction comes from lookup tables of the exact x (asymmetric); by the triangle
inequality only vectors whose lookup distance is at most r + e can be linked, and those are reranked by exact cosine
in double precision. So recall against brute force is one, whatever the sample.

Vectors are dealt into tiles of neighbouring lists, and of many tiles up to GROUP make a block; two blocks meet if one
probes a list of the other. Vectors move to meetings with their code alone: which lists a vector probes, up to all of
them, is worked out where it is needed. A meeting emits counts of links and a spanning forest of them, never the
pairs. Equal vectors are one entry with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerospan.llm.common import forest, slices, written
from aerospan.llm.graph import components

SLACK = 1e-5  # for rounding in single precision
#: Tiles of a block, at most; fewer where there would be under BLOCKS of them.
GROUP, BLOCKS = 4, 32


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of ``x``; an empty cluster keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        at = nearest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and all squared distances."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
    return d.argmin(axis=1), d


@dataclass
class Quantiser:
    """``lists`` (n, dim), ordered so that neighbours in the order are near; ``books`` (parts, words, dim of a part)."""

    lists: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, parts: int = 8, words: int = 64) -> Quantiser:
        dim = sample.shape[1]
        parts = next(p for p in range(min(parts, dim), 0, -1) if dim % p == 0)
        c = kmeans(sample, lists)
        axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0] if len(c) > 1 else np.ones(dim)
        c = c[np.argsort(c @ axis)]
        rest = sample - c[nearest(sample, c)[0]]
        return cls(c, np.stack([kmeans(p, words) if len(p) >= words else np.vstack([p, np.zeros((words - len(p), p.shape[1]))]) for p in np.split(rest, parts, axis=1)]))

    def index(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own list, code, error of the reconstruction, and squared distances to all lists."""
        at, d = nearest(x, self.lists)
        rest = x - self.lists[at]
        code = np.stack([nearest(p, b)[0] for p, b in zip(np.split(rest, len(self.books), axis=1), self.books, strict=True)], axis=1).astype(np.uint8)
        return at, code, np.linalg.norm(x - self.rebuilt(at, code), axis=1), d

    def rebuilt(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.lists[at] + np.concatenate([b[code[:, k]] for k, b in enumerate(self.books)], axis=1)

    def probes(self, at: np.ndarray, d: np.ndarray, r: float) -> np.ndarray:
        """Which lists may hold a vector within r of each row (rows, lists)."""
        apart = np.sqrt(np.maximum(0, nearest(self.lists, self.lists)[1]))
        own = d[np.arange(len(at)), at]
        return d - own[:, None] <= 2 * (r + SLACK) * apart[at] + SLACK


@dataclass
class Tile:
    """Vectors (unit, double precision) with their copies, lists, the lists each probes (a list a vector, or a flag a list), codes, and errors of the codes."""

    x: np.ndarray
    copies: np.ndarray
    at: np.ndarray
    near: pa.Array | np.ndarray
    code: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, v: pa.Table, q: Quantiser, r: float) -> Tile:
        v = v.combine_chunks()
        field = lambda c: v.column(c).to_numpy()
        x, at = unit(pa.concat_arrays(v.column("x").chunks)), field("list")
        near = [q.probes(at[k : k + 1024], nearest(x[k : k + 1024], q.lists)[1], r) for k in range(0, len(x), 1024)]
        return cls(x, field("copies"), at, np.concatenate(near), np.frombuffer(b"".join(v.column("code").to_pylist()), np.uint8).reshape(len(x), -1), field("error"))

    def probed(self, lists: int) -> np.ndarray:
        if isinstance(self.near, np.ndarray):
            return self.near
        out = np.zeros((len(self.x), lists), bool)
        out[self.near.value_parent_indices().to_numpy(), self.near.flatten().to_numpy()] = True
        return out


def meet(q: Quantiser, x: Tile, y: Tile, r: float, least: float, same: bool, block: int = 512, rerank: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (i, j) between rows of two tiles, for each ``block`` rows of ``x``; ``rerank`` pairs are compared at once."""
    order = np.argsort(y.at, kind="stable")
    cuts = np.searchsorted(y.at[order], np.arange(len(q.lists) + 1))
    probed, xf, code = x.probed(len(q.lists)), x.x.astype(np.float32), y.code
    rebuilt = q.rebuilt(y.at, code).astype(np.float32)
    square = (rebuilt * rebuilt).sum(axis=1)
    books, centroids = q.books.astype(np.float32), q.lists.astype(np.float32)
    parts, _, width = books.shape
    for at in range(0, len(xf), block):
        rows, out = xf[at : at + block], []
        #: lookup tables: inner products of each row's parts with each codeword, and with the lists
        tables = np.einsum("nps,pws->npw", rows.reshape(len(rows), parts, width), books)
        lists = rows @ centroids.T
        for k in np.flatnonzero(probed[at : at + block].any(axis=0) & (np.diff(cuts) > 0)):
            mine, theirs = np.flatnonzero(probed[at : at + block, k]), order[cuts[k] : cuts[k + 1]]
            dot = np.repeat(lists[mine, k : k + 1], len(theirs), axis=1)
            for p in range(parts):
                dot += tables[mine, p][:, code[theirs, p]]
            distance = 1 + square[theirs] - 2 * dot
            i, j = np.nonzero(distance <= (r + y.error[theirs] + SLACK) ** 2 + SLACK)
            i, j = mine[i] + at, theirs[j]
            if same:
                i, j = i[i < j], j[i < j]
            for a in range(0, len(i), rerank):
                m, n = i[a : a + rerank], j[a : a + rerank]
                fine = np.einsum("nd,nd->n", x.x[m], y.x[n]) >= least
                out.append((m[fine], n[fine]))
        if out:
            yield np.concatenate([m for m, _ in out]), np.concatenate([n for _, n in out])


def embedding_dedup(vectors: DataFrame, least: float = 0.9, sample: int = 8192, most_lists: int = 1024, tile: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding array of numbers).

    ``sample`` bounds the rows that the quantiser is learned on (those with the least hash of their id); every row is
    indexed. Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing; vectors link
    only with those of their own length; equal vectors link with each other; rows that repeat a vec_id are counted
    as vectors of their own; a null vec_id counts as a vector too, but is no component's name unless there is no
    other (then that is null, and the row is kept); an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    single = getattr(vectors.schema["embedding"].dataType, "elementType", None) == T.FloatType()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("x"))
    sound = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = written(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    #: a node for each different vector; ``rep`` is the least vec_id that has it
    reps = rows.where("sound").groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    counts, edges = None, None
    for (dim, n) in sorted((r[0], r[1]) for r in reps.groupBy(F.size("x")).count().collect()):  # a row for each length
        mine = reps.where(F.size("x") == dim)
        learned = mine.orderBy(F.xxhash64("rep"), "rep", "node").limit(sample).select("x").collect()
        at = np.array([r.x for r in learned], np.float64)
        at /= np.abs(at).max(axis=1, keepdims=True)
        at /= np.linalg.norm(at, axis=1, keepdims=True)
        q = Quantiser.fit(at, max(1, min(most_lists, round(n**0.5))))
        c, e = linked(spark, mine, q, least, tile)
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if counts is None:
        return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    found = components(edges)
    named = reps.select("node", "rep").join(found, "node")
    names = named.groupBy("component").agg(F.min("rep").alias("name"))
    named = named.select("node", "component").join(names, "component").select("node", "name", F.lit(True).alias("linked"))
    facts = reps.join(counts, "node", "left").join(named, "node", "left")
    facts = facts.select("x", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.when(F.col("linked"), F.col("name")).otherwise(F.col("rep")).alias("component_id"))
    out = rows.where("sound").join(facts, "x").select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def linked(spark, reps: DataFrame, q: Quantiser, least: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(node, n): linked vectors with their copies; (u, v): edges that span the links."""
    r = float(np.sqrt(2 - 2 * least))
    shared = spark.sparkContext.broadcast(q)  # at most most_lists centroids and the codebooks
    form = reps.schema["x"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            at, code, error, _ = shared.value.index(unit(batch.column("x")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "copies", "x")), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["node", "copies", "x", "list", "code", "error"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which lists' vectors probe which lists, of all vectors of a task: as many rows as pairs of lists at most."""
        found = np.zeros((len(shared.value.lists),) * 2, bool)
        for batch in slices(batches, 1024):
            at = batch.column("list").to_numpy()
            near = shared.value.probes(at, nearest(unit(batch.column("x")), shared.value.lists)[1], r)
            for k in np.unique(at):
                found[k] |= near[at == k].any(axis=0)
        for k in np.flatnonzero(found.any(axis=1)):
            other = np.flatnonzero(found[k]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), k, np.int32)), pa.array(other)], ["list", "other"])

    indexed = written(reps.select("node", "copies", "x").mapInArrow(assign, f"node long, copies long, x {form}, list int, code binary, error double"), "indexed-vectors")
    #: neighbouring lists share a tile until it is full; a list beyond the bound is dealt by hash into several tiles
    sizes = sorted((row[0], row[1]) for row in indexed.groupBy("list").count().collect())  # a row for each list
    home, k, held = {}, 0, 0
    for at, size in sizes:
        if held and held + size > tile:
            k, held = k + 1, 0
        split = -(-size // tile)
        home[at] = (k, split)
        if split > 1:
            k, held = k + split, 0
        else:
            held += size
    group = max(1, min(GROUP, (k + 1) // BLOCKS))
    table = spark.createDataFrame([(a, b, c) for a, (b, c) in home.items()], "list int, first int, split int")
    block = F.floor((F.col("first") + F.pmod(F.xxhash64("node"), F.col("split"))) / group).cast("int")
    placed = written(indexed.join(F.broadcast(table), "list").select(block.alias("block"), "node", "copies", "x", "list", "code", "error"), "placed-vectors")
    ends = table.select("list", F.floor(F.col("first") / group).cast("int").alias("low"), F.floor((F.col("first") + F.col("split") - 1) / group).cast("int").alias("high"))
    wanted = indexed.select("list", "x").mapInArrow(probe, "list int, other int").distinct().join(F.broadcast(ends), "list")
    wanted = wanted.select(F.explode(F.sequence("low", "high")).alias("one"), F.col("other").alias("list")).distinct().join(F.broadcast(ends), "list")
    wanted = wanted.select("one", F.explode(F.sequence("low", "high")).alias("other")).distinct()
    pairs = written(wanted.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct(), "block-pairs")
    ends = pairs.select(F.col("a").alias("block"), "a", "b", F.lit(False).alias("second")).unionByName(pairs.where("a <> b").select(F.col("b").alias("block"), "a", "b", F.lit(True).alias("second")))
    met = placed.join(ends.hint("merge"), "block").drop("block").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a", "b")

    def compare(rows: pa.Table) -> pa.Table:
        v1, v2 = rows.filter(pc.invert(rows.column("second"))), rows.filter(rows.column("second"))
        same, nodes = not v2.num_rows, np.concatenate([v1.column("node").to_numpy(), v2.column("node").to_numpy()])
        x = Tile.of(v1, shared.value, r)
        y, size = x if same else Tile.of(v2, shared.value, r), v1.num_rows
        total, child, root = np.zeros(size + v2.num_rows), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in meet(shared.value, x, y, r, least, same):
            total += np.bincount(i, weights=y.copies[j], minlength=len(total))
            j = j if same else j + size
            total += np.bincount(j, weights=x.copies[i], minlength=len(total))
            child, root = forest(len(total), np.concatenate([child, i]), np.concatenate([root, j]))
        some = np.flatnonzero(total)
        v = pa.array(np.concatenate([np.zeros(len(some), np.int64), nodes[root]]), mask=np.arange(len(some) + len(root)) < len(some))
        return pa.Table.from_arrays([pa.array(np.concatenate([nodes[some], nodes[child]])), v, pa.array(np.concatenate([total[some], np.zeros(len(child))]).astype(np.int64))], ["u", "v", "n"])

    found = written(met.groupBy("a", "b").applyInArrow(compare, "u long, v long, n long"), "vector-links")
    return found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n")), found.where("v is not null").select("u", "v")


def unit(column: pa.Array) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large or small parts finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
