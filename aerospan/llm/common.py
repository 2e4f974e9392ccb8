"""Shared pieces of the training-data operators: the shared folder, tables cut out of the lineage, row identity and words."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables are read with these fields left out of file names, so a run never sees another run's files.
_RUN = uuid.uuid4().hex[:12]
_LOCAL: list[str] = []
_CLEAN: list[tuple] = []
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and the master is local (tests), a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="aerospan-"))
        found = _LOCAL[0]
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/aerospan/{_RUN}/{name}-{uuid.uuid4().hex[:10]}"
    if not _CLEAN:
        atexit.register(_clean)
    _CLEAN.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _CLEAN:
        try:
            release(spark, path)
        except Exception:  # the session may have ended before the interpreter does
            return


def release(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder with the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    schema, spark = df.schema, df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    del df
    settle(spark)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[id(out)] = path
    return out


#: Rows and bytes of an Arrow batch while tables are written: what a Python worker and its executor hold of long texts at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds the session's Arrow batches to BATCH, and then sets what was there before."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, most in BATCH.items():
            had = before[k]
            if had is not None:
                held = int(had.rstrip("b")) if had.rstrip("b").lstrip("-").isdigit() else most
                spark.conf.set(k, str(min(held, most) if held > 0 else most))
        yield
    finally:
        for k, had in before.items():
            if had is not None:
                spark.conf.set(k, had)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no later plan reads."""
    for table in tables:
        path = _PATHS.pop(id(table), None)
        if path:
            release(table.sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so when the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Range partitions of ``rows`` in ascending ``order`` (nulls first, then as the rows lie), each with ``_part`` and ``_row``, its
    partition and its place there. Equal rows may lie in several partitions, so no value fills one."""
    keys = [F.col(c).asc_nulls_first() for c in (*order, "_at")]
    at = F.monotonically_increasing_id()
    ranged = rows.withColumn("_at", at).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ranged.drop("_at").withColumn("_part", F.shiftright(at, 33).cast("int")).withColumn("_row", at.bitwiseAND((1 << 33) - 1))


def with_uid(docs: DataFrame) -> DataFrame:
    """``docs`` with ``uid``, a long that names each row and orders rows as ``doc_id`` does.

    ``uid`` is ``doc_id`` where that is never null and never repeated. Otherwise rows are put in the order of
    (doc_id, nulls first, a hash of the text) and written to the shared folder with a number each, so equal rows stay apart.
    """
    n, ids, distinct = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == ids == distinct:
        return docs.withColumn("uid", F.col("doc_id").cast("long"))
    ranged = in_order(docs.withColumn("_hash", F.xxhash64("text")), ["doc_id", "_hash"])
    number = (F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_row")).alias("uid", metadata={"by_row": True})
    return written(ranged.select(*docs.columns, number), "uid")


def numbered_rows(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """uid, doc_id, text of each row; ``uid`` names a column that already tells rows apart in the order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(uid).alias("uid", metadata={"by_row": True})] if uid else []))
    return rows if uid else with_uid(rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most ``rows`` rows and about ``most`` bytes (one row may be longer)."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).get_total_buffer_size() and batch.slice(at, n).nbytes > most:
                n = n // 2
            yield batch.slice(at, n)
            at += n


def texts_of(column: pa.Array) -> list[str]:
    """Strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph on 0..n-1 with edges (i, j): each node and its component's smallest node."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        old = label.copy()
        for end in (i, j):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(old, label):
            break
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]
