"""Token ids as Arrow stream-file shards with fixed-size-list batches: sequences and masks open to random access.

A shard is an Arrow IPC file. Each row is one sequence: ``ids``, a fixed-size list of ``seq_len`` unsigned integers
(16 bits where the vocabulary allows), and two masks, fixed-size lists of booleans: ``mask`` is false on the padding of a
shard's last row, ``first`` is true on the first id of each document. Because all rows have one length, token ``k`` of a
shard lies at item ``k`` of the flat buffer: a memory-mapped reader finds any sequence or document without copying or
scanning, and the masks tell where it ends. A Parquet index names, for each document, its shard and its place there.
Shards hold ascending ranges of ``doc_id``.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerospan.llm.common import in_order, shared_path, slices, texts_of, written
from aerospan.llm.tokens import encoder

INDEX = "doc_id long, shard int, file string, shard_start long, n_tokens long"


class ShardWriter:
    """Writes one shard: takes ids as they come, keeps at most ``rows`` sequences in memory."""

    def __init__(self, file: str, dtype: np.dtype, seq_len: int, rows: int):
        fs, path = pafs.FileSystem.from_uri(file)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.kind = {2: pa.uint16(), 4: pa.uint32()}[dtype.itemsize]
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len)), ("first", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.dtype, self.seq_len, self.rows, self.held, self.n, self.total = dtype, seq_len, rows, [], 0, 0
        self.starts: list[int] = []  # of held documents, by place in the shard

    def add(self, ids: bytes) -> int:
        """Append a document's ids; returns where in the shard they start."""
        at = self.total
        k = len(ids) // self.dtype.itemsize
        self.held.append(ids)
        self.starts.append(at)
        self.n += k
        self.total += k
        if self.n >= self.rows * self.seq_len:
            self._put(self.n // self.seq_len)
        return at

    def _put(self, rows: int) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        size = rows * self.seq_len
        body, rest = flat[:size], flat[size:]
        mask = np.arange(size) < len(body)
        body = np.concatenate([body, np.zeros(size - len(body), self.dtype)])
        at, first = np.array(self.starts, np.int64) - (self.total - self.n), np.zeros(size, bool)
        first[at[at < size]] = True
        self.starts = self.starts[int((at < size).sum()) :]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.seq_len) for x, t in ((body, self.kind), (mask, pa.bool_()), (first, pa.bool_()))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n = ([rest.tobytes()] if len(rest) else []), len(rest)

    def close(self) -> None:
        if self.n:
            self._put(-(-self.n // self.seq_len))
        self.writer.close()
        self.sink.close()


class Shard:
    """Reads a shard by memory map where the file system has one; batches are views of the mapped file."""

    def __init__(self, file: str):
        fs, path = pafs.FileSystem.from_uri(file)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.flat, self.marks, self.ends, at = {}, {}, [], 0
        for k in range(self.reader.num_record_batches):
            at += self.reader.get_batch(k).num_rows
            self.ends.append(at)

    def batch(self, k: int) -> np.ndarray:
        """All ids of batch ``k``, without a copy."""
        if k not in self.flat:
            if len(self.flat) > 4:
                self.flat.clear()
            self.flat[k] = self.reader.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)
        return self.flat[k]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        k = int(np.searchsorted(self.ends, row, side="right"))
        at = row - (self.ends[k - 1] if k else 0)
        mask = self.reader.get_batch(k).column("mask")[at].values.to_numpy(zero_copy_only=False)
        return self.batch(k)[at * self.seq_len : (at + 1) * self.seq_len], mask

    def firsts(self, k: int) -> np.ndarray:
        """Places in the shard at which documents of batch ``k`` start; after the last batch the end of the shard's ids."""
        if k not in self.marks:
            if len(self.marks) > 4:
                self.marks.clear()
            base = (self.ends[k - 1] if k else 0) * self.seq_len
            batch = self.reader.get_batch(k)
            at = np.flatnonzero(batch.column("first").values.to_numpy(zero_copy_only=False)) + base
            if k == len(self.ends) - 1:
                at = np.append(at, base + np.count_nonzero(batch.column("mask").values.to_numpy(zero_copy_only=False)))
            self.marks[k] = at
        return self.marks[k]

    def document(self, start: int) -> np.ndarray:
        """All ids of the document that starts at place ``start``."""
        k = int(np.searchsorted(self.ends, start // self.seq_len, side="right"))
        at = int(np.searchsorted(self.firsts(k), start))
        if at == len(self.firsts(k)) or self.firsts(k)[at] != start:
            raise ValueError(f"no document starts at {start}")
        at += 1
        while at >= len(self.firsts(k)):
            k, at = k + 1, 0
        return self.ids(start, int(self.firsts(k)[at]) - start)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard."""
        out, end = [], start + n
        k = int(np.searchsorted(self.ends, start // self.seq_len, side="right"))
        while start < end:
            base = (self.ends[k - 1] if k else 0) * self.seq_len
            part = self.batch(k)[start - base : end - base]
            out.append(part)
            start += len(part)
            k += 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, seq_len: int = 1024, rows: int = 256) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards below ``folder``; returns the index table (INDEX).

    One range shuffle by doc_id puts documents in order; each task then encodes its documents in that order and
    streams them to its shard. A task that runs again writes another file, and only files named by the committed
    index count. Null texts are empty documents (one id, the end id); rows with equal doc_id are ordered by a hash of
    their text, each keeps its own entry, and no number of them fills one task; null doc_id comes first; an empty table
    gives an empty index. Other columns are not read.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = in_order(ordered.withColumn("_hash", F.xxhash64("text")), ["doc_id", "_hash"]).select("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, out = encoder(tokenizer), TaskContext.get().partitionId(), None
        file = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.arrow"
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in slices(batches):
            out = out or ShardWriter(file, enc.dtype, seq_len, rows)
            coded = [x + end for x in enc.encode(texts_of(batch.column(1)))]
            starts = [out.add(x) for x in coded]
            n = [len(x) // enc.dtype.itemsize for x in coded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * len(n), pa.int32()), pa.array([file] * len(n)), pa.array(starts, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "shard", "file", "shard_start", "n_tokens"])
        if out:
            out.close()

    return written(ordered.mapInArrow(put, INDEX), "token-index")


def read_store(index: DataFrame) -> DataFrame:
    """From the files named by ``index``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The index says where a document lies; its length and ids are read from the shard. Of the index's lengths only sums by shard are
    used, for the places of whole shards.
    """
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("shard", before.alias("base"))  # one row for each shard

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            sizes, crcs = [], []
            for file, start in zip(*(batch.column(c).to_pylist() for c in ("file", "shard_start")), strict=True):
                if file != at:
                    at, shard = file, Shard(file)
                ids = shard.document(start)
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])

    read = index.mapInArrow(get, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return read.join(bases, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the store, then read every document back from it."""
    return read_store(write_store(docs, folder or shared_path(spark, "tokens"), tokenizer))
