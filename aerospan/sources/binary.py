"""A Python data source for binary field files: a header of named entries, then rows of little-endian doubles.

Register with ``spark.dataSource.register(FieldSource)`` and read with ``format("aerospan_field")``. A file is read in
ranges of rows, each its own partition, so one large file is read by many tasks; a read of some columns takes only
their bytes of each row. The layout is this library's own: eight magic bytes, the header's length, the header as
JSON, the rows.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC = b"AEROFLD1"
#: The header's keys.
KEYS = ("Object", "Dimension", "ResultsOn", "Type", "Size", "Sequence", "Filter", "Sorting", "Id", "Columns", "Lines", "TstepNo", "NSubdom", "Division", "Tag1", "Tag2", "Time")


def read_header(path: str) -> tuple[dict, int]:
    """The header and where the rows begin."""
    with open(path, "rb") as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{path} is not a field file")
        n = int.from_bytes(f.read(8), "little")
        return json.loads(f.read(n)), 16 + n


def write_file(path: str, rows: np.ndarray, **header) -> None:
    rows = np.ascontiguousarray(rows, "<f8").reshape(len(rows), -1)
    made = dict.fromkeys(KEYS) | {"Columns": rows.shape[1], "Lines": len(rows)} | header
    raw = json.dumps(made).encode()
    with open(path, "wb") as f:
        f.write(MAGIC + len(raw).to_bytes(8, "little") + raw + rows.tobytes())


def edit_header(path: str, **changes) -> dict:
    """Change entries; the rows stay as they are."""
    header, start = read_header(path)
    if unknown := set(changes) - set(KEYS):
        raise KeyError(f"unknown header entries {sorted(unknown)}")
    header |= changes
    raw = json.dumps(header).encode()
    with open(path, "rb") as f:
        f.seek(start)
        body = f.read()
    with open(f"{path}.new", "wb") as f:
        f.write(MAGIC + len(raw).to_bytes(8, "little") + raw + body)
    os.replace(f"{path}.new", path)
    return header


class RowRange(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class FieldReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[RowRange]:
        size = int(self.options.get("rows", 1_000_000))
        out = []
        for path in sorted(glob.glob(self.options["path"])):
            lines = read_header(path)[0]["Lines"]
            out += [RowRange(path, at, min(size, lines - at)) for at in range(0, lines, size)]
        return out

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        header, start = read_header(part.path)
        width = header["Columns"]
        rows = np.memmap(part.path, "<f8", "r", start, (header["Lines"], width))[part.first : part.first + part.n]
        for at in range(0, len(rows), 65_536):
            piece = rows[at : at + 65_536]
            arrays = [pa.array(np.arange(part.first + at, part.first + at + len(piece))), *(pa.array(np.ascontiguousarray(piece[:, k])) for k in range(width))]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([("row", pa.int64()), *((f"c{k}", pa.float64()) for k in range(width))]))


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class FieldWriter(DataSourceArrowWriter):
    """Each task writes one file, batch by batch; a failed task leaves none, and a failed job's files are removed."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = options, [c for c in schema.names if c != "row"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import uuid

        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return Written(None)
        os.makedirs(self.options["path"], exist_ok=True)
        path = f"{self.options['path']}/part-{uuid.uuid4().hex}.fld"
        header = lambda lines: json.dumps(dict.fromkeys(KEYS) | {"Columns": len(self.columns), "Lines": lines}).encode()
        room, lines = len(header(10**18)), 0  # the number of rows is known last
        try:
            with open(f"{path}.new", "wb") as f:
                f.write(MAGIC + room.to_bytes(8, "little") + b" " * room)
                for batch in chain([first], batches):
                    columns = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.columns]
                    f.write(np.column_stack(columns).astype("<f8").tobytes())
                    lines += batch.num_rows
                f.seek(16)
                f.write(header(lines).ljust(room))
            os.replace(f"{path}.new", path)
        except BaseException:
            if os.path.exists(f"{path}.new"):
                os.remove(f"{path}.new")
            raise
        return Written(path)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class FieldSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "aerospan_field"

    def schema(self) -> str:
        first = sorted(glob.glob(self.options["path"]))[0]
        return "row long, " + ", ".join(f"c{k} double" for k in range(read_header(first)[0]["Columns"]))

    def reader(self, schema: StructType) -> FieldReader:
        return FieldReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FieldWriter:
        return FieldWriter(self.options, schema)
