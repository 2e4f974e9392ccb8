"""Text formats: witness series, tile matrices, point and polygon files, and text sinks.

Readers of line formats split by line and stay in expressions. Formats with a running state inside a file (witness,
solids) are read file by file on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerospan.operators.statistics import in_places

from aerospan.functions.numeric import truncate

WITNESS = "file string, iter long, time double, wit_id long, var string, value double"


def witness(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of witness files: a header (variables, their columns, NUMVARIABLES, NUMSETS, START), then blocks of an
    iteration line, a time line and one line for each point. Numbers stand in the fourth word of the two lines."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines, columns, points = iter(text.splitlines()), {}, 0
                for line in lines:
                    words = line.split()
                    if "START" in line:
                        break
                    if "NUMSETS" in line:
                        points = int(line.split(":")[1])
                    elif "NUMVARIABLES" not in line and "HEADER" not in line and len(words) > 5 and words[5].isdigit():
                        columns[words[1]] = int(words[5]) - 1
                for first in lines:
                    if not first.strip():
                        continue
                    it, at = int(first.split()[3]), float(next(lines).split()[3])
                    data = [next(lines).split() for _ in range(points)]
                    out = [(file, it, at, k, name, float(row[c])) for k, row in enumerate(data) for name, c in columns.items()]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["file", "iter", "time", "wit_id", "var", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInArrow(parse, WITNESS)


def tiles(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """(file, key, i, j, v) of comma-separated matrices whose name holds ``keyword``; ``key`` is the number after a dash."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), "value")
    rows = whole.where(F.col("file").contains(keyword)).select("file", F.posexplode(F.split(F.trim(F.col("value"), F.lit(" \r\n")), r"\r?\n")).alias("i", "line"))
    key = F.expr(r"try_cast(regexp_extract(file, '-(\\d+)', 1) AS BIGINT)")
    return rows.select("file", key.alias("key"), "i", F.posexplode(F.split("line", ",")).alias("j", "t")).select("file", "key", "i", "j", F.col("t").try_cast("double").alias("v"))


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y."""
    return spark.read.option("header", True).schema("min_x double, max_x double, min_y double, max_y double").csv(path)


def points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z separated by spaces."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*(F.get(p, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate("xyz")))


def signal(spark: SparkSession, path: str, time: int, value: int) -> DataFrame:
    """(i, t, y) from ;-separated columns after a header, up to the first missing value."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.trim(F.col("value"), F.lit(" \r\n")), r"\r?\n")).alias("i", "line")).where("i > 0")
    c = F.split("line", ";")
    s = rows.select((F.col("i") - 1).alias("i"), F.get(c, F.lit(time)).try_cast("double").alias("t"), F.get(c, F.lit(value)).try_cast("double").alias("y"))
    bad = s.where(F.col("y").isNull() | F.isnan("y") | F.col("t").isNull()).agg(F.min("i").alias("cut"))
    return s.crossJoin(F.broadcast(bad)).where("cut is null or i < cut").select("i", "t", "y")


def partition_table(lines: DataFrame) -> DataFrame:
    """(id, elements, points, boundaries) from lines of four numbers, the first of which differ; empty parts are dropped, the rest renumbered."""
    c = F.split(F.trim("value"), r"\s+")
    t = lines.select(*(F.get(c, F.lit(k)).try_cast("long").alias(n) for k, n in enumerate(("old", "elements", "points", "boundaries")))).where("elements <> 0")
    return in_places(t, F.col("old"), out="id").select("id", "elements", "points", "boundaries")


def solids(spark: SparkSession, path: str) -> DataFrame:
    """Triangles (file, tri_id, p) of STL files, text or binary, all solids of a file in order."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = stl(raw)
                kind = pa.list_(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(v)), pa.array(range(len(v)), pa.int64()), pa.array(v.tolist(), kind)], ["file", "tri_id", "p"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, tri_id long, p array<array<double>>")


def stl(raw: bytes) -> np.ndarray:
    """Corners (triangles, 3, 3)."""
    if len(raw) >= 84 and len(raw) == 84 + 50 * int.from_bytes(raw[80:84], "little"):
        rows = np.frombuffer(raw, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)
        return rows["v"].astype(np.float64)
    found = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", raw)
    return np.array([[float(x) for x in p] for p in found]).reshape(-1, 3, 3)


def wkt_rings(wkt: Column) -> Column:
    """Rings of a POINT, LINESTRING, POLYGON or MULTI* text as array<array<struct<x, y>>>."""
    texts = F.regexp_extract_all(F.upper(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda t: F.split(F.trim(t), r"\s+")
    pair = lambda t: F.struct(F.get(point(t), F.lit(0)).try_cast("double").alias("x"), F.get(point(t), F.lit(1)).try_cast("double").alias("y"))
    return F.transform(texts, lambda r: F.transform(F.split(r, ","), pair))


def wkt_multipolygon(wkt: Column) -> Column:
    """Polygons of a POLYGON or MULTIPOLYGON text as array<array<array<struct<x, y>>>>: the rings of each, the outer one first.

    An EMPTY text has no polygons; other kinds give null.
    """
    text = F.upper(F.trim(wkt))
    many = F.regexp_extract_all(text, F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), F.lit(1))
    return F.when(text.rlike("^(MULTI)?POLYGON"), F.transform(many, wkt_rings))


def multipolygon_text(rings: DataFrame) -> DataFrame:
    """(id, wkt) of rings (id, polygon, ring, pt_no, x, y) as MULTIPOLYGON texts, every ring closed."""
    point = F.concat_ws(" ", *(F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") for c in ("x", "y")))
    gathered = lambda order, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, what))), lambda s: s[what]), ",")
    p = rings.withColumn("_t", point).groupBy("id", "polygon", "ring").agg(gathered("pt_no", "_t").alias("_t"))
    p = p.withColumn("_t", F.concat(F.lit("("), "_t", F.lit(","), F.substring_index("_t", ",", 1), F.lit(")")))
    p = p.groupBy("id", "polygon").agg(gathered("ring", "_t").alias("_t")).withColumn("_t", F.concat(F.lit("("), "_t", F.lit(")")))
    return p.groupBy("id").agg(F.concat(F.lit("MULTIPOLYGON("), gathered("polygon", "_t"), F.lit(")")).alias("wkt"))


def closed(ring: Column) -> Column:
    """A ring without its last point if that repeats the first."""
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def pair_lines(pairs: DataFrame, master_first: bool = True) -> DataFrame:
    a, b = ("master", "slave") if master_first else ("slave", "master")
    return pairs.select(F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")).alias("value"))


def element_lines(elements: DataFrame) -> DataFrame:
    """One line for each element: number and nodes, counted from one."""
    nodes = F.transform("nodes", lambda n: (n + 1).cast("string"))
    return elements.select(F.concat_ws(" ", (F.col("elem_id") + 1).cast("string"), F.array_join(nodes, " ")).alias("value"))


def node_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat_ws(" ", (F.col("node_id") + 1).cast("string"), *(F.format_string("%.6f", c) for c in ("x", "y", "z"))).alias("value"))


def obj_lines(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Lines of a Wavefront OBJ, with ``k`` to order them: vertices, then faces."""
    v = nodes.select(F.struct(F.lit(0).alias("part"), F.col("node_id").alias("id")).alias("k"), F.concat_ws(" ", F.lit("v"), *(F.format_string("%.6f", c) for c in ("x", "y", "z"))).alias("value"))
    f = elements.select(F.struct(F.lit(1).alias("part"), F.col("elem_id").alias("id")).alias("k"), F.concat_ws(" ", F.lit("f"), F.array_join(F.transform("nodes", lambda n: (n + 1).cast("string")), " ")).alias("value"))
    return v.unionByName(f)


def xdmf(times: list[float], topology: str, cells: int, per_cell: int, nodes: int, fields: dict[str, int], files: list[str]) -> str:
    """An XDMF document of a temporal collection: fixed mesh, one attribute for each field (name: components)."""
    kinds = {1: "Scalar", 3: "Vector", 6: "Tensor6", 9: "Tensor"}
    item = lambda size, kind, where: f'<DataItem Dimensions="{size}" NumberType="{kind}" Precision="8" Format="HDF">{where}</DataItem>'
    grids = []
    for t, file in zip(times, files, strict=True):
        attributes = "".join(f'<Attribute Name="{n}" AttributeType="{kinds.get(c, "Matrix")}" Center="Node">{item(f"{nodes} {c}", "Float", f"{file}:/{n}")}</Attribute>' for n, c in fields.items())
        mesh = f'<Topology TopologyType="{topology}" NumberOfElements="{cells}">{item(f"{cells} {per_cell}", "Int", f"{file}:/connectivity")}</Topology><Geometry GeometryType="XYZ">{item(f"{nodes} 3", "Float", f"{file}:/points")}</Geometry>'
        grids.append(f'<Grid Name="mesh" GridType="Uniform"><Time Value="{t!r}"/>{mesh}{attributes}</Grid>')
    return f'<?xml version="1.0"?><Xdmf Version="3.0"><Domain><Grid Name="series" GridType="Collection" CollectionType="Temporal">{"".join(grids)}</Grid></Domain></Xdmf>'


def between(lines: DataFrame, marker: str) -> DataFrame:
    """Lines (n, value; n ascending) between the first two that contain ``marker``; none if there are fewer than two."""
    marks = lines.where(F.col("value").contains(marker)).select("n").orderBy("n").limit(2)
    ends = marks.agg(F.min("n").alias("a"), F.max("n").alias("b"))  # one row
    return lines.crossJoin(F.broadcast(ends)).where("n > a and n < b").select("n", "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with ``n``, ascending in the order of the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value")


def geometry_coordinates(spark: SparkSession, path: str, digits: int = 6) -> DataFrame:
    """(node_id, xs): node numbers and coordinates, cut to ``digits`` decimals, from the lines between two that say COORD."""
    words = F.split(F.trim("value"), r"\s+")
    body = between(numbered_lines(spark, path), "COORD").select(words.alias("w"))
    cut = lambda x: truncate(x.cast("double"), digits)
    return body.select(F.get("w", F.lit(0)).cast("long").alias("node_id"), F.transform(F.slice("w", F.lit(2), F.size("w") - 1), cut).alias("xs"))


def off_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (node_id, x, y, z) and faces (elem_id, nodes) of an OFF text; comments and empty lines are passed over.

    The counts are read first; then a line is a vertex or a face by its place, found in sorted ranges.
    """
    text = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", "#.*", ""))).where("value <> ''")
    head = text.orderBy("n").limit(2).collect()  # two lines: the keyword, and the counts
    counts = [int(x) for x in head[1]["value"].split()]
    rows = text.where(F.col("n") > head[1]["n"]).select("n", F.split("value", r"\s+").alias("w"))
    part = F.shiftright("n", 33)
    before = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size")).select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))  # a row for each file split
    place = F.row_number().over(Window.partitionBy("part").orderBy("n")) - 1 + F.col("start")
    placed = rows.withColumn("part", part).join(F.broadcast(before), "part").select(place.alias("k"), "w")
    x = lambda k: F.get("w", F.lit(k)).cast("double")
    vertices = placed.where(F.col("k") < counts[0]).select(F.col("k").alias("node_id"), x(0).alias("x"), x(1).alias("y"), x(2).alias("z"))
    size = F.get("w", F.lit(0)).cast("int")
    faces = placed.where((F.col("k") >= counts[0]) & (F.col("k") < counts[0] + counts[1]))
    return vertices, faces.select((F.col("k") - counts[0]).alias("elem_id"), F.transform(F.slice("w", F.lit(2), size), lambda v: v.cast("long")).alias("nodes"))


def off_lines(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Lines of an OFF text, with ``k`` to order them: keyword, counts, vertices, faces."""
    n = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(elements.agg(F.count(F.lit(1)).alias("m")))  # one row
    key = lambda part, at: F.struct(F.lit(part).alias("part"), at.cast("long").alias("id")).alias("k")
    head = n.select(F.explode(F.array(F.struct(key(0, F.lit(0)), F.lit("OFF").alias("value")), F.struct(key(1, F.lit(0)), F.concat_ws(" ", "n", "m", F.lit(0)).alias("value")))).alias("h")).select("h.*")
    v = nodes.select(key(2, F.col("node_id")), F.concat_ws(" ", *(F.format_string("%.6f", c) for c in ("x", "y", "z"))).alias("value"))
    f = elements.select(key(3, F.col("elem_id")), F.concat_ws(" ", F.size("nodes"), F.array_join(F.col("nodes").cast("array<string>"), " ")).alias("value"))
    return head.unionByName(v).unionByName(f)
