"""Where points lie in a mesh, and fields there: the element that holds a point, found by a tree of element boxes and Newton steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.functions.shapes import DEGREES, STARTS, bulge, own_places
from aerospan.operators.boxtree import build, nearest_points, reached
from aerospan.operators.mesh import shaped

AXES = ["x", "y", "z"]


def located(points: DataFrame, elements: DataFrame, nodes: DataFrame, tol: float = 1e-9) -> DataFrame:
    """(id, elem_id, nodes, weights) of points (id, x, y, z) in elements (elem_id, ltype, nodes) over nodes (node_id, x, y, z).

    ``weights`` are the shape functions at the point, one for each node. A point on a face that elements share belongs to the one with the
    least number; one outside all elements has no row. Triangles, quadrilaterals, tetrahedra, pyramids, wedges and hexahedra count, those with
    inner nodes too; as these may be bent, they are sought as far beyond their nodes as they can reach.
    """
    s = shaped(elements.where(F.col("ltype").isin(*STARTS)).withColumn("nodes", F.filter("nodes", lambda n: n >= 0)), nodes.select("node_id", *(F.col(x).cast("double").alias(x) for x in AXES)))
    s = s.where(F.size("p") == F.size("nodes"))
    along = lambda k: F.transform("p", lambda c: F.get(c, F.lit(k)))
    for k, x in enumerate(AXES):
        s = s.withColumn(f"lo_{x}", F.array_min(along(k))).withColumn(f"hi_{x}", F.array_max(along(k)))
    pad = tol * sum(((F.col(f"hi_{x}") - F.col(f"lo_{x}")) for x in AXES), F.lit(0.0))
    bent = F.lit(0.0)
    for t in DEGREES:
        bent = F.when(F.col("ltype") == t, bulge(t)).otherwise(bent)
    s = s.withColumn("_pad", pad).withColumns({f"_w_{x}": F.col("_pad") + bent * (F.col(f"hi_{x}") - F.col(f"lo_{x}")) for x in AXES})
    s = s.withColumns({f"lo_{x}": F.col(f"lo_{x}") - F.col(f"_w_{x}") for x in AXES} | {f"hi_{x}": F.col(f"hi_{x}") + F.col(f"_w_{x}") for x in AXES})
    tree = build(s.select(F.col("elem_id").alias("id"), "ltype", "nodes", F.flatten("p").alias("p"), *(f"{e}_{x}" for x in AXES for e in ("lo", "hi"))), AXES)
    q = points.select(F.col("id").alias("query"), *(F.col(x).cast("double").alias(x) for x in AXES))
    asked, found = reached(tree, q, 1)
    for x in AXES:  # a block's items within its box are few
        found = found.where((F.col(f"lo_{x}") <= F.col(f"to_{x}")) & (F.col(f"hi_{x}") >= F.col(f"from_{x}")))
    pairs = asked.join(found.hint("merge"), "block")
    for x in AXES:
        pairs = pairs.where(F.col(x).between(F.col(f"lo_{x}"), F.col(f"hi_{x}")))
    pairs = pairs.select("query", *AXES, "id", F.col("ltype").cast("int").alias("ltype"), "nodes", "p")
    kinds = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = batch.column("ltype").to_numpy()
            for t in np.unique(types):
                part = batch.filter(pa.array(types == t))
                p = part.column("p").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1, 3)
                at = np.stack([part.column(x).to_numpy(zero_copy_only=False) for x in AXES], axis=1)
                n, inside = own_places(int(t), p, at, tol)
                kept, keep = n[inside], part.filter(pa.array(inside))
                lists = pa.ListArray.from_arrays(np.arange(len(kept) + 1, dtype=np.int32) * n.shape[1], pa.array(kept.ravel()))
                yield pa.RecordBatch.from_arrays([keep.column("query"), keep.column("id"), keep.column("nodes"), lists], ["id", "elem_id", "nodes", "weights"])

    query, elem, lists = (kinds[c].dataType.simpleString() for c in ("query", "id", "nodes"))
    held = pairs.mapInArrow(run, f"id {query}, elem_id {elem}, nodes {lists}, weights array<double>")
    return held.groupBy("id").agg(F.min_by(F.struct("elem_id", "nodes", "weights"), "elem_id").alias("r")).select("id", "r.*")


def interpolated(points: DataFrame, elements: DataFrame, nodes: DataFrame, field: DataFrame, values: list[str], method: str = "femnn", tol: float = 1e-9) -> DataFrame:
    """(id, elem_id, node_id, one column a value): a field (node_id, values) at points (id, x, y, z).

    ``fem`` weights the nodes of the element that holds a point by its shape functions, with null outside the mesh; ``nn`` takes the nearest node,
    ties by number; ``femnn`` takes the nearest node outside the mesh only. ``node_id`` names the nearest node where it was taken.
    """
    if method not in ("fem", "nn", "femnn"):
        raise ValueError(f"no method {method}")
    out, rest = None, points
    if method != "nn":
        found = located(points, elements, nodes, tol)
        each = found.select("id", "elem_id", F.explode(F.arrays_zip("nodes", "weights")).alias("r")).select("id", "elem_id", F.col("r.nodes").alias("node_id"), F.col("r.weights").alias("w"))
        sums = each.join(field.select("node_id", *values), "node_id").groupBy("id", "elem_id").agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))
        none = F.lit(None).cast(nodes.schema["node_id"].dataType)
        if method == "fem":
            return points.select("id").join(sums, "id", "left").select("id", "elem_id", none.alias("node_id"), *values)
        out, rest = sums.select("id", "elem_id", none.alias("node_id"), *values), points.join(sums.select("id"), "id", "left_anti")
    near = nearest_points(nodes.select(F.col("node_id").alias("id"), *AXES), rest.select(F.col("id").alias("query"), *AXES), 1, AXES)
    near = near.select(F.col("query").alias("id"), F.lit(None).cast(elements.schema["elem_id"].dataType).alias("elem_id"), F.col("id").alias("node_id")).join(field.select("node_id", *values), "node_id").select("id", "elem_id", "node_id", *values)
    return near if out is None else out.unionByName(near)
