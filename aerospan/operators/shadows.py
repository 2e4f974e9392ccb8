"""What a city shows to the flow: the union of its buildings' shadows on a plane across it, against the domain's section."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.session import stored


def numbered(values: DataFrame, by: str, name: str) -> DataFrame:
    """``values`` with their place in ascending order from 0, by a range shuffle and a count a partition; one row a value is expected."""
    at = stored(values.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["task"], r["count"]) for r in at.groupBy(task.alias("task")).count().collect())  # a row a partition
    before, total = {}, 0
    for t, n in counts:
        before[t], total = total, total + n
    if not before:
        return at.select(*values.columns, F.lit(0).cast("long").alias(name))
    base = F.create_map(*(F.lit(v) for pair in before.items() for v in pair))
    return at.select(*values.columns, (base[task] + row).cast("long").alias(name))


def shadows(rings: DataFrame, heights: DataFrame, degrees: float) -> DataFrame:
    """(id, lo, hi, height): the extent of prisms over rings (id, x, y) across a flow along ``degrees``, and their heights (id, height)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    across = F.col("y").cast("double") * c - F.col("x").cast("double") * s
    return rings.groupBy("id").agg(F.min(across).alias("lo"), F.max(across).alias("hi")).join(heights.select("id", F.col("height").cast("double").alias("height")), "id")


def skyline(shadows: DataFrame) -> DataFrame:
    """(lo, hi, height): the outline of shadows that all stand on the ground, as stretches between their ends; stretches without any are left out.

    Ends are numbered in order. A shadow covers a run of the stretches between them and is split into the largest pieces of 2^k stretches that
    start at a multiple of 2^k, so it has at most two of each size. Of equal pieces the highest stays. A stretch then looks at the one piece of
    each size that holds it. No task holds more than its rows, however many shadows cover a place or share an end.
    """
    s = shadows.where("lo < hi and height > 0").groupBy("lo", "hi").agg(F.max("height").alias("height"))
    ends = stored(numbered(s.select(F.explode(F.array("lo", "hi")).alias("at")).distinct(), "at", "k"))
    count = ends.count()
    if not count:
        return s
    bits = max(1, (count - 1).bit_length())
    runs = s.join(ends.select(F.col("at").alias("lo"), F.col("k").alias("a")), "lo").join(ends.select(F.col("at").alias("hi"), F.col("k").alias("b")), "hi")
    # of [a, b) at size k: a's piece, if a is odd in steps of 2^k, and the one before b, if b is; then both move to even steps
    up = lambda k: F.shiftright(F.col("a") + (1 << k) - 1, k)
    down = lambda k: F.shiftright(F.col("b"), k)
    odd = lambda v: v.bitwiseAND(F.lit(1)) == 1
    piece = lambda k, n: F.struct(F.lit(k).alias("size"), n.cast("long").alias("n"))
    found = [F.when((up(k) < down(k)) & odd(up(k)), piece(k, up(k))) for k in range(bits + 1)] + [F.when((up(k) < down(k)) & odd(down(k)), piece(k, down(k) - 1)) for k in range(bits + 1)]
    pieces = runs.select("height", F.explode(F.filter(F.array(*found), lambda p: p.isNotNull())).alias("p"))
    tops = pieces.groupBy("p.size", "p.n").agg(F.max("height").alias("height"))
    after = ends.select((F.col("k") - 1).alias("k"), F.col("at").alias("hi"))
    stretches = ends.select("k", F.col("at").alias("lo")).join(after, "k")
    holds = stretches.select("k", "lo", "hi", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda z: F.floor(F.col("k") / F.pow(F.lit(2.0), z)).cast("long"))).alias("size", "n"))
    return holds.join(tops, ["size", "n"]).groupBy("k", "lo", "hi").agg(F.max("height").alias("height")).drop("k")


def blockage_ratio(rings: DataFrame, heights: DataFrame, domain: DataFrame, top: float, degrees: float) -> DataFrame:
    """One row (area, section, ratio): the union of the buildings' shadows within the domain's, the domain's section across the flow, and their ratio.

    ``domain`` is a ring (x, y) that reaches from the ground to ``top``; buildings count as far as they stand within its extent and below its top.
    """
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    across = F.col("y").cast("double") * c - F.col("x").cast("double") * s
    box = domain.agg(F.min(across).alias("_lo"), F.max(across).alias("_hi"))  # one row
    seen = shadows(rings, heights, degrees).crossJoin(F.broadcast(box))
    seen = seen.select(F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"), F.least("height", F.lit(float(top))).alias("height"))
    area = skyline(seen).agg(F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("height")), F.lit(0.0)).alias("area"))
    section = ((F.col("_hi") - F.col("_lo")) * float(top)).alias("section")
    return area.crossJoin(F.broadcast(box)).select("area", section).withColumn("ratio", F.try_divide("area", "section"))
