"""Planar arrangements of many polygons at once: repair by the even-odd rule, joins, intersections, differences, complements.

Polygons are vertex tables (id, ring, pt_no, x, y); every id is a set of its own. Segments are split wherever they meet (found in
grid cells), pieces that lie on each other cancel by parity, faces are the cycles of half-edges that keep to their left, traced by
pointer jumping, and one ray for each face tells on which side of the operands it lies. Result: (id, polygon, ring, pt_no, x, y),
ring 0 the outer one, counter-clockwise, the others holes, clockwise; every ring starts at its least vertex by (x, y).

Coordinates are whole multiples of 10^-digits (snapped), so equal points are equal and pieces match exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospan.session import stored

#: Columns and rows of the grid over one id at most; both grow with the root of its segments up to here, so that a cell has some of them:
#: with fewer a segment is listed, and moved, in many cells.
MOST_CELLS, A_CELL = 4096, 16
#: Links that a task follows together.
LARGE = 1 << 17
#: What lies inside, from inside the first and inside the second operand.
RULES = {"join": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a & ~b, "symmetric": lambda a, b: a != b, "complement": lambda a, b: ~a}


def segments(rings: DataFrame, side: int = 0) -> DataFrame:
    """(id, side, x0, y0, x1, y1): each vertex with the next one of its ring, closed."""
    w = Window.partitionBy("id", "ring").orderBy("pt_no")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return rings.select("id", F.lit(side).alias("side"), F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1"))


def _cancelled(pieces: DataFrame) -> DataFrame:
    """Pieces (id, ax, ay, bx, by, a, b) whichever way round they run, added up by parity; those that cancel on both sides go."""
    turn = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    ends = [F.when(turn, F.col(q)).otherwise(F.col(p)).alias(p) for p, q in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))]
    p = pieces.where("ax <> bx or ay <> by").select("id", *ends, "a", "b").groupBy("id", "ax", "ay", "bx", "by")
    return p.agg((F.sum("a") % 2).alias("a"), (F.sum("b") % 2).alias("b")).where("a = 1 or b = 1")


def _frame(edges: DataFrame) -> DataFrame:
    """For each id the corner of its box, and the grid over it: cells a side, and their width and height."""
    box = edges.groupBy("id").agg(F.min("ax").alias("x_lo"), F.max("bx").alias("x_hi"), F.min(F.least("ay", "by")).alias("y_lo"), F.max(F.greatest("ay", "by")).alias("y_hi"), F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(MOST_CELLS), F.ceil(F.sqrt(F.col("n") / A_CELL))).cast("int")
    return box.select("id", "x_lo", "y_lo", k.alias("k"), ((F.col("x_hi") - F.col("x_lo")) / k + 1).alias("cw"), ((F.col("y_hi") - F.col("y_lo")) / k + 1).alias("ch"))


def _cell(v: Column, low: str, size: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("k") - 1, F.floor((v - F.col(low)) / F.col(size)).cast("int")))


def _height(x: Column, p: str = "") -> Column:
    """Where a piece (with the prefix ``p``) is at ``x``."""
    ax, ay, bx, by = (F.col(p + c) for c in ("ax", "ay", "bx", "by"))
    return ay + (by - ay) * F.coalesce(F.try_divide(x - ax, (bx - ax).cast("double")), F.lit(0.0))


def _listed(edges: DataFrame) -> DataFrame:
    """Pieces with the frame of their id, once for every cell they pass within three units of: column by column."""
    pad = 3

    def column(c: Column) -> Column:
        left, right = F.greatest(F.col("ax").cast("double"), F.col("x_lo") + c * F.col("cw") - pad), F.least(F.col("bx").cast("double"), F.col("x_lo") + (c + 1) * F.col("cw") + pad)
        steep = F.col("ax") == F.col("bx")
        one, two = F.when(steep, F.col("ay")).otherwise(_height(left)), F.when(steep, F.col("by")).otherwise(_height(right))
        rows = F.sequence(_cell(F.least(one, two) - pad, "y_lo", "ch"), _cell(F.greatest(one, two) + pad, "y_lo", "ch"))
        return F.transform(rows, lambda r: F.struct(c.alias("c"), r.alias("r")))

    cells = F.flatten(F.transform(F.sequence(_cell(F.col("ax") - pad, "x_lo", "cw"), _cell(F.col("bx") + pad, "x_lo", "cw")), column))
    return edges.join(_frame(edges), "id").withColumn("_at", F.explode(cells)).select("id", "s", "ax", "ay", "bx", "by", F.col("_at.c").alias("c"), F.col("_at.r").alias("r"))


def noded(parts: DataFrame, digits: int = 9) -> DataFrame:
    """Segments (id, side 0 or 1, x0, y0, x1, y1) as pieces (id, e, ax, ay, bx, by, a, b) that meet only at their ends.

    Places are whole numbers of 10^-digits; a and b are 1 where an odd number of segments of that side lie there.
    """
    snap = lambda c: F.round(F.col(c) * 10.0**digits).cast("long")
    sides = [(F.col("side") == k).cast("int").alias(n) for k, n in ((0, "a"), (1, "b"))]
    s = _cancelled(parts.select("id", snap("x0").alias("ax"), snap("y0").alias("ay"), snap("x1").alias("bx"), snap("y1").alias("by"), *sides))
    s = stored(s.withColumn("s", F.monotonically_increasing_id()))
    at = stored(_listed(s))
    other = at.select("id", "c", "r", *(F.col(x).alias(f"o{x}") for x in ("s", "ax", "ay", "bx", "by")))
    both = at.join(other, ["id", "c", "r"]).where("s < os")
    d = lambda c: F.col(c).cast("double")
    ux, uy, vx, vy = d("bx") - d("ax"), d("by") - d("ay"), d("obx") - d("oax"), d("oby") - d("oay")
    wx, wy = d("oax") - d("ax"), d("oay") - d("ay")
    cross = ux * vy - uy * vx
    t, u = F.try_divide(wx * vy - wy * vx, cross), F.try_divide(wx * uy - wy * ux, cross)
    met = both.where(t.between(0, 1) & u.between(0, 1)).select("id", F.round(F.col("ax") + t * ux).cast("long").alias("x"), F.round(F.col("ay") + t * uy).cast("long").alias("y"))
    ends = s.select("id", F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(s.select("id", F.col("bx").alias("x"), F.col("by").alias("y")))
    points = met.unionByName(ends).distinct().join(_frame(s), "id")
    points = points.select("id", "x", "y", _cell(F.col("x"), "x_lo", "cw").alias("c"), _cell(F.col("y"), "y_lo", "ch").alias("r"))
    px, py, size = d("x") - d("ax"), d("y") - d("ay"), ux * ux + uy * uy
    ux, uy = d("bx") - d("ax"), d("by") - d("ay")
    along, off = px * ux + py * uy, px * uy - py * ux
    on = at.join(points, ["id", "c", "r"]).where((off * off <= 2.25 * size) & (along > 0) & (along < size)).where("(x <> ax or y <> ay) and (x <> bx or y <> by)")
    cuts = on.select("s", "x", "y", (along / size).alias("t")).distinct()
    ends = s.select("s", F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(0.0).alias("t")).unionByName(s.select("s", F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(1.0).alias("t")))
    w = Window.partitionBy("s").orderBy("t", "x", "y")
    bits = cuts.unionByName(ends).select("s", F.col("x").alias("_x"), F.col("y").alias("_y"), F.lead("x").over(w).alias("_u"), F.lead("y").over(w).alias("_v")).where("_u is not null")
    bits = bits.join(s.select("s", "id", "a", "b"), "s").select("id", F.col("_x").alias("ax"), F.col("_y").alias("ay"), F.col("_u").alias("bx"), F.col("_v").alias("by"), "a", "b")
    return stored(_cancelled(bits).withColumn("e", F.monotonically_increasing_id()))


def _both(rows: DataFrame, many: DataFrame | None, keep: list[str], *ways: list[Column]) -> DataFrame:
    """Each row twice, one for each of two lists of columns; where no ids are crowded (``many``) after it was moved to the others of its id."""
    rows = rows.repartition("id") if many is None else rows
    return rows.select(*keep, F.inline(F.array(*(F.struct(*w) for w in ways))))


def half_edges(pieces: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """Both ways along each piece: (id, h, twin, ox, oy, tx, ty, a, b)."""
    way = lambda h, o, t: [(F.col("e") * 2 + h).alias("h"), (F.col("e") * 2 + 1 - h).alias("twin"), F.col(f"{o}x").alias("ox"), F.col(f"{o}y").alias("oy"), F.col(f"{t}x").alias("tx"), F.col(f"{t}y").alias("ty")]
    return _both(pieces, many, ["id", "a", "b"], way(0, "a", "b"), way(1, "b", "a"))


def crowded(rows: DataFrame) -> DataFrame | None:
    """Ids with more rows than a task takes together, and over how many keys their vertices are dealt; None if there are none."""
    many = stored(rows.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / LARGE).alias("_many")).where("_many > 1"))
    return None if many.isEmpty() else many


def _next_at(rows: DataFrame, many: DataFrame | None, keys: list[str], *order: Column) -> DataFrame:
    """Rows (id, vx, vy, wx, wy, h, ...) around vertices v with ``nxt``, the h of the row that follows, round and round by the ``angle`` towards w.

    An id's rows are in one task, next to each other, unless it is one of ``many``.
    """
    if many is None:
        r, dealt = rows, []
    else:
        r, dealt = rows.join(F.broadcast(many), "id", "left"), ["_s"]
        r = r.withColumn("_s", F.pmod(F.xxhash64("vx", "vy"), F.coalesce("_many", F.lit(1)))).drop("_many").repartition("id", "_s")
    r = r.withColumn("angle", F.atan2((F.col("wy") - F.col("vy")).cast("double"), (F.col("wx") - F.col("vx")).cast("double")))
    w = Window.partitionBy("id", *dealt, *keys).orderBy(*order, "h")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return r.withColumn("nxt", F.coalesce(F.lead("h").over(w), F.first("h").over(whole))).drop("_s", "angle")


def _incident(half: DataFrame, many: DataFrame | None, *more: str) -> DataFrame:
    """Directed edges at both their ends v, with the other one w."""
    ends = lambda v, w, out: [*(F.col(f"{p}{c}").alias(f"{n}{c}") for p, n in ((v, "v"), (w, "w")) for c in "xy"), F.lit(out).alias("out")]
    return _both(half, many, ["id", "h", *more], ends("o", "t", True), ends("t", "o", False))


def _arriving(rows: DataFrame, *more: str) -> DataFrame:
    """Of rows of :func:`_next_at` the edges that reach v: (id, h, ox, oy, tx, ty, nxt, more)."""
    ends = [F.col(f"{p}{c}").alias(f"{n}{c}") for p, n in (("w", "o"), ("v", "t")) for c in "xy"]
    return rows.where("not out").select("id", "h", *ends, "nxt", *more)


def _closed(h: np.ndarray, nxt: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each link the h of its cycle's least (x, y, h), its place after that, and the cycle's length, which is 0 if it leads out of the links."""
    size, order = len(h), np.argsort(h)
    at = np.minimum(np.searchsorted(h, nxt, sorter=order), size - 1)
    to = np.append(np.where(h[order[at]] == nxt, order[at], size), size)  # the last one stands for all that is elsewhere
    ranked = np.lexsort((h, y, x))
    low, off, span = np.full(size + 1, size), np.zeros(size + 1, np.int64), 1
    low[ranked] = np.arange(size)
    while True:
        further = low[to] < low
        then = to[to]
        if not further.any() and not ((then == size) & (to < size)).any():
            break
        low, off, to = np.where(further, low[to], low), np.where(further, off[to] + span, off), then
        span *= 2
    out = to[:-1] == size
    low, off = low[:-1], off[:-1]
    n = np.where(out, 0, np.bincount(low[~out], minlength=size)[low])
    return h[ranked[low]], np.where(out, 0, (n - off) % np.maximum(n, 1)), n


def cycles(links: DataFrame) -> DataFrame:
    """Links (h, nxt, ox, oy, ...) with ``cycle``, ``pos`` and ``n`` of :func:`traced` instead of ``nxt``.

    Cycles whose links come near each other in one task are closed there, LARGE links or so at a time; what leads out goes on to :func:`traced`.
    """
    names, large = links.columns, LARGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(t: pa.Table) -> tuple[pa.Table, pa.Table]:
            cycle, pos, n = _closed(*(t.column(c).to_numpy() for c in ("h", "nxt", "ox", "oy")))
            for c, v in (("cycle", cycle), ("pos", pos), ("n", n)):
                t = t.append_column(c, pa.array(v, pa.int64()))
            return t.filter(pa.array(n > 0)), t.filter(pa.array(n == 0))

        held, rows, least = [], 0, large
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= least:
                done, left = close(pa.Table.from_batches(held).select(names))
                yield from done.to_batches()
                if left.num_rows >= large:  # more of one id than a task takes
                    yield from left.to_batches()
                    left = left.slice(0, 0)
                held, rows = left.select(names).to_batches(), left.num_rows
                least = large + rows
        if rows:
            for t in close(pa.Table.from_batches(held).select(names)):
                yield from t.to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema.fields)
    found = stored(links.mapInArrow(run, f"{kinds}, cycle long, pos long, n long"))
    left = found.where("n = 0")
    if left.isEmpty():
        return found.drop("nxt")
    rest = left.drop("cycle", "pos", "n").join(traced(left.select("h", "nxt", "ox", "oy")), "h").drop("nxt")
    return stored(found.where("n > 0").drop("nxt").unionByName(rest))


def traced(links: DataFrame) -> DataFrame:
    """Cycles of links (h, nxt, ox, oy): (h, cycle, pos, n). ``cycle`` is the h that starts at the least (ox, oy), where pos is 0.

    Pointer jumping: after k rounds each h knows the least of the 2^k links from it on, how far that is, and the h behind them.
    It ends when no least changes, after the logarithm of the longest cycle.
    """
    t = stored(links.select("h", "nxt", F.struct("ox", "oy", "h").alias("low"), F.lit(0).cast("long").alias("off")))
    span = 1
    while True:
        far = t.select(F.col("h").alias("nxt"), F.col("nxt").alias("then"), F.col("low").alias("_low"), F.col("off").alias("_off"))
        nearer = F.col("low") <= F.col("_low")
        t = t.join(far, "nxt").select("h", F.col("then").alias("nxt"), F.least("low", "_low").alias("low"), F.when(nearer, F.col("off")).otherwise(F.col("_off") + span).alias("off"), (~nearer).alias("moved"))
        t = stored(t)
        span *= 2
        if not t.agg(F.bool_or("moved")).first()[0]:
            break
    n = t.groupBy("low.h").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("h", "cycle")
    return t.select("h", F.col("low.h").alias("cycle"), "off").join(n, "cycle").select("h", "cycle", ((F.col("n") - F.col("off")) % F.col("n")).alias("pos"), "n")


def _strips(edges: DataFrame) -> DataFrame:
    """Pieces that are not upright, once for every column of their id's grid."""
    e = edges.where("ax <> bx").join(_frame(edges), "id")
    return e.withColumn("c", F.explode(F.sequence(_cell(F.col("ax"), "x_lo", "cw"), _cell(F.col("bx"), "x_lo", "cw")))).drop("x_lo", "y_lo", "k", "cw", "ch")


def _below(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points (id, x, y, ...) with each piece straight below: half-open in x, so one of two that share an end counts."""
    p = points.join(_frame(edges), "id").withColumn("c", _cell(F.col("x"), "x_lo", "cw")).drop("x_lo", "y_lo", "k", "cw", "ch")
    j = p.join(_strips(edges), ["id", "c"]).where("ax <= x and x < bx")
    return j.withColumn("_h", _height(F.col("x"))).where("_h < y")


def faces(pieces: DataFrame, many: DataFrame | None = None) -> DataFrame:
    """(id, h, ..., cycle, pos, in_a, in_b): half-edges, the cycle they lie on, and whether what is to its left is inside each side.
    ``many`` as :func:`crowded` gives it."""
    around = half_edges(pieces, many).withColumnsRenamed({"ox": "vx", "oy": "vy", "tx": "wx", "ty": "wy"})
    turned = _next_at(around, many, ["vx", "vy"], F.desc("angle"))
    twins = {"twin": "h", "h": "twin", "wx": "ox", "wy": "oy", "vx": "tx", "vy": "ty"}  # the twin of what leaves a vertex reaches it
    half = cycles(turned.select("id", *(F.col(c).alias(n) for c, n in twins.items()), "a", "b", "nxt"))
    one = half.where("ox <> tx").groupBy("id", "cycle").agg(F.min(F.struct("h", "ox", "oy", "tx", "ty", "a", "b")).alias("r"))
    up = F.col("r.tx") > F.col("r.ox")
    mid = lambda p, q: (F.col(p) + F.col(q)) / 2.0
    rays = one.select("id", "cycle", mid("r.ox", "r.tx").alias("x"), mid("r.oy", "r.ty").alias("y"), F.shiftright("r.h", 1).alias("own"), *(F.when(up, F.col(f"r.{c}")).otherwise(0).alias(f"own_{c}") for c in "ab"))
    under = _below(rays, pieces).where("e <> own").groupBy("cycle").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    inside = [((F.coalesce(f"n_{c}", F.lit(0)) + F.col(f"own_{c}")) % 2 == 1).alias(f"in_{c}") for c in "ab"]
    return half.join(rays.join(under, "cycle", "left").select("cycle", *inside), "cycle")


def outlines(pieces: DataFrame, rule: str | None = None, digits: int = 9) -> DataFrame:
    """Rings around what ``rule`` says is inside, from noded pieces; without a rule, around the inside of the first side."""
    f = RULES[rule] if rule else lambda a, b: a
    many = crowded(pieces)
    sides = faces(pieces, many).withColumn("_in", f(F.col("in_a"), F.col("in_b")))
    right = sides.select(F.col("h").alias("twin"), F.col("_in").alias("_right"))
    half = sides.join(right, "twin").where("_in and not _right").select("id", "h", "ox", "oy", "tx", "ty", F.col("cycle").alias("face"))
    half = stored(half)
    if rule:  # pieces within the result have gone, so its faces are larger
        half = cycles(_arriving(_next_at(_incident(half, many), many, ["vx", "vy"], F.desc("angle")))).drop("pos", "n").withColumnRenamed("cycle", "face")
    # where a face meets itself at a vertex, its outline is cut into rings there: each goes round one part of what is outside
    half = cycles(_arriving(_next_at(_incident(half, many, "face"), many, ["face", "vx", "vy"], F.asc("angle")), "face"))
    # about the ring's first vertex, so that products stay small
    scale = 10.0**digits
    start = half.where("pos = 0").select("cycle", F.col("ox").alias("sx"), F.col("oy").alias("sy"))
    p = lambda c, s: (F.col(c) - F.col(s)) / scale
    loops = half.join(start, "cycle").groupBy("id", "face", "cycle", "sx", "sy").agg((F.sum(p("ox", "sx") * p("ty", "sy") - p("tx", "sx") * p("oy", "sy")) / 2).alias("area"))
    loops = stored(loops)
    outer = loops.where("area > 0").select("face").distinct().withColumn("top", F.lit(True))
    alone = loops.join(outer, "face", "left_anti").groupBy("id", "face").agg(F.min(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))).alias("p")).select("id", "face", "p.*")
    right_way = (F.col("tx") > F.col("ox")) | ((F.col("tx") == F.col("ox")) & (F.col("ty") > F.col("oy")))
    ends = [F.when(right_way, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("ax", "ox", "tx"), ("ay", "oy", "ty"), ("bx", "tx", "ox"), ("by", "ty", "oy"))]
    slope = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    under = _below(alone, half.select("id", F.col("face").alias("up"), *ends)).groupBy("face").agg(F.max_by("up", F.struct("_h", slope.alias("slope"))).alias("up"))
    links = stored(alone.select("face").join(under, "face", "left").select("face", "up", F.lit(False).alias("more")))
    while True:  # holes above holes: each points at a lower one, until one points at a face with an outer ring
        tops = links.select(F.col("face").alias("up"), F.col("up").alias("then"), F.lit(True).alias("more"))
        links = stored(links.drop("more").join(tops, "up", "left").select("face", F.when(F.col("more"), F.col("then")).otherwise(F.col("up")).alias("up"), F.coalesce("more", F.lit(False)).alias("more")))
        if not links.agg(F.bool_or("more")).first()[0]:
            break
    loops = loops.join(links.select("face", "up", F.lit(True).alias("hole")), "face", "left").withColumn("owner", F.when(F.col("hole"), F.col("up")).otherwise(F.col("face")))
    first = loops.where("area > 0").select("id", F.col("face").alias("owner"), F.row_number().over(Window.partitionBy("id").orderBy("sx", "sy", "cycle")).alias("polygon"))
    loops = loops.join(first, ["id", "owner"], "left").withColumn("polygon", F.coalesce(F.col("polygon") - 1, F.lit(-1)))
    hole = (F.col("area") < 0).cast("int")
    loops = loops.withColumn("ring", F.row_number().over(Window.partitionBy("id", "polygon").orderBy(hole, "sx", "sy", "cycle")) - F.when(F.col("polygon") < 0, 0).otherwise(1))
    # vertices at which nothing turns are left out where no two rings meet
    meets = half.groupBy("id", "ox", "oy").agg(F.count(F.lit(1)).alias("meets"))
    w = Window.partitionBy("cycle").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = [F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) for c in ("ox", "oy")]
    v = half.withColumn("_px", before[0]).withColumn("_py", before[1]).join(meets, ["id", "ox", "oy"])
    d = lambda p, q: (F.col(p) - F.col(q)).cast("double")
    turn, size = d("ox", "_px") * d("ty", "_py") - d("oy", "_py") * d("tx", "_px"), F.pow(d("tx", "_px"), 2) + F.pow(d("ty", "_py"), 2)
    v = v.where((F.col("meets") > 1) | (turn * turn > 9 * size))
    out = v.join(loops.select("cycle", "polygon", "ring"), "cycle")
    number = F.row_number().over(Window.partitionBy("cycle").orderBy("pos")) - 1
    return out.select("id", F.col("polygon").cast("int").alias("polygon"), F.col("ring").cast("int").alias("ring"), number.alias("pt_no"), (F.col("ox") / scale).alias("x"), (F.col("oy") / scale).alias("y"))


def repaired(rings: DataFrame, digits: int = 9) -> DataFrame:
    """Polygons with any crossings, overlaps, spikes and repeated edges as valid ones, by the even-odd rule over all rings of an id."""
    return outlines(noded(segments(rings), digits), digits=digits)


def overlaid(a: DataFrame, b: DataFrame, rule: str, digits: int = 9) -> DataFrame:
    """Join, intersection, difference or symmetric difference of the polygons of ``a`` and ``b`` with equal ids, each taken by the even-odd rule.

    An id that only one of them has is combined with nothing.
    """
    return outlines(noded(segments(a, 0).unionByName(segments(b, 1)), digits), rule, digits)


def complement(rings: DataFrame, digits: int = 9) -> DataFrame:
    """What is outside: rings of the part without an outer ring have polygon -1 and are numbered from 1."""
    return outlines(noded(segments(rings), digits), "complement", digits)
