"""Distances between rays, segments, lines and triangles, weights of mesh edges, and votes of decision trees, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerospan.functions.numeric import in_triangle, point_segment, side

Point = list[Column]


def _dot(a: Point, b: Point) -> Column:
    return reduce(lambda s, x: s + x, [x * y for x, y in zip(a, b, strict=True)])


def _minus(a: Point, b: Point) -> Point:
    return [x - y for x, y in zip(a, b, strict=True)]


def _cross(a: Point, b: Point) -> Point:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def point_ray(p: Point, start: Point, along: Point) -> Column:
    """Squared distance of a point to a ray, in any number of dimensions: to its start where the foot lies behind it."""
    off = _minus(p, start)
    t = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(_dot(off, along), _dot(along, along)), F.lit(0.0)))
    gap = [o - t * d for o, d in zip(off, along, strict=True)]
    return _dot(gap, gap)


def segment_segment(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Squared distance of the segments a-b and c-d of the plane: zero where they cross, else from an end of one to the other."""
    crossing = (side(*a, *b, *c) * side(*a, *b, *d) < 0) & (side(*c, *d, *a) * side(*c, *d, *b) < 0)
    return F.when(crossing, 0.0).otherwise(F.least(point_segment(*a, *c, *d), point_segment(*b, *c, *d), point_segment(*c, *a, *b), point_segment(*d, *a, *b)))


def line_line(p: Point, u: Point, q: Point, v: Point) -> Column:
    """Squared distance of the lines p + t u and q + t v in space; parallel lines by the distance of q to the first."""
    n, off = _cross(u, v), _minus(q, p)
    apart, beside = _dot(n, off), _cross(u, off)
    return F.coalesce(F.try_divide(apart * apart, _dot(n, n)), F.try_divide(_dot(beside, beside), _dot(u, u)))


def point_triangle(p: Point, corners: list[Point]) -> Column:
    """Squared distance of a point of the plane to a triangle: zero inside."""
    a, b, c = corners
    inside = in_triangle(p[0], p[1], [(x[0], x[1]) for x in corners])
    return F.when(inside, 0.0).otherwise(F.least(point_segment(*p, *a, *b), point_segment(*p, *b, *c), point_segment(*p, *c, *a)))


def three_point_weight(q: Point, before: Point, at: Point, after: Point, power: int) -> Column:
    """Weight at q of the polygon vertex ``at`` between its neighbours: power 0, 1 and 2 give the Wachspress, mean value and discrete
    harmonic weights up to a common factor. Null where q lies on one of the two edges' lines."""
    size = lambda x: F.pow(F.sqrt(_dot(_minus(x, q), _minus(x, q))), F.lit(float(power)))
    area = lambda x, y: side(*x, *y, *q) / 2
    left, right, both = area(before, at), area(at, after), area(before, after)
    return F.try_divide(size(after) * left - size(at) * both + size(before) * right, left * right)


def cotangent(p: Point, q: Point, r: Point) -> Column:
    """Cotangent of the angle at q, in space; null where the three lie on a line."""
    a, b = _minus(p, q), _minus(r, q)
    n = _cross(a, b)
    return F.try_divide(_dot(a, b), F.sqrt(_dot(n, n)))


def tree_votes(nodes: dict[int, tuple], features: Column, root: int = 0) -> Column:
    """Votes of the leaf that a row's features lead to. ``nodes``: number -> (feature, threshold, left, right), left where the feature is
    below the threshold, or (votes,) for a leaf. The tree is one expression, so its size is bounded by the model's."""
    node = nodes[root]
    if len(node) == 1:
        return F.array(*(F.lit(float(v)) for v in node[0]))
    feature, threshold, left, right = node
    return F.when(F.get(features, F.lit(feature)) < threshold, tree_votes(nodes, features, left)).otherwise(tree_votes(nodes, features, right))


def forest_votes(trees: list[dict[int, tuple]], features: Column) -> Column:
    """Mean votes of the trees, class by class."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [tree_votes(t, features) for t in trees])
    return F.transform(total, lambda v: v / len(trees))
