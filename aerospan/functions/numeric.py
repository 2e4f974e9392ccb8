"""Scalar mathematics: wind, rounding, polynomials, quadrature, bunching, colours, distances, Hilbert order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def wind(u: Column, v: Column, w: Column | None = None) -> tuple[Column, Column]:
    """Speed and direction (radians) of a wind vector."""
    square = u * u + v * v + (w * w if w is not None else F.lit(0.0))
    return F.sqrt(square), F.atan2(v, u)


def truncate(x: Column, digits: int = 6) -> Column:
    """Round to ``digits`` decimals, halves to even."""
    return F.rint(x * 10**digits) / 10**digits


def without_nan(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def legendre(p: int, x: Column, order: int = 0) -> Column:
    """Legendre polynomial of degree ``p``, or its derivative of ``order``, by powers of (x - 1) / 2."""
    half, out = (x - 1) / 2, F.lit(0.0)
    for k in range(order, p + 1):
        c = math.comb(p, k) * math.comb(p + k, k) * math.prod(range(k - order + 1, k + 1)) / 2**order
        power = F.lit(1.0)
        for _ in range(k - order):
            power = power * half
        out = out + c * power
    return out


def polynomial(r: Column, coefficients: np.ndarray) -> Column:
    """A polynomial by its coefficients, lowest power first, as nested products."""
    out = F.lit(0.0)
    for c in reversed(coefficients.tolist()):
        out = out * r + c
    return out


def basis(k: int, nodes: list[float]) -> np.ndarray:
    """Coefficients of the polynomial that is one at node ``k`` and zero at the others."""
    others = np.delete(np.asarray(nodes, float), k)
    powers = np.polynomial.polynomial.polyfromroots(others)
    return powers / np.polynomial.polynomial.polyval(nodes[k], powers)


def lagrange(r: Column, k: int, nodes: list[float]) -> Column:
    """The polynomial of :func:`basis` at ``r``."""
    return polynomial(r, basis(k, nodes))


def lagrange_slope(r: Column, k: int, nodes: list[float]) -> Column:
    """Derivative of :func:`lagrange`."""
    return polynomial(r, np.polynomial.polynomial.polyder(basis(k, nodes)))


def lobatto(p: int) -> tuple[list[float], list[float]]:
    """Gauss-Lobatto nodes and weights with ``p`` points: first, last, then the interior ones ascending."""
    poly = np.polynomial.legendre.Legendre.basis(p - 1)
    inner = np.sort(np.real(poly.deriv().roots())) if p > 2 else np.zeros(0)
    inner[np.abs(inner) < 1e-15] = 0.0
    x = np.concatenate([[-1.0, 1.0], inner])
    return x.tolist(), (2 / (p * (p - 1) * poly(x) ** 2)).tolist()


def bunching(c: Column, height: float, strength: float) -> Column:
    """Points crowded towards both ends of 0..height."""
    return F.lit(height / 2) * (1 + F.tanh(strength * (2 * c / height - 1)) / math.tanh(strength))


def blend_weight(k: Column, overlap: int, factor: float) -> Column:
    """Decaying weight of place ``k`` of an overlap."""
    return F.exp(-factor * (k / (overlap - 1) if overlap > 1 else F.lit(0.0)))


def angle(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two vectors; null if one is zero."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    size = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((x * x for x in b), F.lit(0.0)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, size)))))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment: to the nearer end where the foot lies outside."""
    dx, dy = bx - ax, by - ay
    along = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - ax - t * dx, py - ay - t * dy
    return ex * ex + ey * ey


def point_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to the line through a and b."""
    c = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return F.try_divide(c * c, (bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def point_plane(p: list[Column], n: list[Column], d: Column) -> Column:
    """Squared distance of a point to the plane n . x + d = 0."""
    value = sum((x * y for x, y in zip(p, n, strict=True)), d)
    return F.try_divide(value * value, sum((x * x for x in n), F.lit(0.0)))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive if p lies left of a -> b, zero on the line."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def in_triangle(px: Column, py: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Inside or on the edge: not on both strict sides."""
    (ax, ay), (bx, by), (cx, cy) = corners
    s = [side(ax, ay, bx, by, px, py), side(bx, by, cx, cy, px, py), side(cx, cy, ax, ay, px, py)]
    some_left = (s[0] > 0) | (s[1] > 0) | (s[2] > 0)
    some_right = (s[0] < 0) | (s[1] < 0) | (s[2] < 0)
    return ~(some_left & some_right)


def triangle_area(p: list[Column], q: list[Column], r: list[Column]) -> Column:
    """Area of a triangle in space."""
    a, b = [y - x for x, y in zip(p, q, strict=True)], [y - x for x, y in zip(p, r, strict=True)]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.sqrt(sum((x * x for x in c), F.lit(0.0))) / 2


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0-360, saturation and value 0-100 of channels 0-255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    turn = F.when(span == 0, 0.0).when(top == r, F.pmod(F.try_divide(g - b, span), F.lit(6.0))).when(top == g, F.try_divide(b - r, span) + 2).otherwise(F.try_divide(r - g, span) + 4)
    return 60 * turn, F.when(top == 0, 0.0).otherwise(F.try_divide(100 * span, top)), top / 255 * 100


def verticality(nx: Column, ny: Column, nz: Column, up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> Column:
    return 1 - F.abs(nx * up[0] + ny * up[1] + nz * up[2])


def next_power_of_two(n: Column) -> Column:
    """The least power of two that is at least ``n``."""
    less, bits = n - 1, F.lit(0)
    for k in range(62):
        bits = bits + F.when(F.shiftright(less, k) > 0, 1).otherwise(0)
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2.0), bits).cast("long"))


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Place along the Hilbert curve of integer cell (x, y), both below 2^bits."""
    top = (1 << bits) - 1
    start = F.struct(F.lit(0).cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        one = F.lit(1).cast("long")
        rx, ry = (F.call_function("shiftright", s[c], k).bitwiseAND(one) for c in ("x", "y"))
        d = s["d"] + F.call_function("shiftleft", (3 * rx).bitwiseXOR(ry), 2 * k)
        mx, my = (F.when((ry == 0) & (rx == 1), top - s[c]).otherwise(s[c]) for c in ("x", "y"))
        return F.struct(d.alias("d"), F.when(ry == 0, my).otherwise(mx).alias("x"), F.when(ry == 0, mx).otherwise(my).alias("y"))

    return F.aggregate(F.array(*(F.lit(k) for k in range(bits - 1, -1, -1))), start, step)["d"]
