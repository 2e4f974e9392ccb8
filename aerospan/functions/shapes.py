"""Shape functions of elements, straight-edged or of higher degree, and the points at which their integrals are summed, as NumPy arrays."""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np

from aerospan.functions.numeric import basis


def _lines(*counts: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss points and weights of a product of lines -1..1."""
    rules = [np.polynomial.legendre.leggauss(n) for n in counts]
    points = np.array(list(product(*(x for x, _ in rules))))
    return points, np.prod(list(product(*(w for _, w in rules))), axis=1)


def _box(points: np.ndarray, signs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Products of (1 +- x) / 2 over the axes, one for each corner, with slopes."""
    factor = (1 + points[:, None, :] * np.array(signs)) / 2
    slope = np.repeat((np.array(signs) / 2)[None], len(points), 0)
    slopes = [np.prod(np.where(np.arange(points.shape[1]) == d, slope, factor), axis=2) for d in range(points.shape[1])]
    return np.prod(factor, axis=2), np.stack(slopes, axis=2)


def _simplex(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = points.shape[1]
    slopes = np.vstack([-np.ones((1, dim)), np.eye(dim)])
    return np.hstack([1 - points.sum(1, keepdims=True), points]), np.repeat(slopes[None], len(points), 0)


_SQUARE = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
_CUBE = [(*s, z) for z in (-1, 1) for s in _SQUARE]
#: Degree along each axis of the hexahedra with inner nodes.
DEGREES = {39: 2, 40: 3}
_TRIANGLE = np.array([[1, 1], [4, 1], [1, 4]]) / 6, np.full(3, 1 / 6)


def lattice(degree: int) -> np.ndarray:
    """Where each node of a hexahedron of that degree lies, in steps (i, j, k) along its axes: the eight corners, the nodes within the edges of
    the lower and the upper square and those of the upright edges, within faces (across i, j, then k, the lower one first), then inside;
    along each of these the first axis that varies is fastest."""
    d, inner = degree, range(1, degree)
    grid = lambda i, j, k: [(a, b, c) for c in k for b in j for a in i]
    ends = ([0], [d])
    places = [tuple((1 + x) * d // 2 for x in s) for s in _CUBE]
    for k in ends:
        places += grid(inner, [0], k) + grid([d], inner, k) + grid(inner, [d], k) + grid([0], inner, k)
    for i, j, _ in (p for p in places[:4]):
        places += grid([i], [j], inner)
    for axis in range(3):
        for end in ends:
            places += grid(*(end if a == axis else inner for a in range(3)))
    return np.array(places + grid(inner, inner, inner))


@cache
def line(degree: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The Lobatto points of a line -1..1, and coefficients of the polynomials that are one at each of them and none at the others, and of their slopes."""
    inner = np.polynomial.legendre.Legendre.basis(degree).deriv().roots()
    nodes = np.concatenate([[-1.0], np.sort(inner.real), [1.0]])
    ones = [basis(k, nodes.tolist()) for k in range(degree + 1)]
    return nodes, ones, [np.polynomial.polynomial.polyder(c) for c in ones]


def _brick(points: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Products over the axes of the polynomials of :func:`line`, one for each node of :func:`lattice`, with slopes."""
    _, ones, slopes = line(degree)
    at = lambda c: np.stack([np.polynomial.polynomial.polyval(points, x) for x in c], axis=2)
    value, slope, places = at(ones), at(slopes), lattice(degree)
    along = lambda table, axis: table[:, axis, places[:, axis]]
    n = [along(value, a) for a in range(3)]
    return n[0] * n[1] * n[2], np.stack([np.prod([along(slope, a) if a == d else n[a] for a in range(3)], axis=0) for d in range(3)], axis=2)


@cache
def bulge(ltype: int) -> float:
    """How far an element may reach beyond the box around its nodes, in widths of the box. Places are sums of nodes by shape functions, which
    add up to one; the sum of their sizes, a product over the axes, bounds the reach. None for elements of the first degree."""
    if ltype not in DEGREES:
        return 0.0
    x, (_, ones, slopes) = np.linspace(-1, 1, 2001), line(DEGREES[ltype])
    sizes = sum(np.abs(np.polynomial.polynomial.polyval(x, c)) for c in ones)
    steepest = sum(np.abs(np.polynomial.polynomial.polyval(x, c)).max() for c in slopes)
    return float(((sizes.max() + steepest * 0.0005) ** 3 - 1) / 2)  # between the samples it grows by no more than that


@cache
def rule(ltype: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (g), shape functions (g, corners) and slopes (g, corners, axes) at the Gauss points of an element type.

    A pyramid is a cube whose upper face is drawn together, a wedge a triangle times a line. Rules are exact for products of two
    shape functions on elements with parallel faces, and on any hexahedron with straight edges.
    """
    if ltype == 2:
        points, w = _lines(2)
        return w, *_box(points, [(-1,), (1,)])
    if ltype == 10:
        return _TRIANGLE[1], *_simplex(_TRIANGLE[0])
    if ltype == 12:
        points, w = _lines(2, 2)
        return w, *_box(points, _SQUARE)
    if ltype == 30:
        low = (5 - 5**0.5) / 20
        return np.full(4, 1 / 24), *_simplex(np.vstack([np.full(3, low), low + np.eye(3) * (1 - 4 * low)]))
    if ltype == 34:
        z, wz = _lines(2)
        flat, dflat = _simplex(np.repeat(_TRIANGLE[0], len(z), 0))
        up, dup = _box(np.tile(z, (3, 1)), [(-1,), (1,)])
        n = np.hstack([flat * up[:, k : k + 1] for k in (0, 1)])
        slopes = np.concatenate([np.concatenate([dflat * up[:, k, None, None], (flat * dup[:, k])[..., None]], axis=2) for k in (0, 1)], axis=1)
        return np.repeat(_TRIANGLE[1], len(z)) * np.tile(wz, 3), n, slopes
    if ltype in (32, 37):
        points, w = _lines(3, 3, 3)
        n, slopes = _box(points, _CUBE)
        if ltype == 32:
            n, slopes = (np.concatenate([x[:, :4], x[:, 4:].sum(1, keepdims=True)], axis=1) for x in (n, slopes))
        return w, n, slopes
    if ltype in DEGREES:
        points, w = _lines(*[DEGREES[ltype] + 2] * 3)
        return w, *_brick(points, DEGREES[ltype])
    raise ValueError(f"no shape functions for element type {ltype}")


def jacobians(p: np.ndarray, ltype: int) -> tuple[np.ndarray, np.ndarray]:
    """Of elements with corners p (e, corners, 3): slopes of space (e, g, 3, axes), and measure times weight (e, g)."""
    w, _, slopes = rule(ltype)
    j = np.einsum("enc,gnd->egcd", p, slopes)
    if j.shape[-1] == 3:
        size = np.abs(np.linalg.det(j))
    else:
        size = np.linalg.norm(np.cross(j[..., 0], j[..., 1]) if j.shape[-1] == 2 else j[..., 0], axis=-1)
    return j, size * w


def evaluated(ltype: int, xi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shape functions (m, corners) and slopes (m, corners, axes) of an element type at places ``xi`` (m, axes) of its own coordinates."""
    if ltype in (10, 30):
        return _simplex(xi)
    if ltype == 12:
        return _box(xi, _SQUARE)
    if ltype in (32, 37):
        n, slopes = _box(xi, _CUBE)
        return (n, slopes) if ltype == 37 else (np.hstack([n[:, :4], n[:, 4:].sum(1, keepdims=True)]), np.concatenate([slopes[:, :4], slopes[:, 4:].sum(1, keepdims=True)], axis=1))
    if ltype in DEGREES:
        return _brick(xi, DEGREES[ltype])
    if ltype == 34:
        (flat, dflat), (up, dup) = _simplex(xi[:, :2]), _box(xi[:, 2:], [(-1,), (1,)])
        ends = [(up[:, k : k + 1], dup[:, k]) for k in (0, 1)]
        return np.hstack([flat * u for u, _ in ends]), np.concatenate([np.concatenate([dflat * u[..., None], (flat * d)[..., None]], axis=2) for u, d in ends], axis=1)
    raise ValueError(f"no shape functions for element type {ltype}")


#: Element types that can be located in, and where their Newton steps begin.
STARTS = {10: (1 / 3, 1 / 3), 12: (0.0, 0.0), 30: (0.25, 0.25, 0.25), 32: (0.0, 0.0, -0.5), 34: (1 / 3, 1 / 3, 0.0), 37: (0.0, 0.0, 0.0), 39: (0.0, 0.0, 0.0), 40: (0.0, 0.0, 0.0)}


def own_places(ltype: int, p: np.ndarray, at: np.ndarray, tol: float = 1e-9, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """For elements with corners p (m, corners, 3) the shape functions (m, corners) at points ``at`` (m, 3), and which points lie in them.

    Newton steps from the middle until all have settled; straight elements take one. A point off a plane element isn't in it.
    """
    xi, size = np.tile(np.array(STARTS[ltype]), (len(p), 1)), np.linalg.norm(p.max(axis=1) - p.min(axis=1), axis=1)
    left = np.arange(len(p))
    for _ in range(steps):
        n, slopes = evaluated(ltype, xi[left])
        gap, j = at[left] - np.einsum("mk,mkc->mc", n, p[left]), np.einsum("mkc,mka->mca", p[left], slopes)
        square = np.einsum("mca,mcb->mab", j, j)  # on a flat or empty element the step is a least one
        square += np.eye(j.shape[2]) * (1e-14 * np.trace(square, axis1=1, axis2=2) + 1e-300)[:, None, None]
        step = np.linalg.solve(square, np.einsum("mca,mc->ma", j, gap)[..., None])[..., 0]
        new = np.clip(xi[left] + step, -3.0, 3.0)  # a wild step from a bent element comes back
        moved = np.abs(new - xi[left]).max(axis=1) > 1e-13
        xi[left] = new
        left = left[moved]
        if not len(left):
            break
    n, _ = evaluated(ltype, xi)
    met = np.linalg.norm(at - np.einsum("mk,mkc->mc", n, p), axis=1) <= tol * np.maximum(size, 1e-300)
    if ltype in (10, 30):
        inside = (xi >= -tol).all(axis=1) & (xi.sum(axis=1) <= 1 + tol)
    elif ltype == 34:
        inside = (xi[:, :2] >= -tol).all(axis=1) & (xi[:, :2].sum(axis=1) <= 1 + tol) & (np.abs(xi[:, 2]) <= 1 + tol)
    else:
        inside = (np.abs(xi) <= 1 + tol).all(axis=1)
    return n, inside & met
