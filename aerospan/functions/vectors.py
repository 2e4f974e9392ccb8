"""Vector and tensor algebra on array columns, unrolled to plain arithmetic so that it stays in generated code.

Vectors have 3 entries, tensors 9 in row-major order (entry ``3 * i + j``). All functions take and return columns.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def comp(a: Column, k: int) -> Column:
    return F.get(a, F.lit(k))


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return total([comp(a, k) * comp(b, k) for k in range(n)])


def cross(a: Column, b: Column) -> Column:
    pairs = ((1, 2), (2, 0), (0, 1))
    return F.array(*(comp(a, i) * comp(b, j) - comp(a, j) * comp(b, i) for i, j in pairs))


def outer(a: Column, b: Column) -> Column:
    return F.array(*(comp(a, i) * comp(b, j) for i in range(3) for j in range(3)))


def scale(k: Column | float, a: Column) -> Column:
    """Scalar times a vector or tensor of any size."""
    factor = F.lit(k) if isinstance(k, (int, float)) else k
    return F.transform(a, lambda x: factor * x)


def vector_tensor(a: Column, b: Column) -> Column:
    """Entry i is the sum over j of a_j B_ji."""
    return F.array(*(total([comp(a, j) * comp(b, 3 * j + i) for j in range(3)]) for i in range(3)))


def tensor_vector(a: Column, b: Column) -> Column:
    """Entry i is the sum over j of A_ij b_j."""
    return F.array(*(total([comp(a, 3 * i + j) * comp(b, j) for j in range(3)]) for i in range(3)))


def norm(a: Column, n: int = 3) -> Column:
    return F.sqrt(dot(a, a, n))


def rotation(gamma: float, beta: float, alpha: float) -> list[float]:
    """Row-major matrix of a rotation given by three angles in degrees, for row vectors."""
    g, b, a = (math.radians(x) for x in (gamma, beta, alpha))
    rz = [[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]]
    ry = [[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]]
    rx = [[1, 0, 0], [0, math.cos(g), math.sin(g)], [0, -math.sin(g), math.cos(g)]]
    mul = lambda x, y: [[sum(x[i][k] * y[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return [v for row in mul(rx, mul(ry, rz)) for v in row]


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def rotate(a: Column, gamma: float, beta: float, alpha: float, center: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """Rotate a vector about ``center``."""
    moved = F.array(*(comp(a, k) - center[k] for k in range(3)))
    turned = vector_tensor(moved, literal(rotation(gamma, beta, alpha)))
    return F.array(*(comp(turned, k) + center[k] for k in range(3)))


def identity() -> Column:
    return literal([1, 0, 0, 0, 1, 0, 0, 0, 1])


def transpose(a: Column, n: int = 3) -> Column:
    return F.array(*(comp(a, n * j + i) for i in range(n) for j in range(n)))


def trace(a: Column) -> Column:
    return comp(a, 0) + comp(a, 4) + comp(a, 8)


def _minor(a: Column, i: int, j: int) -> Column:
    (r, s), (c, d) = ([k for k in range(3) if k != x] for x in (i, j))
    return comp(a, 3 * r + c) * comp(a, 3 * s + d) - comp(a, 3 * r + d) * comp(a, 3 * s + c)


def det(a: Column) -> Column:
    return total([(-1) ** j * comp(a, j) * _minor(a, 0, j) for j in range(3)])


def inverse(a: Column) -> Column:
    """Adjugate over determinant; null for a singular tensor."""
    d = det(a)
    return F.when(d != 0, F.array(*((-1) ** (i + j) * F.try_divide(_minor(a, j, i), d) for i in range(3) for j in range(3))))


def matmul(a: Column, b: Column) -> Column:
    return F.array(*(total([comp(a, 3 * i + k) * comp(b, 3 * k + j) for k in range(3)]) for i in range(3) for j in range(3)))


def double_dot(a: Column, b: Column) -> Column:
    return dot(a, b, 9)


def triple_dot(a: Column, b: Column, c: Column) -> Column:
    """A_ij B_jk C_ki."""
    return trace(matmul(matmul(a, b), c))


def quadruple_dot(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A_ij B_jk C_kl D_li."""
    return trace(matmul(matmul(a, b), matmul(c, d)))


def tensor_norm(a: Column) -> Column:
    return norm(a, 9)


def tensor_rotate(a: Column, gamma: float, beta: float, alpha: float) -> Column:
    """One-sided: the rotation matrix times the tensor."""
    return matmul(literal(rotation(gamma, beta, alpha)), a)


def eigenvalues(a: Column) -> Column:
    """Of a symmetric tensor, ascending, in closed form; the lower triangle is used."""
    x, y, z = comp(a, 0), comp(a, 4), comp(a, 8)
    p, q, r = comp(a, 3), comp(a, 6), comp(a, 7)
    mean = (x + y + z) / 3
    off = p * p + q * q + r * r
    size = F.sqrt(((x - mean) * (x - mean) + (y - mean) * (y - mean) + (z - mean) * (z - mean) + 2 * off) / 6)
    b = [F.coalesce(F.try_divide(v, size), F.lit(0.0)) for v in (x - mean, y - mean, z - mean, p, q, r)]
    half = (b[0] * (b[1] * b[2] - b[5] * b[5]) - b[3] * (b[3] * b[2] - b[5] * b[4]) + b[4] * (b[3] * b[5] - b[1] * b[4])) / 2
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    high = mean + 2 * size * F.cos(angle)
    low = mean + 2 * size * F.cos(angle + 2 * math.pi / 3)
    return F.array(low, 3 * mean - high - low, high)


def combine(a: float, x: Column, b: float, y: Column) -> Column:
    """a x + b y of two numbers."""
    return F.lit(a) * x + F.lit(b) * y


def combine_arrays(a: float, x: Column, b: float, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: F.lit(a) * u + F.lit(b) * v)


def _with_nan(x: Column, y: Column, pick: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), F.lit(float("nan"))).otherwise(pick)


def at_least(a: Column, floor: float) -> Column:
    """Entries below ``floor`` become it; NaN stays."""
    return F.transform(a, lambda x: _with_nan(x, F.lit(floor), F.greatest(x, F.lit(floor))))


def at_most(a: Column, ceiling: float) -> Column:
    return F.transform(a, lambda x: _with_nan(x, F.lit(ceiling), F.least(x, F.lit(ceiling))))


def largest(a: Column, b: Column) -> Column:
    """Entry by entry; NaN wins."""
    return F.zip_with(a, b, lambda x, y: _with_nan(x, y, F.greatest(x, y)))


def smallest(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _with_nan(x, y, F.least(x, y)))


def kronecker(i: Column, j: Column) -> Column:
    return F.when(i == j, F.lit(1)).otherwise(F.lit(0))


def alternating(i: Column, j: Column, k: Column) -> Column:
    """The permutation sign of indices 1 to 3; zero if two are equal."""
    return ((i - j) * (j - k) * (k - i) / 2).cast("int")


def schur(a: Column) -> Column:
    """Real Schur form of a general tensor as struct(s, q), a complex pair first, then the real eigenvalue.

    There is no closed form in expressions; this runs NumPy on whole Arrow batches. A tensor with a null or a value that isn't finite gives nulls.
    """
    @F.pandas_udf("s array<double>, q array<double>")
    def run(column: pd.Series) -> pd.DataFrame:
        good = np.array([x is not None and len(x) == 9 and all(v is not None and math.isfinite(v) for v in x) for x in column], bool)
        out = {n: np.full(len(column), None, object) for n in "sq"}
        if good.any():
            for n, m in zip("sq", real_schur(np.array(column[good].tolist(), float).reshape(-1, 3, 3)), strict=True):
                out[n][good] = pd.Series(list(m.reshape(-1, 9))).to_numpy()
        return pd.DataFrame(out)

    return run(a)


def real_schur(values: np.ndarray | list[float]) -> tuple[np.ndarray, np.ndarray]:
    """S and Q, each (n, 3, 3), with A = Q S Q^T for one tensor or a batch of them, the real eigenvalue last: its eigenvector is deflated, the rest is a 2 x 2 block."""
    a = np.asarray(values, float).reshape(-1, 3, 3)
    each, t = np.arange(len(a)), lambda m: m.transpose(0, 2, 1)
    w, v = np.linalg.eig(t(a))  # a left eigenvector spans what the leading block leaves out
    last = np.real(v[each, :, np.abs(w.imag).argmin(axis=1)])
    q = np.linalg.qr(np.concatenate([last[:, :, None], np.broadcast_to(np.eye(3), a.shape)], axis=2))[0][:, :, [1, 2, 0]]
    w2, v2 = np.linalg.eig((t(q) @ a @ q)[:, :2, :2])
    u = np.real(v2[each, :, w2.real.argmin(axis=1)])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    turn = np.broadcast_to(np.eye(3), a.shape).copy()
    real = np.abs(w2.imag).max(axis=1) < 1e-12  # the block becomes triangular too
    turn[real, :2, :2] = np.stack([u, np.stack([-u[:, 1], u[:, 0]], axis=1)], axis=2)[real]
    q = q @ turn
    return t(q) @ a @ q, q
