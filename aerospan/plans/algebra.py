"""Vector, tensor and scalar-function queries over slices of the embeddings and over generated ranges."""

from __future__ import annotations

import math

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.functions import numeric as N
from aerospan.functions import vectors as V
from aerospan.operators.vortices import rigid_rotation
from aerospan.registry import query, rounded, table

#: In SQL: entry k (from 0) of the embedding.
E = "embedding[{}]::DOUBLE".format  # noqa: UP032


def entries(start: int, n: int) -> list[str]:
    return [f"({E(start + k + 1)})" for k in range(n)]


A3, B3 = entries(0, 3), entries(3, 3)
A9, B9, C9, D9 = (entries(9 * k, 9) for k in range(4))


def arrays(start: int, n: int) -> Column:
    return F.transform(F.slice("embedding", start + 1, n), lambda x: x.cast("double"))


# functions, as columns need a running session
a3, b3 = partial(arrays, 0, 3), partial(arrays, 3, 3)
a9, b9, c9, d9 = (partial(arrays, 9 * k, 9) for k in range(4))


def sql(values: list[str], digits: int = 6) -> str:
    return "SELECT vec_id, " + ", ".join(f"round({v}, {digits}) AS r{k}" for k, v in enumerate(values)) + " FROM embeddings"


def add(name: str, value: Callable[[], Column], values: list[str], digits: int = 6) -> None:
    """Register a query of one array- or number-valued expression, a column for each entry."""

    def run(spark, sf_dir) -> DataFrame:
        made = table(spark, sf_dir, "embeddings").select("vec_id", value().alias("r"))  # the expression is evaluated once
        item = F.col("r") if len(values) == 1 else None
        return made.select("vec_id", *(rounded((item if item is not None else F.get("r", F.lit(k))) + 0.0, digits).alias(f"r{k}") for k in range(len(values))))

    query(sql(values, digits), name)(run)


def s_dot(x: list[str], y: list[str]) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(x, y, strict=True)) + ")"


def s_mul(x: list[str], y: list[str]) -> list[str]:
    return [s_dot(x[3 * i : 3 * i + 3], y[j::3]) for i in range(3) for j in range(3)]


def s_trace(x: list[str]) -> str:
    return f"({x[0]} + {x[4]} + {x[8]})"


def s_minor(x: list[str], i: int, j: int) -> str:
    (r, s), (c, d) = ([k for k in range(3) if k != v] for v in (i, j))
    return f"({x[3 * r + c]} * {x[3 * s + d]} - {x[3 * r + d]} * {x[3 * s + c]})"


def s_det(x: list[str]) -> str:
    return f"({x[0]} * {s_minor(x, 0, 0)} - {x[1]} * {s_minor(x, 0, 1)} + {x[2]} * {s_minor(x, 0, 2)})"


S_CROSS = [f"({A3[1]} * {B3[2]} - {A3[2]} * {B3[1]})", f"({A3[2]} * {B3[0]} - {A3[0]} * {B3[2]})", f"({A3[0]} * {B3[1]} - {A3[1]} * {B3[0]})"]
ANGLES = (30.0, 20.0, 10.0)
_R = [f"({v!r})" for v in V.rotation(*ANGLES)]
CENTER = (0.1, 0.2, 0.3)
_MOVED = [f"({x} - {c})" for x, c in zip(A3, CENTER, strict=True)]

add("vec_dot", lambda: V.dot(a3(), b3()), [s_dot(A3, B3)])
add("vec_cross", lambda: V.cross(a3(), b3()), S_CROSS)
add("vec_outer", lambda: V.outer(a3(), b3()), [f"{x} * {y}" for x in A3 for y in B3])
add("vec_scale", lambda: V.scale(V.comp(b3(), 0), a3()), [f"{B3[0]} * {x}" for x in A3])
add("vec_tensor", lambda: V.vector_tensor(a3(), b9()), [s_dot(A3, B9[i::3]) for i in range(3)])
add("vec_norm", lambda: V.norm(a3()), [f"sqrt({s_dot(A3, A3)})"])
add("vec_rotate", lambda: V.rotate(a3(), *ANGLES, CENTER), [f"{s_dot(_MOVED, _R[i::3])} + {CENTER[i]}" for i in range(3)])
add("vec_combine", lambda: V.combine_arrays(2.0, a3(), -0.5, b3()), [f"2.0 * {x} - 0.5 * {y}" for x, y in zip(A3, B3, strict=True)])
add("num_combine", lambda: V.combine(2.0, V.comp(a3(), 0), -0.5, V.comp(b3(), 0)), [f"2.0 * {A3[0]} - 0.5 * {B3[0]}"])
add("vec_at_least", lambda: V.at_least(a3(), 0.05), [f"greatest({x}, 0.05)" for x in A3])
add("vec_at_most", lambda: V.at_most(a3(), 0.05), [f"least({x}, 0.05)" for x in A3])
add("vec_largest", lambda: V.largest(a3(), b3()), [f"greatest({x}, {y})" for x, y in zip(A3, B3, strict=True)])
add("vec_smallest", lambda: V.smallest(a3(), b3()), [f"least({x}, {y})" for x, y in zip(A3, B3, strict=True)])
add("tens_identity", lambda: V.identity(), [str(float(k % 4 == 0)) for k in range(9)])
add("tens_transpose", lambda: V.transpose(a9()), [A9[3 * j + i] for i in range(3) for j in range(3)])
add("tens_trace", lambda: V.trace(a9()), [s_trace(A9)])
add("tens_det", lambda: V.det(a9()), [s_det(A9)], 8)
add("tens_inverse", lambda: V.inverse(V.matmul(a9(), V.identity())), [f"{'-' if (i + j) % 2 else ''}{s_minor(A9, j, i)} / {s_det(A9)}" for i in range(3) for j in range(3)], 2)
add("tens_matmul", lambda: V.matmul(a9(), b9()), s_mul(A9, B9), 7)
add("tens_double_dot", lambda: V.double_dot(a9(), b9()), [s_dot(A9, B9)])
add("tens_triple_dot", lambda: V.triple_dot(a9(), b9(), c9()), [s_trace(s_mul(s_mul(A9, B9), C9))], 8)
add("tens_quadruple_dot", lambda: V.quadruple_dot(a9(), b9(), c9(), d9()), [s_trace(s_mul(s_mul(A9, B9), s_mul(C9, D9)))], 8)
add("tens_scale", lambda: V.scale(3.0, a9()), [f"3.0 * {x}" for x in A9])
add("tens_vector", lambda: V.tensor_vector(a9(), arrays(9, 3)), [s_dot(A9[3 * i : 3 * i + 3], entries(9, 3)) for i in range(3)])
add("tens_norm", lambda: V.tensor_norm(a9()), [f"sqrt({s_dot(A9, A9)})"])
add("tens_rotate", lambda: V.tensor_rotate(a9(), *ANGLES), s_mul(_R, A9))

#: Turbulence budgets and stress tensors at a node: R (9), velocity gradient (9), mean velocity (3), gradient of R (27).
R27 = entries(18, 27)


def s_t(x: list[str]) -> list[str]:
    return [x[3 * j + i] for i in range(3) for j in range(3)]


def production(r: Column, g: Column) -> Column:
    """-(R grad(u)^T + grad(u) R^T)."""
    return V.combine_arrays(-1.0, V.matmul(r, V.transpose(g)), -1.0, V.matmul(g, V.transpose(r)))


def convection(u: Column, grad: Column) -> Column:
    """Mean velocity times the gradient of each of the nine stresses."""
    return F.array(*(V.total([V.comp(u, k) * V.comp(grad, 3 * m + k) for k in range(3)]) for m in range(9)))


def dissipation_budget(mu: float, g: Column) -> Column:
    return V.scale(2 * mu, V.matmul(g, V.transpose(g)))


def turbulent_diffusion(rho: float, grad: Column) -> Column:
    """-rho times the divergence of the triple correlation, from the derivative of its entry (i, j, k) along k."""
    return F.array(*(-rho * V.total([V.comp(grad, 3 * m + k) for k in range(3)]) for m in range(9)))


def pressure_diffusion(grad: Column) -> Column:
    """-(G + G^T) of the gradient G of the pressure-velocity correlation."""
    return V.combine_arrays(-1.0, grad, -1.0, V.transpose(grad))


def molecular_diffusion(mu: float, second: Column) -> Column:
    """Viscosity times the laplacian of each stress, from its second derivatives along each axis (27)."""
    return F.array(*(mu * V.total([V.comp(second, 3 * m + k) for k in range(3)]) for m in range(9)))


def pressure_strain(p: Column, strain: Column) -> Column:
    return F.transform(strain, lambda x: 2 * p * x)


def strain(g: Column) -> Column:
    return V.combine_arrays(0.5, g, 0.5, V.transpose(g))


def rotation_part(g: Column) -> Column:
    return V.combine_arrays(0.5, g, -0.5, V.transpose(g))


def q_criterion(g: Column) -> Column:
    """Half of the surplus of rotation over strain."""
    s, w = strain(g), rotation_part(g)
    return (V.double_dot(w, w) - V.double_dot(s, s)) / 2


def omega(g: Column, eps: float = 1e-3) -> Column:
    """Share of rotation in rotation and strain."""
    s, w = strain(g), rotation_part(g)
    return V.double_dot(w, w) / (V.double_dot(w, w) + V.double_dot(s, s) + eps)


def lambda2(df: DataFrame, g: str) -> DataFrame:
    """Add ``lambda2``: the middle eigenvalue of S S + W W. In steps, so that no step repeats another's arithmetic."""
    parts = df.withColumn("_s", strain(F.col(g))).withColumn("_w", rotation_part(F.col(g)))
    parts = parts.withColumn("_ss", V.matmul(F.col("_s"), F.col("_s"))).withColumn("_ww", V.matmul(F.col("_w"), F.col("_w")))
    m = parts.withColumn("_m", V.combine_arrays(1.0, F.col("_ss"), 1.0, F.col("_ww")))
    return m.withColumn("_e", V.eigenvalues(F.col("_m"))).withColumn("lambda2", F.get("_e", F.lit(1))).drop("_s", "_w", "_ss", "_ww", "_m", "_e")


def vorticity(g: Column) -> Column:
    """Curl from a gradient with entry 3 i + j = d u_i / d x_j."""
    return F.array(V.comp(g, 7) - V.comp(g, 5), V.comp(g, 2) - V.comp(g, 6), V.comp(g, 3) - V.comp(g, 1))


_P, _Q = s_mul(A9, s_t(B9)), s_mul(B9, s_t(A9))
_S = [f"(0.5 * {x} + 0.5 * {y})" for x, y in zip(A9, s_t(A9), strict=True)]
_W = [f"(0.5 * {x} - 0.5 * {y})" for x, y in zip(A9, s_t(A9), strict=True)]
add("budget_convection", lambda: convection(a3(), arrays(18, 27)), [s_dot(A3, R27[3 * m : 3 * m + 3]) for m in range(9)], 7)
add("budget_turbulent_diffusion", lambda: turbulent_diffusion(1.2, arrays(18, 27)), [f"-1.2 * ({R27[3 * m]} + {R27[3 * m + 1]} + {R27[3 * m + 2]})" for m in range(9)])
add("budget_pressure_diffusion", lambda: pressure_diffusion(a9()), [f"-({x} + {y})" for x, y in zip(A9, s_t(A9), strict=True)])
add("budget_molecular_diffusion", lambda: molecular_diffusion(0.3, arrays(18, 27)), [f"0.3 * ({R27[3 * m]} + {R27[3 * m + 1]} + {R27[3 * m + 2]})" for m in range(9)])
add("budget_production", lambda: production(a9(), b9()), [f"-({x} + {y})" for x, y in zip(_P, _Q, strict=True)], 7)
add("budget_dissipation", lambda: dissipation_budget(0.5, a9()), s_mul(A9, s_t(A9)), 7)
add("budget_pressure_strain", lambda: pressure_strain(V.comp(b9(), 0), strain(a9())), [f"2 * {B9[0]} * {x}" for x in _S], 7)
add("strain_tensor", lambda: strain(a9()), _S, 7)
add("vorticity_tensor", lambda: rotation_part(a9()), _W, 7)
add("vorticity", lambda: vorticity(a9()), [f"{A9[7]} - {A9[5]}", f"{A9[2]} - {A9[6]}", f"{A9[3]} - {A9[1]}"])
add("q_criterion", lambda: q_criterion(a9()), [f"({s_dot(_W, _W)} - {s_dot(_S, _S)}) / 2"], 7)
add("omega", lambda: omega(a9()), [f"{s_dot(_W, _W)} / ({s_dot(_W, _W)} + {s_dot(_S, _S)} + 0.001)"], 5)
add("kinetic_energy", lambda: V.trace(V.outer(a3(), a3())) / 2, [f"{s_dot(A3, A3)} / 2"], 7)
add("wind_speed", lambda: N.wind(V.comp(a3(), 0), V.comp(a3(), 1), V.comp(a3(), 2))[0], [f"sqrt({s_dot(A3, A3)})"])
add("wind_direction", lambda: N.wind(V.comp(a3(), 0), V.comp(a3(), 1))[1], [f"atan2({A3[1]}, {A3[0]})"])
add("truncate_half_even", lambda: N.truncate(V.comp(a3(), 0), 3), [f"round_even({A3[0]} * 1000, 0) / 1000"])
add("vector_angle", lambda: N.angle([V.comp(a3(), k) for k in range(3)], [V.comp(b3(), k) for k in range(3)]), [f"degrees(acos({s_dot(A3, B3)} / (sqrt({s_dot(A3, A3)}) * sqrt({s_dot(B3, B3)}))))"], 4)
_len = f"(({B3[0]} - {A3[0]}) * ({B3[0]} - {A3[0]}) + ({B3[1]} - {A3[1]}) * ({B3[1]} - {A3[1]}))"
_t = f"greatest(0.0, least(1.0, (({A3[2]} - {A3[0]}) * ({B3[0]} - {A3[0]}) + ({B3[2]} - {A3[1]}) * ({B3[1]} - {A3[1]})) / {_len}))"
_SIX = lambda: [V.comp(a3(), 2), V.comp(b3(), 2), V.comp(a3(), 0), V.comp(a3(), 1), V.comp(b3(), 0), V.comp(b3(), 1)]
add("point_segment_distance", lambda: N.point_segment(*_SIX()), [f"pow({A3[2]} - {A3[0]} - {_t} * ({B3[0]} - {A3[0]}), 2) + pow({B3[2]} - {A3[1]} - {_t} * ({B3[1]} - {A3[1]}), 2)"], 7)
add("point_line_distance", lambda: N.point_line(*_SIX()), [f"pow(({B3[0]} - {A3[0]}) * ({B3[2]} - {A3[1]}) - ({B3[1]} - {A3[1]}) * ({A3[2]} - {A3[0]}), 2) / {_len}"], 5)
add("point_plane_distance", lambda: N.point_plane([V.comp(a3(), k) for k in range(3)], [V.comp(b3(), k) for k in range(3)], V.comp(arrays(6, 1), 0)), [f"pow({s_dot(A3, B3)} + {entries(6, 1)[0]}, 2) / {s_dot(B3, B3)}"], 5)
add("verticality", lambda: N.verticality(*(F.try_divide(V.comp(a3(), k), V.norm(a3())) for k in range(3))), [f"1 - abs({A3[2]} / sqrt({s_dot(A3, A3)}))"], 6)


def symmetric(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", strain(a9()).alias("a"))


#: In SQL: from symmetric entries m0 to m8 of s to the largest (w) and the others by angles.
EIGEN = """q AS (SELECT *, (m0 + m4 + m8) / 3 AS mean, m3 * m3 + m6 * m6 + m7 * m7 AS o FROM s),
p AS (SELECT *, sqrt((pow(m0 - mean, 2) + pow(m4 - mean, 2) + pow(m8 - mean, 2) + 2 * o) / 6) AS size FROM q),
h AS (SELECT *, acos(greatest(-1.0, least(1.0, ((m0 - mean) * ((m4 - mean) * (m8 - mean) - m7 * m7) - m3 * (m3 * (m8 - mean) - m7 * m6) + m6 * (m3 * m7 - (m4 - mean) * m6)) / (2 * size * size * size)))) / 3 AS w FROM p)"""
MIDDLE = "mean - 2 * size * cos(w) - 2 * size * cos(w + 2 * pi() / 3)"


@query(f"""WITH s AS (SELECT vec_id, {', '.join(f'{x} AS m{k}' for k, x in enumerate(_S))} FROM embeddings), {EIGEN}
SELECT vec_id, round(mean + 2 * size * cos(w + 2 * pi() / 3), 5) AS low, round({MIDDLE}, 5) AS middle, round(mean + 2 * size * cos(w), 5) AS high FROM h""")
def eigen_sym(spark, sf_dir):
    e = symmetric(spark, sf_dir).select("vec_id", V.eigenvalues(F.col("a")).alias("e"))
    return e.select("vec_id", *(rounded(F.get("e", F.lit(k)), 5).alias(n) for k, n in enumerate(("low", "middle", "high"))))


_N = {n: [f"{n}{k}" for k in range(9)] for n in "sw"}


@query(f"""WITH parts AS (SELECT vec_id, {', '.join(f'{x} AS s{k}, {y} AS w{k}' for k, (x, y) in enumerate(zip(_S, _W, strict=True)))} FROM embeddings),
s AS (SELECT vec_id, {', '.join(f'{x} + {y} AS m{k}' for k, (x, y) in enumerate(zip(s_mul(_N['s'], _N['s']), s_mul(_N['w'], _N['w']), strict=True)))} FROM parts), {EIGEN}
SELECT vec_id, round({MIDDLE}, 5) AS lambda2 FROM h""")
def lambda2_criterion(spark, sf_dir):
    g = table(spark, sf_dir, "embeddings").select("vec_id", a9().alias("g"))
    return lambda2(g, "g").select("vec_id", rounded(F.col("lambda2"), 5).alias("lambda2"))


@query(f"""WITH g AS (SELECT vec_id, {', '.join(f'{x} AS a{k}' for k, x in enumerate(A9))} FROM embeddings),
c AS (SELECT *, a0 + a4 + a8 AS t, a0 * a4 - a1 * a3 + a0 * a8 - a2 * a6 + a4 * a8 - a5 * a7 AS m, a0 * (a4 * a8 - a5 * a7) - a1 * (a3 * a8 - a5 * a6) + a2 * (a3 * a7 - a4 * a6) AS d FROM g),
k AS (SELECT *, m - t * t / 3 AS p, t * m / 3 - 2 * t * t * t / 27 - d AS q FROM c), z AS (SELECT *, q * q / 4 + p * p * p / 27 AS disc FROM k),
r AS (SELECT *, cbrt(-q / 2 - CASE WHEN q < 0 THEN -1 ELSE 1 END * sqrt(disc)) AS u FROM z WHERE disc > 0), l AS (SELECT *, t / 3 + u - p / (3 * u) AS e, sqrt(3) / 2 * abs(u + p / (3 * u)) AS swirl FROM r),
x AS (SELECT *, unnest([a1 * a5 - a2 * (a4 - e), (a4 - e) * (a8 - e) - a5 * a7, a7 * a2 - (a8 - e) * a1]) AS x, unnest([a2 * a3 - (a0 - e) * a5, a5 * a6 - a3 * (a8 - e), (a8 - e) * (a0 - e) - a6 * a2]) AS y, unnest([(a0 - e) * (a4 - e) - a1 * a3, a3 * a7 - (a4 - e) * a6, a6 * a1 - a7 * (a0 - e)]) AS z FROM l),
b AS (SELECT vec_id, any_value(swirl) AS swirl, max_by(abs((a7 - a5) * x + (a2 - a6) * y + (a3 - a1) * z) / sqrt(x * x + y * y + z * z) / 2, x * x + y * y + z * z) AS b FROM x GROUP BY vec_id)
SELECT g.vec_id, round(coalesce(swirl, 0), 5) AS swirl, round(coalesce(2 * (b - sqrt(greatest(0.0, b * b - swirl * swirl))), 0), 4) AS rortex, round(coalesce(b * b / (b * b + greatest(0.0, b * b - swirl * swirl) + 0.001), 0), 5) AS omega_rortex FROM g LEFT JOIN b ON g.vec_id = b.vec_id""")
def rortex(spark, sf_dir):
    """The rigid part of the rotation; the axis is tested against eigenvectors."""
    r = rigid_rotation(table(spark, sf_dir, "embeddings").select("vec_id", a9().alias("g")), "g")
    return r.select("vec_id", rounded("swirl", 5).alias("swirl"), rounded("rortex", 4).alias("rortex"), rounded("omega_rortex", 5).alias("omega_rortex"))


@query()
def schur_form(spark, sf_dir):
    """Compared with its defining identities in the tests."""
    return table(spark, sf_dir, "embeddings").select("vec_id", V.schur(a9()).alias("r")).select("vec_id", "r.s", "r.q")


@query("SELECT id, i, j, k, CASE WHEN i = j THEN 1 ELSE 0 END AS delta, ((i - j) * (j - k) * (k - i) // 2)::INT AS eps FROM (SELECT o_orderkey AS id, o_orderkey % 3 + 1 AS i, o_custkey % 3 + 1 AS j, o_orderkey // 3 % 3 + 1 AS k FROM orders)")
def index_symbols(spark, sf_dir):
    o = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(o.alias("id"), (o % 3 + 1).alias("i"), (F.col("o_custkey") % 3 + 1).alias("j"), (F.floor(o / 3) % 3 + 1).alias("k"))
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    return r.select("id", "i", "j", "k", V.kronecker(i, j).alias("delta"), V.alternating(i, j, k).alias("eps"))


def points(spark, sf_dir):
    """Balances of customers as places between -1 and 1."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_acctbal") - 4500) / 5501.0).alias("x"))


POINTS = "p AS (SELECT c_custkey AS id, (c_acctbal - 4500) / 5501.0::DOUBLE AS x FROM customer)"


@query(f"WITH {POINTS} SELECT id, round((3 * x * x - 1) / 2, 8) AS p2, round((35 * pow(x, 4) - 30 * x * x + 3) / 8, 8) AS p4, round((140 * pow(x, 3) - 60 * x) / 8, 8) AS d4, round((420 * x * x - 60) / 8, 7) AS dd4, round(105 * x, 7) AS ddd4 FROM p")
def legendre(spark, sf_dir):
    x = F.col("x")
    return points(spark, sf_dir).select("id", rounded(N.legendre(2, x), 8).alias("p2"), rounded(N.legendre(4, x), 8).alias("p4"), rounded(N.legendre(4, x, 1), 8).alias("d4"), rounded(N.legendre(4, x, 2), 7).alias("dd4"), rounded(N.legendre(4, x, 3), 7).alias("ddd4"))


@query(f"WITH {POINTS} SELECT id, round(x * (x - 1) / 2, 8) AS l0, round(1 - x * x, 8) AS l1, round(x * (x + 1) / 2, 8) AS l2, round(x - 0.5, 8) AS d0, round(-2 * x, 8) AS d1, round(x + 0.5, 8) AS d2 FROM p")
def lagrange(spark, sf_dir):
    nodes = [-1.0, 0.0, 1.0]
    return points(spark, sf_dir).select("id", *(rounded(f(F.col("x"), k, nodes) + 0.0, 8).alias(f"{n}{k}") for n, f in (("l", N.lagrange), ("d", N.lagrange_slope)) for k in range(3)))


@query("SELECT p_partkey AS id, k, round(p_size / 2.0::DOUBLE * (1 + x), 7) AS x, round(p_size / 2.0::DOUBLE * w, 7) AS w FROM part, (VALUES (0, -1.0::DOUBLE, 1 / 6.0::DOUBLE), (1, 1.0, 1 / 6.0::DOUBLE), (2, -sqrt(0.2), 5 / 6.0::DOUBLE), (3, sqrt(0.2), 5 / 6.0::DOUBLE)) t(k, x, w)")
def lobatto_points(spark, sf_dir):
    """Four points and weights on the stretch from 0 to each part's size."""
    half = F.col("p_size") / 2.0
    rule = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(*N.lobatto(4), strict=True)))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), half.alias("h"), F.posexplode(rule).alias("k", "r"))
    return p.select("id", "k", rounded(F.col("h") * (1 + F.col("r.x")), 7).alias("x"), rounded(F.col("h") * F.col("r.w"), 7).alias("w"))


@query(f"WITH {POINTS} SELECT id, round(0.5 * (1 + tanh(2.0 * (2 * ((x + 1) / 2) - 1)) / tanh(2.0)), 8) AS y FROM p")
def bunching(spark, sf_dir):
    return points(spark, sf_dir).select("id", rounded(N.bunching((F.col("x") + 1) / 2, 1.0, 2.0), 8).alias("y"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey <= 1 THEN 1 ELSE pow(2, ceil(log2(o_orderkey)))::BIGINT END AS p FROM orders")
def next_power(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), N.next_power_of_two(F.col("o_orderkey")).alias("p"))


@query("""WITH c AS (SELECT p_partkey, (p_size * 5 % 256)::DOUBLE AS r, (p_partkey % 256)::DOUBLE AS g, (p_partkey * 7 % 256)::DOUBLE AS b FROM part), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c)
SELECT p_partkey, round(60 * CASE WHEN hi = lo THEN 0.0 WHEN hi = r THEN CASE WHEN g >= b THEN (g - b) / (hi - lo) ELSE (g - b) / (hi - lo) + 6 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END, 5) AS h,
round(CASE WHEN hi = 0 THEN 0.0 ELSE 100 * (hi - lo) / hi END, 5) AS s, round(hi / 255 * 100, 5) AS v FROM m""")
def colour_hsv(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    r, g, b = ((x % 256).cast("double") for x in (F.col("p_size") * 5, key, key * 7))
    return p.select("p_partkey", *(rounded(c, 5).alias(n) for n, c in zip("hsv", N.hsv(r, g, b), strict=True)))


@query()
def hilbert_key(spark, sf_dir):
    """Customers in the order of a Hilbert curve over (nation, balance) cells."""
    c = table(spark, sf_dir, "customer")
    x, y = F.col("c_nationkey").cast("int"), F.floor((F.col("c_acctbal") + 1000) / 350).cast("int")
    return c.select("c_custkey", N.hilbert(x, y, 5).alias("place"))


