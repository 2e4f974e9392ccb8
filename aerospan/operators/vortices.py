"""Rigid rotation in a flow, from velocity gradients (entry 3 i + j = d u_i / d x_j), in closed form: no eigenvalue solver runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospan.functions import vectors as V


def rigid_rotation(df: DataFrame, g: str, eps: float = 1e-3) -> DataFrame:
    """Add ``swirl`` (the imaginary part of the complex eigenvalues), ``rortex`` (twice the angular speed of the rigid part of the rotation),
    ``rortex_axis`` (unit, along which the vorticity is positive) and ``omega_rortex`` (its relative strength, from 0 to 1).

    The axis is the real eigenvector r. With b half the vorticity along r, the deformation across it is a = sqrt(b^2 - swirl^2); rortex is
    2 (b - a), its relative strength b^2 / (a^2 + b^2 + eps). Where all eigenvalues are real nothing turns: zeros and a null axis. A gradient
    with a null gives nulls. The real eigenvalue is the root of the cubic taken without cancellation; steps don't repeat another's arithmetic.
    """
    a = [V.comp(F.col(g), k) for k in range(9)]
    minors = a[0] * a[4] - a[1] * a[3] + a[0] * a[8] - a[2] * a[6] + a[4] * a[8] - a[5] * a[7]
    s = df.withColumn("_t", V.trace(F.col(g)) / 3).withColumn("_m", minors)
    s = s.withColumn("_p", F.col("_m") / 3 - F.col("_t") * F.col("_t")).withColumn("_q", (F.col("_m") * F.col("_t") - V.det(F.col(g))) / 2 - F.pow("_t", 3))
    s = s.withColumn("_d", F.col("_q") * F.col("_q") + F.pow("_p", 3))  # above zero: one real root
    side = F.when(F.col("_q") < 0, 1.0).otherwise(-1.0)
    s = s.withColumn("_u", F.when(F.col("_d") > 0, F.cbrt(side * F.sqrt("_d") - F.col("_q")))).withColumn("_v", -F.try_divide("_p", "_u"))
    s = s.withColumn("swirl", F.when(F.col("_d") <= 0, 0.0).otherwise(F.sqrt(F.lit(3.0)) / 2 * F.abs(F.col("_u") - F.col("_v")))).withColumn("_r", F.col("_t") + F.col("_u") + F.col("_v"))
    rest = [x - F.col("_r") if k % 4 == 0 else x for k, x in enumerate(a)]
    s = s.withColumn("_rows", F.array(*(F.array(*rest[3 * k : 3 * k + 3]) for k in range(3))))
    row = lambda k: F.get("_rows", F.lit(k))
    for k, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):  # each is along r; the longest is the surest
        s = s.withColumn(f"_c{k}", V.cross(row(i), row(j)))
    longest = F.array_max(F.array(*(F.struct(V.norm(F.col(f"_c{k}")).alias("n"), F.col(f"_c{k}").alias("c")) for k in range(3))))
    s = s.withColumn("_l", longest).withColumn("_axis", F.transform("_l.c", lambda x: F.try_divide(x, F.col("_l.n"))))
    curl = F.array(a[7] - a[5], a[2] - a[6], a[3] - a[1])
    s = s.withColumn("_b", V.dot(curl, F.col("_axis")) / 2)
    across = F.sqrt(F.greatest(F.lit(0.0), F.col("_b") * F.col("_b") - F.col("swirl") * F.col("swirl")))
    turns = F.col("_d") > 0
    s = s.withColumn("_a", across)
    s = s.withColumn("rortex", F.when(turns, 2 * (F.abs("_b") - F.col("_a"))).when(F.col("_d") <= 0, 0.0))
    s = s.withColumn("rortex_axis", F.when(turns, F.transform("_axis", lambda x: F.when(F.col("_b") < 0, -x).otherwise(x))))
    s = s.withColumn("omega_rortex", F.when(turns, F.col("_b") * F.col("_b") / (F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b") + eps)).when(F.col("_d") <= 0, 0.0))
    return s.drop("_t", "_m", "_p", "_q", "_d", "_u", "_v", "_r", "_rows", "_c0", "_c1", "_c2", "_l", "_axis", "_b", "_a")
