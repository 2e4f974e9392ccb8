"""Sparse matrices as tables (i, j, v), and iterative solvers on them.

A solver step is one join and one grouped sum; two numbers reach the driver in a step. Vectors are tables (i, x). The
lineage is cut every few steps in the shared checkpoint folder, so that a lost executor costs a few steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospan.session import cut_lineage


def times_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) from ``a`` and ``x`` (j, x)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def times_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("j"), F.col("j").alias("_k"), F.col("v").alias("_w"))
    return a.join(right, "j").groupBy("i", F.col("_k").alias("j")).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def trace(a: DataFrame) -> DataFrame:
    return diagonal(a).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))


def row_sums(a: DataFrame) -> DataFrame:
    """The lumped matrix."""
    return a.groupBy("i").agg(F.sum("v").alias("m"))


def applied(a: DataFrame, p: DataFrame, column: str) -> DataFrame:
    """(i, ap): a times a column of a table by i; rows without entries are zero."""
    y = times_vector(a, p.select(F.col("i").alias("j"), F.col(column).alias("x")))
    return p.join(y, "i", "left").withColumn("ap", F.coalesce("y", F.lit(0.0))).drop("y")


def from_rule(rows: DataFrame, columns: int, value: Callable[[Column, Column], Column]) -> DataFrame:
    """(i, j, v) of an implicit matrix: ``value(i, j)`` for each row (i) and each of ``columns`` columns, where it isn't null."""
    full = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))))
    return full.select("i", "j", value(F.col("i"), F.col("j")).alias("v")).where("v is not null")


def lumped(m: DataFrame, b: DataFrame) -> DataFrame:
    """(i, x) with m x = b for a lumped matrix (i, m); null where the mass is zero. Rows of only one side are left out."""
    return m.join(b, "i").select("i", F.try_divide("b", "m").alias("x"))


def approximate_inverse(a: DataFrame, b: DataFrame, rounds: int = 25) -> DataFrame:
    """(i, x) with a x = b, ``b`` (i, b): the residual divided by the lumped matrix is added again and again."""
    state = b.join(row_sums(a), "i").select("i", "m", F.col("b").alias("r"), F.lit(0.0).alias("x")).withColumn("d", F.try_divide("r", "m"))
    for _ in range(rounds):
        step = applied(a, state, "d")
        state = step.select("i", "m", (F.col("r") - F.col("ap")).alias("r"), (F.col("x") + F.col("d")).alias("x")).withColumn("d", F.try_divide("r", "m"))
        state = cut_lineage(state)  # it is read twice by the next round
    return state.select("i", "x")


def conjugate_gradient(a: DataFrame, b: DataFrame, rounds: int = 500, tol: float = 1e-16, refresh: int = 5) -> DataFrame:
    """(i, x) for a symmetric positive definite ``a``: starts from b over the diagonal, steps are scaled by the diagonal, and it stops where
    r.r < tol b.b in that scale. A step is one job: the next residual's size follows from products with what the matrix makes of p."""
    over = F.coalesce(F.try_divide(F.lit(1.0), "v"), F.lit(0.0))
    start = b.join(diagonal(a), "i", "left").select("i", "b", over.alias("d"), (F.col("b") * over).alias("x"))
    state = applied(a, start, "x").select("i", "b", "d", "x", (F.col("b") - F.col("ap")).alias("r")).withColumn("p", F.col("r") * F.col("d"))
    state = cut_lineage(state)
    dot = lambda x, y: F.sum(F.col("d") * F.col(x) * F.col(y))
    for k in range(rounds):
        step = applied(a, state, "p").cache()
        rr, bb, pap, rap, apap = step.agg(dot("r", "r"), dot("b", "b"), F.sum(F.col("p") * F.col("ap")), dot("r", "ap"), dot("ap", "ap")).first()
        if not rr or rr <= tol * bb or not pap:
            step.unpersist()
            break
        alpha = rr / pap
        beta = max(0.0, rr - 2 * alpha * rap + alpha * alpha * apap) / rr
        r = F.col("r") - alpha * F.col("ap")
        state = step.select("i", "b", "d", (F.col("x") + alpha * F.col("p")).alias("x"), r.alias("r"), (r * F.col("d") + beta * F.col("p")).alias("p"))
        if k % refresh == refresh - 1:
            state = cut_lineage(state)
            step.unpersist()
    return state.select("i", "x")


def example(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The mass matrix of a unit square of four bilinear cells (nine nodes), and a right-hand side."""
    from aerospan.operators.mesh import consistent_mass, plane_elements, plane_nodes

    a = consistent_mass(plane_elements(spark, 3, 3), plane_nodes(spark, (1.0, 1.0), 3, 3))
    b = spark.range(9).select(F.col("id").alias("i"), F.sin(F.col("id").cast("double")).alias("b"))
    return a, b
