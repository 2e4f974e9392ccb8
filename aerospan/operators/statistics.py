"""Error metrics and summaries; NaN counts as missing in every reducer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospan.functions import vectors as V
from aerospan.functions.numeric import without_nan
from aerospan.session import cut_lineage


def in_places(df: DataFrame, *order: Column, out: str = "place") -> DataFrame:
    """``df`` with the place from 1 of each row by ``order``, which must leave no ties. Rows are dealt by ranges of the order, so no task holds all:
    a place is the rows of the ranges before (a number a task) and the place within its own."""
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))  # ranges come from a sample: drawn once
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = dealt.join(F.broadcast(ranges), "_range").withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def mean(x: Column) -> Column:
    return F.avg(without_nan(x))


def covariance(x: Column, y: Column) -> Column:
    """Population covariance over rows that have both, about the mean of each column's own known values; one pass, mergeable."""
    fx, fy = without_nan(x), without_nan(y)
    both = F.isnotnull(fx) & F.isnotnull(fy)
    bx, by = F.when(both, fx), F.when(both, fy)
    return F.covar_pop(bx, by) + (F.avg(bx) - F.avg(fx)) * (F.avg(by) - F.avg(fy))


def errors(ref: Column, model: Column) -> dict[str, Column]:
    """Aggregates by name. Those that need the mean of ``ref`` take it in a second step, see :func:`spread`."""
    r, m = without_nan(ref), without_nan(model)
    d = r - m
    return {
        "var_ref": F.var_pop(r), "var_model": F.var_pop(m), "median_ref": F.median(r), "median_model": F.median(m),
        "covariance": covariance(ref, model), "pearson": F.try_divide(covariance(ref, model), F.stddev_pop(r) * F.stddev_pop(m)),
        "r2": 1 - F.try_divide(F.avg(d * d), F.var_pop(r)), "bias": F.avg(m - r), "mse": F.avg(d * d), "rmse": F.sqrt(F.avg(d * d)),
        "mae": F.avg(F.abs(d)), "ame": F.max(F.abs(d)), "nse": 1 - F.try_divide(F.avg(d * d), F.var_pop(r)), "rsr": F.try_divide(F.sqrt(F.avg(d * d)), F.stddev_pop(r)),
    }


def with_means(df: DataFrame, by: list[str], ref: str, model: str) -> DataFrame:
    """Add ``_mr`` and ``_mm``, the means by key: one small row for each key is joined back."""
    means = df.groupBy(*by).agg(mean(F.col(ref)).alias("_mr"), mean(F.col(model)).alias("_mm"))
    return df.join(means, by)


def relative_absolute(ref: str, model: str) -> Column:
    """Over :func:`with_means`: mean absolute error over mean absolute deviation."""
    return F.try_divide(mean(F.abs(F.col(ref) - F.col(model))), mean(F.abs(F.col(ref) - F.col("_mr"))))


def agreement(ref: str, model: str) -> Column:
    """Over :func:`with_means`: index of agreement, with |m + mean(m)| in its denominator as the reference has it."""
    d = F.col(ref) - F.col(model)
    potential = F.abs(F.col(model) - F.col("_mr")) + F.abs(F.col(model) + F.col("_mm"))
    return 1 - F.try_divide(F.sum(d * d), F.sum(potential * potential))


def summary(x: Column) -> dict[str, Column]:
    c = without_nan(x)
    return {"size": F.count(F.lit(1)), "largest": F.max(c), "smallest": F.min(c), "mean": F.avg(c), "has_nan": F.coalesce(F.bool_or(F.isnan(x)), F.lit(False))}


def direction_average(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """Mean of every value over all rows that share the kept coordinates."""
    return df.groupBy(*keep).agg(*(mean(F.col(v)).alias(v) for v in values))


def plane_average(df: DataFrame, keep: list[str], values: list[str]) -> DataFrame:
    """The same mean, given to every row: the means are small and are joined back, so a hot plane is not sorted."""
    return df.drop(*values).join(direction_average(df, keep, values), keep)


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return df.groupBy(*key).agg(best).select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def barycentre(weight: Column, coords: list[Column]) -> list[Column]:
    """Weighted centre; null where the weights sum to zero."""
    return [F.try_divide(F.sum(weight * c), F.sum(weight)) for c in coords]


def fitted_line(x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """Least-squares line by the main axis of the covariance: centre x, centre y, direction x >= 0, direction y."""
    a, b, c = F.var_pop(x), F.covar_pop(x, y), F.var_pop(y)
    angle = F.atan2(2 * b, a - c) / 2
    return F.avg(x), F.avg(y), F.cos(angle), F.sin(angle)


def principal(df: DataFrame, by: list[str], coords: list[str]) -> DataFrame:
    """by, n, cx, cy, cz and the covariance of three coordinates with its eigenvalues, ascending: one row for each neighbourhood."""
    pair = lambda i, j: F.covar_pop(coords[i], coords[j])
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(k) for c, k in zip(coords, ("cx", "cy", "cz"), strict=True)), F.array(*(pair(i, j) for i in range(3) for j in range(3))).alias("covariance"))
    return sums.withColumn("eigenvalues", V.eigenvalues(F.col("covariance")))


def fitted_plane(df: DataFrame, by: list[str], coords: list[str]) -> DataFrame:
    """:func:`principal` with ``normal``, the unit normal of the least-squares plane, upwards (or along y, x where it is level), and
    ``rms``, the distance from it in the square mean. Points on a line have no normal: null."""
    p = principal(df, by, coords)
    c, low = F.col("covariance"), V.comp(F.col("eigenvalues"), 0)
    rows = [F.array(*(V.comp(c, 3 * i + j) - (low if i == j else F.lit(0.0)) for j in range(3))) for i in range(3)]
    p = p.withColumn("_across", F.array(*(V.cross(rows[i], rows[j]) for i, j in ((0, 1), (1, 2), (2, 0)))))
    longest = F.array_max(F.transform("_across", lambda a: F.struct(V.dot(a, a).alias("size"), a.alias("a"))))
    p = p.withColumn("_a", longest)
    a, size = F.col("_a.a"), F.sqrt("_a.size")
    sign = lambda k: F.when(V.comp(a, k) < 0, -1.0).otherwise(1.0)
    up = F.when(V.comp(a, 2) != 0, sign(2)).when(V.comp(a, 1) != 0, sign(1)).otherwise(sign(0))
    level = V.comp(F.col("eigenvalues"), 2)
    unit = F.when(size > 1e-12 * level * level, F.transform(a, lambda x: x * up / size))
    return p.withColumn("normal", unit).withColumn("rms", F.sqrt(F.greatest(low, F.lit(0.0)))).drop("_across", "_a")


def plane_distance(df: DataFrame, by: list[str], coords: list[str]) -> DataFrame:
    """``df`` with ``distance``, how far each point lies from the plane fitted to its neighbourhood."""
    planes = fitted_plane(df, by, coords).select(*by, "cx", "cy", "cz", "normal")
    off = V.dot(F.col("normal"), F.array(*(F.col(c) - F.col(k) for c, k in zip(coords, ("cx", "cy", "cz"), strict=True))))
    return df.join(planes, by).withColumn("distance", F.abs(off)).drop("cx", "cy", "cz", "normal")


def eigen_features(df: DataFrame, by: list[str], coords: list[str]) -> DataFrame:
    """by and, of each neighbourhood's eigenvalues a <= b <= c: shares of their sum, linearity (c-b)/c, planarity (b-a)/c and
    sphericity a/c; null where all points coincide."""
    p = principal(df, by, coords)
    a, b, c = (V.comp(F.col("eigenvalues"), k) for k in range(3))
    share = lambda x: F.try_divide(x, a + b + c)
    return p.select(*by, share(a).alias("low"), share(b).alias("middle"), share(c).alias("high"), F.try_divide(c - b, c).alias("linearity"), F.try_divide(b - a, c).alias("planarity"), F.try_divide(a, c).alias("sphericity"))


def in_numbering(rows: DataFrame, target: DataFrame, key: str, place: str, order: list[str]) -> DataFrame:
    """``rows`` whose ``key`` is in ``target`` (key, place), one for each key (the first in ``order``), with its place there; a
    key that the target names twice counts at its first place."""
    places = target.groupBy(key).agg(F.min(place).alias(place))
    return first_by(rows, [key], order).join(places, key)
