"""Time-weighted accumulators over instants, running statistics, and repairs of series."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of the range of a time or number by which the rows of one key are dealt to tasks.
SLICES = 64


def sliced(df: DataFrame, order: str, slices: int = SLICES) -> DataFrame:
    """Add ``_s``: which of ``slices`` equal parts of its range the number ``order`` is in. Windows by key and ``_s`` keep no key in
    one task; what they need from the slices before is carried over in a table with a row for each key and slice."""
    ends = df.agg(F.min(order).cast("double").alias("_lo"), F.max(order).cast("double").alias("_hi"))  # one row
    share = F.coalesce(F.try_divide(F.col(order).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("_s", F.least(F.lit(slices - 1), F.floor(share * slices).cast("int"))).drop("_lo", "_hi")


def with_carried(df: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Join what is carried into each key and slice; null keys are keys."""
    named = carried.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate([*by, "_s"])), *(c for c in carried.columns if c not in (*by, "_s")))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate([*by, "_s"])))
    return df.join(named, same).drop(*(f"_k{k}" for k in range(len(by) + 1)))


def steps(df: DataFrame, time: str, order: list[str], by: list[str]) -> DataFrame:
    """Add ``dt``: time since the instant before; an instant without one weighs its own time. ``time`` ascends in ``order``."""
    s = sliced(df, time)
    earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ends = s.groupBy(*by, "_s").agg(F.max(time).alias("_end")).select(*by, "_s", F.max("_end").over(earlier).alias("_end"))
    before = F.lag(time).over(Window.partitionBy(*by, "_s").orderBy(*order))
    return with_carried(s.withColumn("_b", before), ends, by).withColumn("dt", F.col(time) - F.coalesce("_b", "_end", F.lit(0.0))).drop("_s", "_b", "_end")


def weighted_moment(values: list[Column], time: str) -> Column:
    """Mean over time of a product of values: what increments of weight dt / t add up to, in closed form."""
    product = values[0]
    for v in values[1:]:
        product = product * v
    return F.try_divide(F.sum(F.col("dt") * product), F.max(time))


def moment_tensor(factors: list[list[Column]], time: str) -> Column:
    """Moments of all products of one component of each of two or three vectors: an array whose index has the first vector's
    component running fastest (i1 + 3 i2, i1 + 3 i2 + 9 i3)."""
    picks = [()]
    for vector in factors:
        picks = [(*p, x) for x in vector for p in picks]
    return F.array(*(weighted_moment(list(p), time) for p in picks))


def running_mean(df: DataFrame, value: Column, time: str, order: list[str], by: list[str]) -> DataFrame:
    """Add ``running``, the weighted mean of ``value`` up to each instant, to rows that have ``dt``."""
    s = sliced(df.withColumn("_x", F.col("dt") * value), time)
    earlier = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = s.groupBy(*by, "_s").agg(F.sum("_x").alias("_sum")).select(*by, "_s", F.sum("_sum").over(earlier).alias("_sum"))
    here = F.sum("_x").over(Window.partitionBy(*by, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = with_carried(s.withColumn("_here", here), sums, by)
    return out.withColumn("running", F.try_divide(F.col("_here") + F.coalesce("_sum", F.lit(0.0)), F.col(time))).drop("_s", "_x", "_here", "_sum")


def fluctuation(df: DataFrame, value: str, time: str, by: list[str]) -> DataFrame:
    """Value minus its weighted mean: the mean is one row for each key, joined back."""
    mean = df.groupBy(*by).agg(weighted_moment([F.col(value)], time).alias("mean"))
    return df.join(mean, by).withColumn("fluctuation", F.col(value) - F.col("mean"))


def fill(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Replace NaN by a line between the neighbours in row order; at the ends by the nearest value. ``order`` is a number."""
    s = sliced(df.withColumn("_v", F.nanvl(F.col(value), F.lit(None).cast("double"))), order)
    up = Window.partitionBy(*by, "_s").orderBy(order)
    down = Window.partitionBy(*by, "_s").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_i", F.row_number().over(up))
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_v").alias("v")))
    s = s.withColumn("_a", F.last(known, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(known, ignorenulls=True).over(down))
    slices = Window.partitionBy(*by).orderBy("_s")
    each = s.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"), F.min_by("_b", "_i").alias("_first"), F.max_by("_a", "_i").alias("_last"))
    each = each.withColumn("_at", F.coalesce(F.sum("_n").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.i") + F.col("_at")).alias("i"), F.col(f"{c}.v").alias("v")))
    back = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*by, "_s", "_at", F.last(moved("_last"), ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, -1)).alias("_past"), F.last(moved("_first"), ignorenulls=True).over(back).alias("_next"))
    out = with_carried(s, carried, by)
    out = out.withColumn("_a", F.coalesce(moved("_a"), "_past")).withColumn("_b", F.coalesce(moved("_b"), "_next")).withColumn("_i", F.col("_i") + F.col("_at"))
    share = F.coalesce(F.try_divide(F.col("_i") - F.col("_a.i"), F.col("_b.i") - F.col("_a.i")), F.lit(0.0))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    return out.withColumn(value, F.coalesce("_v", line, F.col("_a.v"), F.col("_b.v"))).drop("_s", "_i", "_v", "_a", "_b", "_at", "_past", "_next")


def midline(df: DataFrame, value: str, index: str, n: str) -> DataFrame:
    """Mean of each row and its mirror row; ``index`` runs from 0 to ``n`` - 1. The middle of an odd number stays."""
    mirror = df.select((F.col(n) - 1 - F.col(index)).alias(index), F.col(value).alias("_m"))
    return df.join(mirror, index).withColumn(value, (F.col(value) + F.col("_m")) / 2).drop("_m")


def first_instants(df: DataFrame, instant: str, n: int) -> DataFrame:
    """Rows of the first ``n`` different instants."""
    some = df.select(instant).distinct().orderBy(instant).limit(n)
    return df.join(F.broadcast(some), instant, "left_semi") if n <= 10_000 else df.join(some, instant, "left_semi")


def last_instants(df: DataFrame, instant: str, n: int) -> DataFrame:
    some = df.select(instant).distinct().orderBy(F.desc(instant)).limit(n)
    return df.join(F.broadcast(some), instant, "left_semi") if n <= 10_000 else df.join(some, instant, "left_semi")
