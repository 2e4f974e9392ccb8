"""Spectra of series: discrete Fourier sums as grouped aggregates, and per-series kernels on Arrow groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospan.operators.series import sliced, with_carried
from aerospan.operators.transforms import BLOCK, chirped, spread


def periodogram(series: DataFrame, by: str, index: str, value: str, n: int) -> DataFrame:
    """(by, k, power) for k = 0 .. n/2 of series with ``n`` samples: partial sums are combined before the shuffle."""
    ks = series.sparkSession.range(n // 2 + 1).select(F.col("id").alias("k"))  # a frequency grid of known size
    phase = 2 * math.pi * ((F.col("k") * F.col(index)) % n) / n
    j = series.crossJoin(F.broadcast(ks)).groupBy(by, "k").agg(F.sum(F.col(value) * F.cos(phase)).alias("c"), F.sum(F.col(value) * F.sin(phase)).alias("s"))
    return j.select(by, "k", ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / n).alias("power"))


#: Samples of a series up to which one task transforms it whole; longer ones are dealt to tasks of about the square root of that.
WHOLE = 1 << 18


def sized(series: DataFrame, by: str) -> DataFrame:
    """Add ``n``, the number of samples of each series, unless it is there (see :func:`numbered`); a null name is a name."""
    if "n" in series.columns:
        return series
    sizes = series.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("n"))
    return series.join(sizes, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def fourier(series: DataFrame, by: str, index: str, value: str, whole: int = WHOLE) -> DataFrame:
    """(by, n, k, re, im) for k = 0 .. n/2: the transform of each series (by, index 0 .. n-1, value, n) over its own number of
    samples. A missing value adds nothing, as in a sum. A series of more than ``whole`` samples is a convolution with a chirp, by
    transforms over powers of two in blocks (:func:`chirped`); its index may go up to 3 * 10**9."""
    kind = series.schema[by].dataType.simpleString()
    cut = series.select(F.col(by).alias("_by"), "n", F.col(index).cast("long").alias("_j"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))

    def kernel(rows: pa.Table) -> pa.Table:
        y = np.zeros(rows.column("n")[0].as_py())
        y[rows.column("_j").to_numpy()] = rows.column("_v").to_numpy()
        x = np.fft.rfft(y)
        named = pa.repeat(rows.column("_by")[0], len(x))
        return pa.Table.from_arrays([named, pa.repeat(rows.column("n")[0], len(x)), pa.array(np.arange(len(x))), pa.array(x.real), pa.array(x.imag)], ["_by", "n", "k", "re", "im"])

    schema = f"_by {kind}, n long, k long, re double, im double"
    short = cut.where(F.col("n") <= whole).groupBy("_by").applyInArrow(kernel, schema)
    return short.unionByName(chirped(cut.where(F.col("n") > whole), kind)).withColumnRenamed("_by", by)


def whole_periodogram(series: DataFrame, by: str, index: str, value: str, whole: int = WHOLE) -> DataFrame:
    """(by, k, power) for k = 0 .. n/2 of each series, n its own number of samples; see :func:`fourier`."""
    x = fourier(sized(series, by), by, index, value, whole)
    return x.select(by, "k", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")).alias("power"))


def fft_spectra(series: DataFrame, by: str, index: str, value: str, step: float, windowing: bool = False, lowpass: float | None = None, psd: bool = True, whole: int = WHOLE) -> DataFrame:
    """(by, freq, power): one-sided spectra of samples ``step`` apart, about their mean.

    ``windowing`` applies a Hann window; ``lowpass`` keeps frequencies up to that one; ``psd`` gives density (square over frequency),
    else amplitudes. The kernel to match is not given, so scales are those of the textbook: a density's integral is the variance.
    """
    s = sized(series, by).select(by, index, "n", F.col(value).cast("double").alias("_v"))
    means = s.groupBy(F.col(by).alias("_by")).agg(F.avg("_v").alias("_mean"))
    s = s.join(means, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    w = (1 - F.cos(2 * math.pi * F.col(index) / F.greatest(F.col("n") - 1, F.lit(1)))) / 2 if windowing else F.lit(1.0)
    s = s.withColumn("_w", w).withColumn("_v", (F.col("_v") - F.col("_mean")) * F.col("_w"))
    sums = s.groupBy(F.col(by).alias("_by")).agg(F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_w")).alias("_sww"))
    x = fourier(s, by, index, "_v", whole).join(sums, F.col(by).eqNullSafe(F.col("_by")))
    x = x.withColumn("freq", F.col("k") / (F.col("n") * step))
    x = x if lowpass is None else x.where(F.col("freq") <= lowpass)
    twice = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("n")), 1.0).otherwise(2.0)
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    power = F.try_divide(twice * square * step, F.col("_sww")) if psd else F.try_divide(twice * F.sqrt(square), F.col("_sw"))
    return x.select(by, "freq", power.alias("power"))


def lomb_scargle(series: DataFrame, by: str, time: str, value: str, freqs: list[float]) -> DataFrame:
    """(by, freq, power) of unevenly sampled series, normalised by the variance."""
    stats = series.groupBy(by).agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"))
    s = series.join(stats, by).select(by, time, (F.col(value) - F.col("_m")).alias("_y"), "_v")
    f = F.explode(F.array(*(F.lit(float(x)) for x in freqs))).alias("freq")
    j = s.select(by, time, "_y", "_v", f).withColumn("_a", 2 * math.pi * F.col("freq") * F.col(time))
    shift = j.groupBy(by, "freq").agg((F.atan2(F.sum(F.sin(2 * F.col("_a"))), F.sum(F.cos(2 * F.col("_a")))) / 2).alias("_t"))
    a = F.col("_a") - F.col("_t")
    sums = j.join(shift, [by, "freq"]).groupBy(by, "freq").agg(F.max("_v").alias("v"), *(F.sum(x).alias(n) for n, x in (("yc", F.col("_y") * F.cos(a)), ("ys", F.col("_y") * F.sin(a)), ("cc", F.cos(a) * F.cos(a)), ("ss", F.sin(a) * F.sin(a)))))
    power = (F.coalesce(F.try_divide(F.col("yc") * F.col("yc"), "cc"), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("ys") * F.col("ys"), "ss"), F.lit(0.0))) / 2
    return sums.select(by, "freq", F.try_divide(power, F.col("v")).alias("power"))


#: Mesh places on either side over which a sample is spread, and how much finer the mesh is than its frequencies need: errors near 1e-12.
SPREAD, FINER = 12, 2


def lomb_grid(series: DataFrame, by: str, time: str, value: str, ofac: float = 4.0, hifac: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(by, k, freq, power) of unevenly sampled series on the grid k / (ofac T), k = 1 .. ofac hifac n / 2, T the time from first to last.

    Power is normalised by the variance, as in :func:`lomb_scargle`, but no frequency meets every sample: samples are spread over a
    regular mesh by a narrow bell curve, the mesh is transformed in blocks (:func:`spread`), and the curve's own transform is divided out. The
    transform of the samples' places alone, at twice each frequency, gives the shift that makes sines and cosines independent. Rows
    with a null or NaN value or time are left out; series of one time or without variance have no rows.
    """
    s = series.select(F.col(by).alias("_by"), F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_y")).where("not isnan(_t) and not isnan(_y)").dropna(subset=["_t", "_y"])
    stats = s.groupBy("_by").agg(F.min("_t").alias("_t0"), (F.max("_t") - F.min("_t")).alias("_long"), F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_m0"), F.var_samp("_y").alias("_v"))
    stats = stats.withColumn("_top", F.floor(0.5 * ofac * hifac * F.col("_n"))).where("_long > 0 and _v > 0 and _top > 0")
    modes = 4 * F.col("_top") + 2
    bits = F.ceil(F.log2(FINER * modes.cast("double"))).cast("int")
    stats = stats.withColumn("_m", bits).withColumn("n", F.expr("shiftleft(1L, _m)"))
    ratio = F.col("n") / modes
    stats = stats.withColumn("_tau", math.pi * SPREAD / (modes.cast("double") * modes * ratio * (ratio - 0.5)))
    known = stats.withColumnRenamed("_by", "_k")
    j = s.join(known, F.col("_by").eqNullSafe(F.col("_k"))).withColumn("_at", 2 * math.pi * (F.col("_t") - F.col("_t0")) / (F.col("_long") * ofac)).withColumn("_y", F.col("_y") - F.col("_m0"))
    sums = spread(j, s.schema["_by"].dataType.simpleString(), SPREAD, block).groupBy("_by", "k").agg(*(F.max(c).alias(c) for c in ("yc", "ys", "c2", "s2")))  # one of each is not null
    x = sums.join(known, F.col("_by").eqNullSafe(F.col("_k")))
    back = lambda q: F.sqrt(math.pi / F.col("_tau")) * F.exp(q * q * F.col("_tau")) / F.col("n")
    one, two = back(F.col("k").cast("double")), back(2.0 * F.col("k"))
    x = x.withColumns({"yc": F.col("yc") * one, "ys": F.col("ys") * one, "c2": F.col("c2") * two, "s2": F.col("s2") * two})
    x = x.withColumn("_turn", F.atan2("s2", "c2") / 2).withColumn("_cc", (F.col("_n") + F.sqrt(F.col("c2") * F.col("c2") + F.col("s2") * F.col("s2"))) / 2)
    x = x.withColumn("_a", F.col("yc") * F.cos("_turn") + F.col("ys") * F.sin("_turn")).withColumn("_b", F.col("ys") * F.cos("_turn") - F.col("yc") * F.sin("_turn"))
    rest = F.col("_n") - F.col("_cc")
    power = F.col("_a") * F.col("_a") / F.col("_cc") + F.when(rest > 1e-9 * F.col("_n"), F.col("_b") * F.col("_b") / rest).otherwise(0.0)
    return x.select(F.col("_by").alias(by), "k", (F.col("k") / (F.col("_long") * ofac)).alias("freq"), (power / (2 * F.col("_v"))).alias("power"))


def welch(series: DataFrame, by: str, index: str, value: str, length: int, overlap: int) -> DataFrame:
    """(by, k, power): mean over Hann-windowed segments of ``length`` that overlap; segments of one series run in parallel."""
    hop = length - overlap
    first, last = F.greatest(F.lit(0), F.ceil((F.col(index) - length + 1) / hop)).cast("long"), F.floor(F.col(index) / hop).cast("long")
    cut = series.select(by, F.explode(F.sequence(first, last)).alias("seg"), F.col(index).alias("_i"), F.col(value).cast("double").alias("_v"))
    cut = cut.withColumn("_i", F.col("_i") - F.col("seg") * hop)
    kind = series.schema[by].dataType.simpleString()

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < length:
            return pd.DataFrame({by: pd.Series([], dtype=object), "k": pd.Series([], dtype="int64"), "power": pd.Series([], dtype="float64")})
        y = pdf.sort_values("_i")["_v"].to_numpy()
        window = np.hanning(length)
        power = np.abs(np.fft.rfft((y - y.mean()) * window)) ** 2 / (window**2).sum()
        return pd.DataFrame({by: pd.Series([key[0]] * len(power), dtype=object), "k": np.arange(len(power)), "power": power})

    parts = cut.groupBy(by, "seg").applyInPandas(kernel, f"{by} {kind}, k long, power double")
    return parts.groupBy(by, "k").agg(F.avg("power").alias("power"))


def octaves(spectrum: DataFrame, freq: str, power: str, low: float, high: float, order: int = 2) -> DataFrame:
    """(band, power): mean of a spectrum over bands around 2^(k / order); bands without a value are left out."""
    start, half = math.log2(low) * order, 1 / (2 * order)
    band = F.ceil(F.log2(F.col(freq)) * order - start - half * order)
    n = math.ceil(math.log2(high) * order - start)
    banded = spectrum.where(F.col(freq) > 0).withColumn("band", band).where((F.col("band") >= 0) & (F.col("band") < n))
    return banded.groupBy("band").agg(F.avg(power).alias("power"))


def numbered(df: DataFrame, by: str, order: list[str], along: str) -> DataFrame:
    """Add ``i``, the place from 0 of each row of its series by ``order``, and ``n``, the rows of the series. ``along`` is a number that
    doesn't descend in that order; by its slices the rows of a series are dealt to tasks."""
    s = sliced(df, along)
    each, w = s.groupBy(by, "_s").agg(F.count(F.lit(1)).alias("_rows")), Window.partitionBy(by)
    before = F.sum("_rows").over(w.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    carried = each.select(by, "_s", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("n"))
    out = with_carried(s.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_s").orderBy(*order))), carried, [by])
    return out.withColumn("i", F.col("_before") + F.col("_own") - 1).drop("_s", "_own", "_before")
