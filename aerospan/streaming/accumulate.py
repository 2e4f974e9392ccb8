"""Stateful accumulation over streams of instants, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "n long, t double, mean double, second double"


def weighted_moments(stream: DataFrame, key: str, time: str, value: str, order: list[str]) -> DataFrame:
    """(key, n, t, mean, second) after every batch: the weighted mean and second moment so far.

    Each instant moves the mean by dt / t of its distance, so the mean is the sum of dt x value over t. Instants of a batch are sorted; a later batch must not hold
    earlier instants of a key (the files of a run come in order). A task holds the batch's rows of one key; the state
    is four numbers.
    """
    kind = stream.schema[key].dataType.simpleString()

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, t, mean, second = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order)
        now, v = rows[time].to_numpy(float), rows[value].to_numpy(float)
        n += len(rows)
        if len(origin := np.flatnonzero(now == 0)):  # what was before the origin of time has no weight after it
            t, mean, second = 0.0, v[origin[-1]], v[origin[-1]] ** 2
            now, v = now[origin[-1] + 1 :], v[origin[-1] + 1 :]
        if len(now):
            dt = np.diff(now, prepend=t)
            mean, second, t = (t * mean + dt @ v) / now[-1], (t * second + dt @ (v * v)) / now[-1], now[-1]
        t, mean, second = float(t), float(mean), float(second)
        state.update((n, t, mean, second))
        yield pd.DataFrame({key: pd.Series([keys[0]], dtype=object), "n": [n], "t": [t], "mean": [mean], "second": [second]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, time: str, value: str, length: str, late: str) -> DataFrame:
    """(start, n, total) of event-time windows; rows later than ``late`` are dropped. ``time`` must be a timestamp."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, length))
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def drained(result: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there now, write every batch's rows with its number below ``folder``, and read them."""
    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number:06d}")

    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.IntegerType())])
    q = result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return result.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last batch's row of each key."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
