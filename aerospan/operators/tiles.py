"""Overlapping tiles of predictions, blended into one field and georeferenced.

Tiles are rows (tile, i, j, v): tile numbers run along x first, then upwards; row 0 of a tile is its top. Blending a
tile reads the raw tile to its left and the blended tile below it. Of the lower tile only its first ``overlap`` rows are
read, and only the last ``overlap`` rows of the upper one change; where these do not meet (2 overlap <= n) the rows read
are blended sideways only, so one self-join replaces the loop over tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospan.operators.statistics import in_places


def weight(k: Column, overlap: int, factor: float) -> Column:
    return F.exp(-factor * (k / (overlap - 1))) if overlap > 1 else F.lit(1.0)


def sideways(tiles: DataFrame, n: int, overlap: int, frames: int, factor: float = 1.0) -> DataFrame:
    """Blend each tile's left columns with the right columns of the raw tile before it in its row."""
    left = tiles.select((F.col("tile") + 1).alias("tile"), "i", (F.col("j") - (n - overlap)).alias("j"), F.col("v").alias("_l")).where(F.col("j") >= 0)
    j = tiles.join(left, ["tile", "i", "j"], "left")
    w = weight(F.col("j"), overlap, factor)
    mixed = F.col("v") * (1 - w) + F.col("_l") * w
    return j.withColumn("v", F.when((F.col("tile") % frames > 0) & (F.col("j") < overlap), mixed).otherwise(F.col("v"))).drop("_l")


def upwards(tiles: DataFrame, n: int, overlap: int, frames: int, factor: float = 1.0) -> DataFrame:
    """Blend each tile's last rows with the first rows of the tile below it, as blended itself.

    Beyond an overlap of half a tile, the rows taken from below are blends too, of rows n - overlap further up in the tile
    below that, and so on: as many steps as n - overlap fits into a tile, whatever the number of tiles.
    """
    if overlap >= n:
        raise ValueError("the overlap must be less than a tile")
    out, w = tiles, weight(F.col("i") - (n - overlap), overlap, factor)
    for _ in range((n - 1) // (n - overlap)):
        below = out.where(F.col("i") < overlap).select((F.col("tile") + frames).alias("tile"), (F.col("i") + (n - overlap)).alias("i"), "j", F.col("v").alias("_b"))
        mixed = F.col("v") * w + F.col("_b") * (1 - w)
        out = tiles.join(below, ["tile", "i", "j"], "left").withColumn("v", F.when(F.col("_b").isNotNull(), mixed).otherwise(F.col("v"))).drop("_b")
    return out


def blend(tiles: DataFrame, n: int, step: int, overlap: int, height: int, frames: int, x_factor: float = 1.0, y_factor: float = 1.0) -> DataFrame:
    """The field (row, col, v) of ``height`` rows: where tiles overlap the later one stands; places without a tile are zero."""
    width = step * frames + n
    done = upwards(sideways(tiles, n, overlap, frames, x_factor), n, overlap, frames, y_factor)
    placed = done.select("tile", (height - n - F.floor(F.col("tile") / frames) * step + F.col("i")).alias("row"), ((F.col("tile") % frames) * step + F.col("j")).alias("col"), "v").where(F.col("row") >= 0)
    top = placed.groupBy("row", "col").agg(F.max_by("v", "tile").alias("v"))
    grid = tiles.sparkSession.range(height * width).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    return grid.join(top, ["row", "col"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def geolocate(field: DataFrame, rows: int, cols: int, bounds: DataFrame) -> DataFrame:
    """Add real_x and real_y: pixels spread evenly from min to max of the one-row table ``bounds``."""
    j = field.crossJoin(F.broadcast(bounds.limit(1)))
    along = lambda k, n, a, b: F.col(a) + (F.col(b) - F.col(a)) * k / max(1, n - 1)
    return j.select(*field.columns, along(F.col("col"), cols, "min_x", "max_x").alias("real_x"), along(F.col("row"), rows, "min_y", "max_y").alias("real_y"))


def wind_table(u: DataFrame, v: DataFrame) -> DataFrame:
    """One row for each pixel: U, V, wind_value and dir."""
    j = u.select("row", "col", F.col("v").alias("u")).join(v.select("row", "col", F.col("v").alias("w")), ["row", "col"])
    return j.select("row", "col", "u", F.col("w").alias("v"), F.sqrt(F.col("u") * F.col("u") + F.col("w") * F.col("w")).alias("wind_value"), F.atan2("w", "u").alias("dir"))


def by_number(names: DataFrame, name: str) -> DataFrame:
    """Add ``key``: the number after the first dash of a name; and ``place``, the order by it, names without one last; names must differ."""
    key = F.expr(f"try_cast(regexp_extract({name}, '-(\\\\d+)', 1) AS BIGINT)")
    return in_places(names.withColumn("key", key), F.col("key").asc_nulls_last(), F.col(name))


def infer(tiles: DataFrame, model, outputs: list[str]) -> DataFrame:
    """Hook for a network: ``model`` takes and gives Arrow batches of (tile, one float array for each channel)."""
    return tiles.mapInArrow(model, "tile long, " + ", ".join(f"{c} array<float>" for c in outputs))
