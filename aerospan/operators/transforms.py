"""Discrete Fourier transforms of long series, dealt over tasks in blocks.

A transform over 2^m places is one of a matrix of 2^(m // 2) rows and the other power of columns: its columns are transformed, turned, and
then its rows. Tasks hold a few columns or rows, and what they pass on are blocks of the matrix as bytes, so a place costs 16 bytes a pass
and no row of a table, and nothing grows faster than the places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A task holds 2^BLOCK places of a matrix at once (or one row or column of a longer one).
BLOCK = 18


class Layout:
    """Rows, columns, and how many of either a task holds, of the matrix of 2^m places."""

    def __init__(self, m: int, block: int):
        self.size, self.rows, self.columns = 1 << m, 1 << m // 2, 1 << m - m // 2
        self.wide, self.high = 1 << min(m - m // 2, max(0, block - m // 2)), 1 << min(m // 2, max(0, block - (m - m // 2)))

    def place(self, g: int) -> np.ndarray:
        """Places of the matrix in the columns of group ``g``."""
        return np.arange(self.rows)[:, None] * self.columns + g * self.wide + np.arange(self.wide)

    def turn(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (rows[:, None] * columns % self.size) / self.size)


def group_of(column: Column, block: int) -> Column:
    """The group of columns that a column of the matrix of 2^_m places is in, as in :class:`Layout`."""
    return F.call_function("shiftright", column, F.least(F.expr("_m - shiftright(_m, 1)"), F.greatest(F.lit(0), block - F.expr("shiftright(_m, 1)"))))


def groups(block: int) -> Column:
    """Groups of columns in all."""
    return group_of(F.expr("shiftleft(1L, _m - shiftright(_m, 1))"), block)


def cut_up(parts: np.ndarray, step: int, along: int) -> list[bytes]:
    """Bytes of every ``step`` rows (along 1) or columns (along 2) of matrices (channel, rows, columns)."""
    starts = range(0, parts.shape[along], step)
    return [(parts[:, s : s + step] if along == 1 else parts[:, :, s : s + step]).tobytes() for s in starts]


def put_together(rows: pa.Table, shape: tuple[int, int, int], step: int, along: int) -> np.ndarray:
    """Matrices of the given shape from blocks (_part, _data) of ``step`` rows or columns; a missing block is zero."""
    out = np.zeros(shape, complex)
    for part, data in zip(rows.column("_part").to_pylist(), rows.column("_data"), strict=True):
        at = slice(part * step, part * step + step)
        place = out[:, at] if along == 1 else out[:, :, at]
        place[...] = np.frombuffer(data.as_buffer(), complex).reshape(place.shape)
    return out


def passed_on(rows: pa.Table, same: list[str], g: int, blocks: list[bytes]) -> pa.Table:
    """Rows (same, _g, _part, _data): a block for each group, from group ``g``."""
    return pa.Table.from_arrays([*(pa.repeat(rows.column(c)[0], len(blocks)) for c in same), pa.array(range(len(blocks)), pa.int64()), pa.repeat(pa.scalar(g, pa.int64()), len(blocks)), pa.array(blocks, pa.binary())], [*same, "_g", "_part", "_data"])


def chirped(cut: DataFrame, kind: str, block: int = BLOCK) -> DataFrame:
    """(_by, n, k, re, im) for k = 0 .. n/2 of series (_by, _j, _v, n) of any length: x_j w_j convolved with 1 / w_j,
    w_j = exp(-i pi j^2 / n). Both are transformed, multiplied, and transformed back, which ends at the columns it began with."""
    m = F.ceil(F.log2(2.0 * F.col("n"))).cast("int")
    cut = cut.withColumn("_m", m)
    each = cut.select("_by", "n", "_m").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("long"), groups(block) - 1)).alias("_g"), F.lit(None).cast("long").alias("_j"), F.lit(None).cast("double").alias("_v"))
    column = F.col("_j") % F.expr("shiftleft(1L, _m - shiftright(_m, 1))")
    dealt = cut.select("_by", "n", "_m", group_of(column, block).alias("_g"), "_j", "_v").unionByName(each)
    same = ["_by", "n", "_m"]
    blocks = f"_by {kind}, n long, _m int, _g long, _part long, _data binary"

    def first(rows: pa.Table) -> tuple[int, Layout, int]:
        return rows.column("n")[0].as_py(), Layout(rows.column("_m")[0].as_py(), block), rows.column("_g")[0].as_py()

    def wave(place: np.ndarray, n: int) -> np.ndarray:
        return np.exp(-1j * np.pi * (place * place % (2 * n)) / n)

    def forth(rows: pa.Table) -> pa.Table:
        n, at, g = first(rows)
        rows_in = rows.filter(rows.column("_j").is_valid())
        j, x = rows_in.column("_j").to_numpy(), np.zeros((at.rows, at.wide))
        x[j // at.columns, j % at.columns - g * at.wide] = rows_in.column("_v").to_numpy()
        place = at.place(g)
        place = np.minimum(place, at.size - place)
        w = wave(place, n)
        y = np.fft.fft(np.stack([x * w, np.where(place < n, w.conj(), 0)]), axis=1)
        y *= at.turn(np.arange(at.rows), g * at.wide + np.arange(at.wide))
        return passed_on(rows, same, g, cut_up(y, at.high, 1))

    def product(rows: pa.Table) -> pa.Table:
        _, at, g = first(rows)
        y = np.fft.fft(put_together(rows, (2, at.high, at.columns), at.wide, 2), axis=2)
        y = np.fft.ifft(y[0] * y[1], axis=1) / at.turn(g * at.high + np.arange(at.high), np.arange(at.columns))
        return passed_on(rows, same, g, cut_up(y[None], at.wide, 2))

    def back(rows: pa.Table) -> pa.Table:
        n, at, g = first(rows)
        y = np.fft.ifft(put_together(rows, (1, at.rows, at.wide), at.high, 1)[0], axis=0)
        place = at.place(g)
        wanted = place <= n // 2
        k = place[wanted]
        x = y[wanted] * wave(k, n)
        return pa.Table.from_arrays([*(pa.repeat(rows.column(c)[0], len(k)) for c in ("_by", "n")), pa.array(k), pa.array(x.real), pa.array(x.imag)], ["_by", "n", "k", "re", "im"])

    by = [*same, "_g"]
    found = dealt.groupBy(by).applyInArrow(forth, blocks).groupBy(by).applyInArrow(product, blocks)
    return found.groupBy(by).applyInArrow(back, f"_by {kind}, n long, k long, re double, im double")


def spread(samples: DataFrame, kind: str, reach: int, block: int = BLOCK) -> DataFrame:
    """(_by, k, yc, ys, c2, s2): sums of samples (_by, _at, _y, n, _m, _tau, _top) at angles ``_at`` in 0 .. 2 pi times sines and cosines
    k = 1 .. _top, with ``yc`` and ``ys``, and of sines and cosines 2k alone, with ``c2`` and ``s2``, each in a row of its own, the others null.

    Sums are still those of bell curves (of variance 2 _tau) over a mesh of n = 2^_m places, ``reach`` on either side of a sample. A sample goes
    to the groups of columns that its curve touches, and is spread there.
    """
    cell = F.floor(F.col("_at") / (2 * np.pi) * F.col("n"))
    columns = F.expr("shiftleft(1L, _m - shiftright(_m, 1))")
    last = groups(block)
    touched = F.sequence(F.floor((F.col("_cell") - (reach - 1)) / (columns / last)), F.floor((F.col("_cell") + reach) / (columns / last)))
    dealt = samples.withColumn("_cell", cell).withColumn("_g", F.explode(F.array_distinct(F.transform(touched, lambda g: F.pmod(g, last)))))
    dealt = dealt.select("_by", "n", "_m", "_tau", "_top", "_g", "_cell", "_at", "_y")
    same = ["_by", "_m", "_top"]

    def forth(rows: pa.Table) -> pa.Table:
        at, g, tau = Layout(rows.column("_m")[0].as_py(), block), rows.column("_g")[0].as_py(), rows.column("_tau")[0].as_py()
        cells, angles, values = (rows.column(c).to_numpy() for c in ("_cell", "_at", "_y"))
        x, near = np.zeros((2, at.rows * at.wide)), np.arange(1 - reach, reach + 1)
        for n in range(0, len(cells), 1 << 15):
            c = cells[n : n + (1 << 15), None] + near
            off = angles[n : n + (1 << 15), None] - 2 * np.pi * c / at.size
            c %= at.size
            column = c % at.columns - g * at.wide
            mine = (column >= 0) & (column < at.wide)
            w, place = np.exp(-off[mine] ** 2 / (4 * tau)), c[mine] // at.columns * at.wide + column[mine]
            y = np.broadcast_to(values[n : n + (1 << 15), None], mine.shape)[mine]
            x[0] += np.bincount(place, w * y, x.shape[1])
            x[1] += np.bincount(place, w, x.shape[1])
        y = np.fft.rfft(x.reshape(2, at.rows, at.wide), axis=1)  # the other half of the rows mirrors these
        y *= at.turn(np.arange(y.shape[1]), g * at.wide + np.arange(at.wide))
        return passed_on(rows, same, g, cut_up(y, at.high, 1))

    def back(rows: pa.Table) -> pa.Table:
        at, g, top = Layout(rows.column("_m")[0].as_py(), block), rows.column("_g")[0].as_py(), rows.column("_top")[0].as_py()
        own = np.arange(g * at.high, min((g + 1) * at.high, at.rows // 2 + 1))
        y = np.fft.fft(put_together(rows, (2, len(own), at.columns), at.wide, 2), axis=2)
        k = own[:, None] + at.rows * np.arange(at.columns)
        beyond = k > at.size // 2
        y, twice = np.where(beyond, y.conj(), y), beyond & (own[:, None] * 2 % at.rows == 0)
        k = np.where(beyond, at.size - k, k)
        one, two = (k >= 1) & (k <= top) & ~twice, (k >= 2) & (k <= 2 * top) & (k % 2 == 0) & ~twice
        none = lambda mask: pa.nulls(int(mask.sum()), pa.float64())
        sums = [pa.array(v[mask]) for v, mask in ((y[0].real, one), (-y[0].imag, one), (y[1].real, two), (-y[1].imag, two))]
        tables = [[k[one], *sums[:2], none(one), none(one)], [k[two] // 2, none(two), none(two), *sums[2:]]]
        return pa.concat_tables(pa.Table.from_arrays([pa.repeat(rows.column("_by")[0], len(t[0])), pa.array(t[0]), *t[1:]], ["_by", "k", "yc", "ys", "c2", "s2"]) for t in tables)

    blocks = f"_by {kind}, _m int, _top long, _g long, _part long, _data binary"
    by = [*same, "_g"]
    return dealt.groupBy(by).applyInArrow(forth, blocks).groupBy(by).applyInArrow(back, f"_by {kind}, k long, yc double, ys double, c2 double, s2 double")
