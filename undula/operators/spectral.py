"""Frequency filters along whole series of any length.

A short series is one group.  A long one is transformed in four steps: with its length N = lines * columns
and place t = line * columns + column, transforms of each column over its lines, a turn of every value by
its place, and transforms of each of the resulting lines over the columns give the whole spectrum.  Between
them runs an exchange, so a group holds some columns or some lines of a tile and never a series; what the
band leaves out isn't exchanged at all, and the way back is the same in reverse.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coeffs
from ..timing import StageTimers
from . import clips
from .tiles import SERIES, TILE, ordered, own_values, series_rows

#: Values in a group: frames x width of a tile in one group, lines x columns x width in the four steps.
GROUP = 1 << 22
#: (values by t, a tile's own columns, whether they begin at the clip's first frame) to values.
Finish = Callable[[np.ndarray, dict, bool], np.ndarray]


@cache
def bins(n: int, fps: float, low: float, high: float, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(k, weight) of the kept bins."""
    kept = coeffs.kept_bins(n, fps, low, high, mask)
    return np.array([k for k, _ in kept], np.int64), np.array([w for _, w in kept])


def fft_bandpass(x: np.ndarray, fps: float, low: float, high: float, mask: str = "symmetric", padding: str = "none") -> np.ndarray:
    """Keeps the band of every column's series: a projection where few bins are kept, else a transform."""
    n = len(x)
    if padding == "optimal":
        size = coeffs.smooth_length(n)
        return fft_bandpass(np.concatenate([x, np.zeros((size - n, x.shape[1]))]), fps, low, high, mask)[:n]
    k, w = bins(n, fps, low, high, mask)
    if not len(k):
        return np.zeros_like(x)
    if len(k) > 4 * np.log2(n + 1) and k[-1] <= n // 2:
        weight = np.zeros(n // 2 + 1)
        weight[k] = np.where((k == 0) | (2 * k == n), w, w / 2)  # the inverse transform counts others twice
        return np.fft.irfft(np.fft.rfft(x, axis=0) * weight[:, None], n, axis=0)
    angle = 2 * np.pi * np.outer(np.arange(n), k) / n
    c, s = np.cos(angle), np.sin(angle)
    return (c * (w / n)) @ (c.T @ x) + (s * (w / n)) @ (s.T @ x)


def _turn(k: np.ndarray, b: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * ((k[:, None] * b) % n) / n)


def _list(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.float64).ravel()


_STEP = "video_id string, level int, tile int, k long, b long, fps double, gain double, first_t int, frames long, size long, lines long, columns long, width int, data array<double>"
_KEPT = [c.split()[0] for c in _STEP.split(", ")]


def four_steps(series: DataFrame, low: float, high: float, mask: str, finish: Finish | None, group: int, timed: Callable[[Callable], Callable] = lambda work: work) -> DataFrame:
    """The band of series with (pos, frames, size, lines, columns, fps, gain): rows (..., pos, data)."""
    key = ["video_id", "level", "tile"]

    def shape(own: dict, width: int) -> tuple[int, int, int, int, int]:
        """(length, lines, columns, columns in a group, lines in a group)."""
        a, b = own["lines"], own["columns"]
        return own["size"], a, b, max(1, group // (a * width)), max(1, group // (b * width))

    def table(own: dict, rows: list[tuple[int, int, np.ndarray]], width: int) -> pa.Table:
        columns = {c: [own.get(c)] * len(rows) for c in _KEPT}
        columns |= {"k": [k for k, _, _ in rows], "b": [b for _, b, _ in rows], "width": [width] * len(rows)}
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        made = {c.split()[0]: pa.array(columns[c.split()[0]], kinds[c.split()[1]]) for c in _STEP.split(", ")[:-1]}
        return pa.table(made | {"data": pa.array([_list(x) for _, _, x in rows], pa.list_(pa.float64()))})

    def grid(given: pa.Table, width: int, by: str, size: int, other: int, step: int) -> np.ndarray:
        """Complex (other, size, width) from rows that each hold a stretch of `step` of the `by` axis."""
        out = np.zeros((other, size, width), np.complex128)
        for at, data in zip(given[by].to_pylist(), given["data"].combine_chunks() if given.num_rows else (), strict=True):
            part = data.values.to_numpy().view(np.complex128).reshape(other, -1, width)
            out[:, at * step : at * step + part.shape[1]] = part
        return out

    def over_lines(given: pa.Table) -> pa.Table:
        own = own_values(given)
        pos, x = ordered(given, "pos")
        width = x.shape[1]
        n, a, b, some, lines = shape(own, width)
        start = own["b"] * some
        stretch = np.arange(start, min(b, start + some))
        values = np.zeros((a, len(stretch), width))
        values[pos // b, pos % b - start] = x
        spectrum = np.fft.fft(values, axis=0) * _turn(np.arange(a), stretch, n, -1)[:, :, None]
        wanted = np.unique(bins(n, own["fps"], low, high, mask)[0] % a // lines)
        return table(own, [(k, own["b"], spectrum[k * lines : (k + 1) * lines]) for k in wanted.tolist()], width)

    def over_columns(given: pa.Table) -> pa.Table:
        own, width = own_values(given), given["width"][0].as_py()
        n, a, b, some, lines = shape(own, width)
        first = own["k"] * lines
        rows = min(a, first + lines) - first
        spectrum = np.fft.fft(grid(given, width, "b", b, rows, some), axis=1)
        weight = np.zeros((rows, b))
        k, w = bins(n, own["fps"], low, high, mask)
        here = (k % a >= first) & (k % a < first + rows)
        weight[k[here] % a - first, k[here] // a] = w[here]
        back = np.fft.ifft(spectrum * weight[:, :, None], axis=1) * _turn(np.arange(first, first + rows), np.arange(b), n, 1)[:, :, None]
        return table(own, [(own["k"], c, back[:, c * some : (c + 1) * some]) for c in range(-(-b // some))], width)

    def back_over_lines(given: pa.Table) -> pa.Table:
        own, width = own_values(given), given["width"][0].as_py()
        n, a, b, some, lines = shape(own, width)
        start = own["b"] * some
        count = min(b, start + some) - start
        # lines are the leading axis of what comes, so each row is placed by its k
        values = np.zeros((a, count, width), np.complex128)
        for k, data in zip(given["k"].to_pylist(), given["data"].combine_chunks(), strict=True):
            part = data.values.to_numpy().view(np.complex128).reshape(-1, count, width)
            values[k * lines : k * lines + len(part)] = part
        y = np.fft.ifft(values, axis=0).real
        pos = (np.arange(a)[:, None] * b + np.arange(start, start + count)).ravel()
        order = np.argsort(pos)
        order = order[pos[order] < own["frames"]]
        y, pos = y.reshape(-1, width)[order], pos[order]
        return series_rows(given, pos, finish(y, own, bool(len(pos)) and pos[0] == 0) if finish else y, "pos")

    columns = F.greatest(F.lit(1), F.expr(f"{group} div (lines * size(data))"))
    dealt = series.withColumn("b", F.floor(F.pmod(F.col("pos"), F.col("columns")) / columns)).withColumn("k", F.lit(0).cast("long"))
    spectra = dealt.groupBy(*key, "b").applyInArrow(timed(over_lines), _STEP)
    turned = spectra.groupBy(*key, "k").applyInArrow(timed(over_columns), _STEP)
    return turned.groupBy(*key, "b").applyInArrow(timed(back_over_lines), SERIES.replace("t int", "pos int"))


def ideal_bandpass(series: DataFrame, fps: float | None, low: float, high: float, mask: str = "symmetric", padding: str = "none", finish: Finish | None = None, group: int | None = None, frames: DataFrame | None = None, timers: StageTimers | None = None) -> DataFrame:
    """Keeps low..high of every series of rows (video_id, level, tile, t, data[, fps, gain]).  `frames` may
    name a cheaper table with the same (video_id, t); without fps, rows have their own.

    Clips whose tiles have at most `group` values are one group each, longer ones go the four steps."""
    group = group or GROUP
    series = clips.rated(series, fps)
    if "gain" not in series.columns:
        series = series.withColumn("gain", F.lit(None).cast("double"))
    short = frames if frames is not None else series
    known, least, most, dense = clips.with_lengths(series, clips.described(short.select("video_id", "t")), padding)
    width = F.size("data")
    timed = (lambda work: timers.groups("filter", work)) if timers else (lambda work: work)

    def work(table: pa.Table) -> pa.Table:
        own = own_values(table)
        t, x = ordered(table)
        y = fft_bandpass(x, own["fps"], low, high, mask, padding)
        return series_rows(table, t, finish(y, own, True) if finish else y)

    parts = []
    if least <= group:  # where a tile of some width may fit
        some = known if most * TILE <= group else known.where(F.col("size") * width <= group)
        parts.append(some.groupBy("video_id", "level", "tile").applyInArrow(timed(work), SERIES))
    if most * TILE > group:
        some = known.where(F.col("size") * width > group)
        if dense:
            made = four_steps(some.withColumn("pos", F.col("t") - F.col("first_t")), low, high, mask, finish, group, timed)
            start = known.select("video_id", "first_t").distinct()
            parts.append(made.join(F.broadcast(start) if least else start, "video_id").withColumn("t", F.col("pos") + F.col("first_t")).select("video_id", "level", "tile", "t", "data"))
        else:
            places = clips.numbered(short, ["video_id"])
            made = four_steps(some.join(places, ["video_id", "t"]), low, high, mask, finish, group, timed)
            parts.append(made.join(places, ["video_id", "pos"]).select("video_id", "level", "tile", "t", "data"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
