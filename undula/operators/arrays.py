"""The array tier: the spatial operators on whole frames, as NumPy inside Arrow batches.

They are frame-local (mapInArrow, no exchange) and take frames of any sizes together.  Filters along time
are in spectral.py and recursive.py; both work on tiles, bounded runs of a frame's values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import coeffs, stencils
from ..timing import StageTimers
from . import clips

#: A band of a frame: its level, its own size, the clip's rate and the gain that the level gets (null: none).
BANDS = "video_id string, level int, t int, h int, w int, c int, fps double, gain double, data array<double>"
#: (values of frames of one size) to (level, gain, values of the band).
Make = Callable[[np.ndarray], Iterator[tuple[int, float | None, np.ndarray]]]


def values_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, where each row's begin and the last one's end) of frames that are arrays of numbers, or
    bytes with one unsigned 8-bit value each.  A null has no values."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False)
        return values, np.concatenate([[0], np.cumsum(sizes)])
    if not len(column):
        return np.zeros(0), np.zeros(1, np.int64)
    _, places, raw = column.buffers()
    ends = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def number_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def byte_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, np.uint8))])


def is_bytes(frames: DataFrame) -> bool:
    return isinstance(frames.schema["data"].dataType, T.BinaryType)


def _as(frames: DataFrame, kind: T.DataType, make: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    at = frames.columns.index("data")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(*values_of(batch.column(at)))
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return frames.mapInArrow(work, T.StructType([T.StructField("data", kind) if f.name == "data" else f for f in frames.schema]))


def numbers(frames: DataFrame) -> DataFrame:
    """Frames of bytes as frames of numbers; others as they are.  A null becomes empty."""
    return _as(frames, T.ArrayType(T.DoubleType()), lambda flat, ends: number_rows(flat.astype(np.float64), ends)) if is_bytes(frames) else frames


def to_bytes(frames: DataFrame) -> DataFrame:
    """Frames of numbers, cut to whole ones from 0 to 255, as frames of bytes; others as they are."""
    return frames if is_bytes(frames) else _as(frames, T.BinaryType(), lambda flat, ends: byte_rows(np.clip(flat, 0, 255).astype(np.uint8), ends))


def _frames(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[int, int, int], np.ndarray]]:
    """(rows, shape, values) for each frame shape in a batch of (video_id, t, h, w, c, data, ...)."""
    shape = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)], 1)
    for own in np.unique(shape, axis=0):
        rows = np.flatnonzero((shape == own).all(1))
        data = values_of(batch.column(5).take(pa.array(rows)))[0]
        h, w, c = map(int, own)
        yield rows, (h, w, c), data.astype(np.float64, copy=False).reshape(len(rows), h, w, c)


def _rows(batch: pa.RecordBatch, rows: np.ndarray, level: int, gain: float | None, values: np.ndarray) -> pa.RecordBatch:
    n, h, w, c = values.shape
    offsets = pa.array(np.arange(n + 1) * (h * w * c), pa.int32())
    take = pa.array(rows)
    same = lambda v: pa.array(np.full(n, v), pa.int32())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), same(level), batch.column(1).take(take), same(h), same(w), same(c), batch.column(6).take(take), pa.array([gain] * n, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
        names=["video_id", "level", "t", "h", "w", "c", "fps", "gain", "data"],
    )


#: A map over batches that runs in the same tasks before a pyramid, and what its time is called.
Before = tuple[str, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]


def _bands(frames: DataFrame, make: Make, timers: StageTimers | None = None, before: Before | None = None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, values in _frames(batch):
                for level, gain, band in make(values):
                    yield _rows(batch, rows, level, gain, band)

    timed = timers.batches if timers else (lambda _, work: work)
    first, then = timed(*before) if before else iter, timed("pyramid", work)
    return clips.rated(frames).select("video_id", "t", "h", "w", "c", "data", "fps").mapInArrow(lambda batches: then(first(batches)), BANDS)


def shrink(x: np.ndarray, levels: int, border: str, rule: str) -> np.ndarray:
    for _ in range(levels):
        h, w = x.shape[1:3]
        x = stencils.tapped(x, stencils.down_taps(h, max(1, coeffs.half(h, rule)), border), 1)
        x = stencils.tapped(x, stencils.down_taps(w, max(1, coeffs.half(w, rule)), border), 2)
    return x


def grow(x: np.ndarray, sizes: list[tuple[int, int]], border: str, repair: bool = False) -> np.ndarray:
    """Up-samples through the given sizes, coarse to fine.  With `repair` each step only doubles a side (or
    doubles it less one), and what doesn't end in the last size is brought to it by linear interpolation."""
    for h, w in sizes:
        if repair:
            h, w = stencils.up_size(x.shape[1], h), stencils.up_size(x.shape[2], w)
        x = stencils.tapped(x, stencils.up_taps(x.shape[1], h, border), 1)
        x = stencils.tapped(x, stencils.up_taps(x.shape[2], w, border), 2)
    for axis, side in enumerate(sizes[-1] if sizes and repair else (), 1):
        if x.shape[axis] != side:
            x = stencils.along(x, stencils.bilinear(x.shape[axis], side), axis)
    return x


def gaussian_frames(frames: DataFrame, levels: int, border: str = "reflect101", rule: str = "ceil", full: bool = True, repair: bool = False, timers: StageTimers | None = None, before: Before | None = None) -> DataFrame:
    """Blurred frames at full size, or (full=False) only shrunk: what a filter needs to see."""

    def make(x: np.ndarray):
        sizes = coeffs.level_sizes(*x.shape[1:3], levels, rule)
        small = shrink(x, levels, border, rule)
        yield levels, None, grow(small, sizes[-2::-1], border, repair) if full and levels else small

    return _bands(frames, make, timers, before)


def usable_levels(h: int, w: int, levels: int) -> int:
    """How many bands a frame of this size has: halving ends where a side is 1."""
    while levels > 1 and min(coeffs.level_sizes(h, w, levels - 1)[-1]) <= 1:
        levels -= 1
    return levels


def laplacian_frames(frames: DataFrame, levels: int, residual: bool, border: str = "reflect101", wanted: Callable[[int], tuple[int, ...]] | None = None, gains: Callable[[list[tuple[int, int]]], list[float]] | None = None, timers: StageTimers | None = None, before: Before | None = None) -> DataFrame:
    """One row per frame and band, by each frame's own size.  `wanted` says of how many bands which are made,
    `gains` what the levels of these sizes get."""

    def make(x: np.ndarray):
        h, w = x.shape[1:3]
        n = usable_levels(h, w, levels)
        gain = gains(coeffs.level_sizes(h, w, n)[: n + int(residual)]) if gains else [None] * (n + 1)
        own = range(n + 1) if wanted is None else wanted(n)
        for level in range(n):
            h, w = x.shape[1:3]
            if min(h, w) <= 1:  # a frame of one line has no band
                n = level
                break
            small = shrink(x, 1, border, "ceil")
            if level in own:
                yield level, gain[level], x - grow(small, [(h, w)], border)
            x = small
        if residual and n in own:
            yield n, gain[n], x

    return _bands(frames, make, timers, before)
