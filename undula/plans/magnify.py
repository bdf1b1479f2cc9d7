"""From a configuration to one DataFrame: scan, YIQ, spatial, temporal, gain, reconstruct.

Every step before clipping is linear, so the builder may reorder them (config.optimize):
filters run on shrunk frames and the result is grown afterwards, levels that are never added back are
pruned before the exchange, and gains are folded into the filter.  Two exchanges carry the signal (by
tile, then by frame) and one the original frames; a recursive filter adds some of a short row for each
block of frames, and the frequency filter takes clips beyond a group's size by four steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MagnifyConfig
from ..functions import coeffs, color
from ..operators import arrays, clips, recursive, spectral, tiles
from ..streaming.recursive import refuse_stream
from ..timing import StageTimers

_YIQ = np.array(color.YIQ)


def to_yiq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of frames of three channels in YIQ."""
    for batch in batches:
        at = batch.schema.get_field_index("data")
        flat, ends = arrays.values_of(batch.column(at))
        made = arrays.number_rows((flat.reshape(-1, 3) @ _YIQ.T).ravel(), ends)
        yield pa.RecordBatch.from_arrays([made if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)


def added_levels(levels: int, config: MagnifyConfig) -> tuple[int, ...]:
    """Which levels of a pyramid of `levels` bands (and a residual) are added to the frame."""
    n = levels + int(config.residual)
    return {"inner": tuple(range(1, n - 1)), "inner_residual": tuple(range(1, n)), "outer": tuple(range(0, n - 1))}[config.added_levels]


def _scaled(x: np.ndarray, gain: float, attenuation: float, tile: int) -> np.ndarray:
    return x * np.where((tile + np.arange(x.shape[1])) % 3 == 0, gain, gain * attenuation)


def _signal(bands: DataFrame, frames: DataFrame, config: MagnifyConfig, timers: StageTimers | None) -> DataFrame:
    """Cuts bands into tiles, filters them and applies gains.  Rates and gains are columns of the bands."""
    cfg = config
    if cfg.mode == "gaussian":

        def gain(y: np.ndarray, own: dict, begins: bool) -> np.ndarray:
            return _scaled(y, cfg.alpha, cfg.attenuation, own["tile"])

        return spectral.ideal_bandpass(tiles.tiles(bands), None, cfg.low_hz, cfg.high_hz, cfg.mask, cfg.padding, gain, None, frames, timers)

    def inner_gain(y: np.ndarray, own: dict, begins: bool) -> np.ndarray:
        if own["gain"] is not None:
            rows = y[int(begins) :]  # a clip's first frame has no gain
            rows[:] = _scaled(rows, own["gain"], cfg.attenuation, own["tile"])
        return y

    return recursive.iir_bandpass(tiles.tiles(bands), None, cfg.low_hz, cfg.high_hz, cfg.first_frame, cfg.coefficients, inner_gain, recursive.levels_of(frames.select("video_id", "t")), timers)


def magnify(frames: DataFrame, config: MagnifyConfig, timers: StageTimers | None = None) -> DataFrame:
    """frames (video_id, t, h, w, c=3, data RGB 0..255[, fps]) to rows (video_id, t, h, w, c, data) of unsigned
    8-bit values, as an array of ints.  Where data is binary, a byte for each value, it is binary in the result too:
    an eighth of what arrays of doubles take in scans, exchanges and on the way to Python.

    Every clip has its own size and rate: pyramids follow the rows' sizes, filters and gains the rates and
    sizes that come with them.  config.fps, where it is given, holds for all clips, else the column `fps`,
    else 30.  A clip of different sizes, channels or rates fails by its name, and so does a recursive filter
    on a clip whose rate is too low for it.  Frames with other than h * w * c values have no signal.
    """
    if config.mode == "gaussian":
        refuse_stream(frames)
    size, held = F.col("h") * F.col("w") * F.col("c"), F.length("data") if arrays.is_bytes(frames) else F.size("data")
    given = clips.rated(frames, config.fps)
    whole = F.when(held <= 0, F.lit(False)).when(F.col("c") != 3, F.raise_error("frames must have three channels").cast("boolean")).otherwise(held == size)
    if config.mode == "laplacian":
        fast = F.concat(F.lit("clip "), F.coalesce("video_id", F.lit("null")), F.lit(": high_hz must be under half of fps"))
        whole = F.when(F.col("fps") <= 2 * config.high_hz, F.raise_error(fast).cast("boolean")).otherwise(whole)
    checked = clips.described(given.where("h > 0 and w > 0").select("video_id", "t", "h", "w", "c", "fps"))
    usable, levels, colour = given.where(whole), config.levels, ("colour", to_yiq)
    if config.mode == "gaussian":
        bands = arrays.gaussian_frames(usable, levels, config.border, config.size_rule, not config.optimize, config.repair, timers, colour)
    else:
        wanted = (lambda n: added_levels(n, config)) if config.optimize else None
        gains = lambda sizes: [g if 0 < k < len(sizes) - 1 else None for k, g in enumerate(coeffs.level_gains(sizes, config.alpha, config.lambda_cutoff))]
        bands = arrays.laplacian_frames(usable, levels, config.residual, config.border, wanted, gains, timers, colour)
    signal = tiles.untile(_signal(bands, usable, config, timers))
    per_frame = signal.groupBy("video_id", "t").agg(F.collect_list(F.struct("level", "data")).alias("bands"))
    both = frames.select("video_id", "t", "h", "w", "c", "data").join(per_frame, ["video_id", "t"], "left")
    made = reconstruct(both, config, levels, timers)
    # no clip has fewer than 0 frames; asking every clip is where a mix within one fails, in the same job
    none = checked.where("frames < 0 or h < 0 or w < 0 or c < 0 or fps < 0")
    return made.unionByName(none.select("video_id", *[F.lit(0).alias(c) for c in ("t", "h", "w", "c")], (F.lit(b"") if arrays.is_bytes(frames) else F.array(F.lit(0))).alias("data")))


def collapsed(bands: dict[int, np.ndarray], h: int, w: int, config: MagnifyConfig) -> np.ndarray:
    """The sum of a frame's bands at full size.  Levels of a Laplacian pyramid go up together: each is added to
    what comes from below it, so a frame is up-sampled once and not once for each level."""
    if config.mode == "gaussian":
        (value,) = bands.values()
        sizes = coeffs.level_sizes(h, w, config.levels, config.size_rule)
        if config.optimize and config.levels:
            value = arrays.grow(value.reshape(1, *sizes[-1], 3), sizes[-2::-1], config.border, config.repair)
        return value
    sizes = coeffs.level_sizes(h, w, max(bands))
    total = np.zeros((1, *sizes[-1], 3))
    for level in range(max(bands), -1, -1):
        if level < max(bands):
            total = arrays.grow(total, [sizes[level]], config.border)
        if level in bands:
            total = total + bands[level].reshape(total.shape)
    return total


def reconstruct(both: DataFrame, config: MagnifyConfig, levels: int, timers: StageTimers | None = None) -> DataFrame:
    """Original frames and their bands (null where a frame has none) to clipped 8-bit frames."""
    inverse = np.array(color.inverse(config.inverse))
    cfg, as_bytes = config, arrays.is_bytes(both)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat, ends = arrays.values_of(batch.column(5))
            for h, w, start, end, bands in zip(batch.column(2), batch.column(3), ends[:-1], ends[1:], batch.column(6), strict=True):
                h, w = h.as_py(), w.as_py()
                yiq = flat[start:end].reshape(-1, 3) @ _YIQ.T
                added = range(levels + 1) if cfg.mode == "gaussian" else added_levels(arrays.usable_levels(h, w, levels), cfg)
                found = {band["level"].as_py(): band["data"].values.to_numpy(zero_copy_only=False) for band in bands.values} if bands.is_valid else {}
                found = {level: value for level, value in found.items() if level in added}
                if found:
                    yiq = yiq + collapsed(found, h, w, cfg).reshape(-1, 3)
                value = np.clip(yiq @ inverse.T, 0, 255)
                out.append((np.rint(value) if cfg.rounding == "rint" else np.floor(value)).astype(np.uint8 if as_bytes else np.int32).ravel())
            made = np.concatenate([*out, np.zeros(0, np.uint8 if as_bytes else np.int32)])
            lists = (arrays.byte_rows if as_bytes else arrays.number_rows)(made, ends)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), lists], names=["video_id", "t", "h", "w", "c", "data"])

    return both.mapInArrow(timers.batches("reconstruction", work) if timers else work, f"video_id string, t int, h int, w int, c int, data {'binary' if as_bytes else 'array<int>'}")
