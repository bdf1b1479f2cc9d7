"""One frame at a time: a band-pass with a real high-pass, as a stream with state variables and timers.

This is the contract of an operator that sees a single frame and keeps its own state: the first frame of a
clip comes out as zeros; a low-pass and a high-pass of order 1, with coefficients that aren't pre-warped,
run side by side and their difference is the band; every level has a gain, the outer ones all of alpha.

Rows are tiles of pyramid levels (video_id, level, tile, t, fps, gain, data); a tile's state is one row of a
state variable (last t, last input, both outputs), and a second one counts what came late.  A row whose t is
not over the last one is late (or a repetition): it is left out and counted.  A clip that gets no row for
`idle` of processing time is over: a timer gives its last counts and clears its state, and a later row would
begin it anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from math import hypot, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators import arrays, clips
from ..operators.tiles import tiles

OUT = "video_id string, level int, tile int, t int, late long, data array<double>"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def coefficients(low: float, high: float, fps: float) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """(b0, b1, a1) of the low-pass at `low` and the high-pass at `high`, bilinear without pre-warping."""
    slow, fast = 2 * pi * low / fps, 2 * pi * high / fps
    b, c = slow / (slow + 2), 2 / (fast + 2)
    return (b, b, b - 1), (c, -c, (fast - 2) / (fast + 2))


def gains(sizes: list[tuple[int, int]], alpha: float, lambda_cutoff: float) -> list[float]:
    """Gains of all levels: inner ones are bounded by their size."""
    return [min(alpha, hypot(h, w) / (8 * lambda_cutoff) - 1) if 0 < k < len(sizes) - 1 else alpha for k, (h, w) in enumerate(sizes)]


class FrameFilter(StatefulProcessor):
    def __init__(self, low: float, high: float, attenuation: float, idle: float | None):
        self.low, self.high, self.attenuation, self.idle = low, high, attenuation, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.filter = handle.getValueState("filter", "t int, x array<double>, slow array<double>, fast array<double>")
        self.late = handle.getValueState("late", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("t", kind="stable")  # a batch's rows of one bounded tile
        late = self.late.get()[0] if self.late.exists() else 0
        last, *state = self.filter.get() if self.filter.exists() else (None,)
        state = [np.array(v, float) for v in state]
        fps, gain = given["fps"].iloc[0], given["gain"].iloc[0]
        (b0, b1, a1), (c0, c1, d1) = coefficients(self.low, self.high, fps)
        out = []
        for t, data in zip(given["t"], given["data"], strict=True):
            x = np.asarray(data, float)
            if last is None:
                state, y = [x, x, x], np.zeros_like(x)
            elif t <= last:
                late += 1
                continue
            else:
                before, slow, fast = state
                slow, fast = b0 * x + b1 * before - a1 * slow, c0 * x + c1 * before - d1 * fast
                state, y = [x, slow, fast], (fast - slow) * np.where((key[2] + np.arange(len(x))) % 3 == 0, gain, gain * self.attenuation)
            last = int(t)
            out.append((last, late, y.tolist()))
        if last is not None:
            self.filter.update((last, *(v.tolist() for v in state)))
        self.late.update((late,))
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))
        if out:
            yield pd.DataFrame({"video_id": key[0], "level": key[1], "tile": key[2], "t": [r[0] for r in out], "late": [r[1] for r in out], "data": [r[2] for r in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The clip is over: its count of late rows, with no frame, and no state any more."""
        late = self.late.get()[0] if self.late.exists() else 0
        self.filter.clear()
        self.late.clear()
        yield pd.DataFrame({"video_id": [key[0]], "level": [key[1]], "tile": [key[2]], "t": pd.array([None], "Int32"), "late": [late], "data": pd.Series([None], dtype=object)})

    def close(self) -> None:
        pass


def frame_stream(frames: DataFrame, levels: int, low: float, high: float, alpha: float, lambda_cutoff: float, attenuation: float = 1.0, fps: float | None = None, border: str = "reflect", idle: float | None = None) -> DataFrame:
    """Rows (video_id, level, tile, t, late, data) of a stream of frames (video_id, t, h, w, c, data[, fps]):
    filtered and amplified levels of each frame, and how many rows of the tile had come late until then.
    The first row of a late tile in a batch that has no other rows is not given; its count comes with the
    next frame, or at the end with `idle`, as a row without t."""
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    bands = arrays.laplacian_frames(clips.rated(frames, fps), levels, True, border, None, lambda sizes: gains(sizes, alpha, lambda_cutoff))
    work = FrameFilter(low, high, attenuation, idle)
    mode = "ProcessingTime" if idle is not None else "None"
    return tiles(bands).groupBy("video_id", "level", "tile").transformWithStateInPandas(work, OUT, "Append", mode)
